"""Numerical kernels against closed forms and against enumeration of all paths."""

import itertools

import numpy as np
import pytest

from popspark.jobs.inference import Model, csds_of, e_step, e_steps, em, genetic, likelihoods, m_step, nelder_mead, offspring, prepared, random_starts
from popspark.jobs.model_queries import ONE, TWO, _data
from popspark.model import hmm
from popspark.model.coalescent import STYLES, expm, mean_lineages, tables
from popspark.model.intervals import boundaries
from popspark.operators import csd
from popspark.operators.likelihood import evaluated, posteriors, step_tensors, summed_stats
from popspark.sources.models import bound, parse_demography, parse_params

PARAMS = parse_params("0.01\n0.02\n0 1\n1 0\n")
SF = "/root/testdata/sf0.001"


def test_intervals():
    one = bound(parse_demography("[0.3]\n{{0}}\n1\nnull\n0\n{{0}}\n2\nnull\n0\n"), [])
    two = bound(parse_demography("[0.3]\n{{0},{1}}\n1 2\nnull\n0 1\n1 0\n{{0,1}}\n1\nnull\n0\n"), [])
    trunk = np.array([2, 2])
    b = boundaries("logUniform", [8, 0.01, 4], one)
    assert len(b) == 11 and b[:2] == [0.0, 0.01] and b[-2:] == [4, float("inf")]
    assert len(boundaries("loguniform", "11,0.01,4", one)) == 14
    assert np.allclose(np.diff(np.log(b[1:-1])), np.log(400) / 8)
    assert boundaries("single", [], one) == [0.0, float("inf")] and boundaries("simple", [], one) == [0, 0.3, float("inf")]
    assert boundaries("customFixed", [0.1, 0.2], one)[1:-1] == [0.1, 0.2] and boundaries("custom", [0.1, 0.2], two, trunk)[1:-1] == [0.05, 0.1]
    assert np.allclose(boundaries("fixeduniform", [2, 3.0], two, trunk)[1], np.log(2) * 1.5)
    q = boundaries("quadrature", [2], one)
    assert np.allclose(1 - np.exp(-q[1]), (2 + np.sqrt(2)) / 4)
    # Two trunk lineages at the beginning: the first piece is half as long.
    assert np.allclose(boundaries("quadrature", [3, 1.0], one, np.array([2]))[1], boundaries("quadrature", [3], one)[1] / 2)
    assert boundaries("quadrature2", [3, 1.0], one, np.array([2]))[1] == boundaries("quadrature", [3, 1.0], one, np.array([2]))[1]
    # Rates 2 and 1 before the split, mean 1.5; 4 after it.
    m = boundaries("meanrate", [4], two, trunk)
    assert np.allclose(m[1], np.log(4 / 3) / 1.5) and np.allclose(m[2], 0.3 + (np.log(2) - 0.45) / 4)
    u = boundaries("mixtureuniform", [2], two, trunk)
    half = 0.5 * (np.exp(-2 * 0.3) + np.exp(-0.3))
    assert np.allclose(u[1], 0.3 + np.log(1 - (0.5 - (1 - half))) / -4) and len(u) == 3
    # Mean sizes over numbers 1/2 and 2/2, so a rate of 2 / 1.5.
    assert np.allclose(boundaries("old", [1], two, trunk), [0, 0.3, np.log(2) * 0.75, float("inf")])
    assert boundaries("combined", "customfixed:0.1,0.3/simple:", one) == [0, 0.1, 0.3, float("inf")]
    with pytest.raises(ValueError):
        boundaries("nothing", [], one)
    with pytest.raises(ValueError):
        boundaries("customfixed", [0.2, 0.1], one)


def test_mean_lineages():
    """Three lineages coalesce at rates 3 and 1."""
    t = 0.4
    two = 3 / (3 - 1) * (np.exp(-t) - np.exp(-3 * t))
    assert np.isclose(mean_lineages(3, t), 3 * np.exp(-3 * t) + 2 * two + 1 - np.exp(-3 * t) - two)
    assert mean_lineages(5, 0) == 5 and mean_lineages(5, float("inf")) == 1


def test_exponential():
    a = np.array([[[-1.0, 1.0], [2.0, -2.0]]])
    assert np.allclose(expm(a)[0], (np.array([[2, 1], [2, 1]]) + np.exp(-3) * np.array([[1, -1], [-2, 2]])) / 3)


@pytest.mark.parametrize("size", [0.5, 1.0, 3.0])
def test_one_population(size):
    """One trunk lineage in a population of constant size absorbs at rate 1/size."""
    e = bound(parse_demography("[]\n{{0}}\n?0\nnull\n0\n"), [size])
    b = boundaries("loguniform", [6, 0.05, 3], e)
    t = tables(e, b, np.array([1]), 0, PARAMS, loci=3, style="simple", per_piece=48)
    want = np.exp(-np.array(b[:-1]) / size) - np.exp(-np.array(b[1:]) / size)
    assert np.allclose(np.exp(t.initial), want, atol=1e-9)
    rho = PARAMS.rho * 3
    together = (np.exp(-np.array(b[:-1]) * (1 / size + rho)) - np.exp(-np.array(b[1:]) * (1 / size + rho))) / (1 + rho * size)
    assert np.allclose(np.exp(t.stay), together / want, rtol=2e-4)
    mid = lambda a, z: sum(np.exp(-x / size) / size * np.exp(-PARAMS.theta * x) for x in a + (np.arange(4000) + 0.5) * (z - a) / 4000) * (z - a) / 4000
    same = np.array([mid(a, min(z, 40 * size)) for a, z in zip(b[:-1], b[1:], strict=True)]) / want
    assert np.allclose(np.exp(t.emit)[:, 0, 0], same, rtol=1e-3)


@pytest.mark.parametrize("style", STYLES)
def test_invariants(style):
    t = parse_demography(TWO)
    for point in ([0.1, 0.5, 0.7, 4.0, 1.0], [0.4, 2.0, 0.3, 0.1, 1.5]):
        e = bound(t, point)
        x = tables(e, boundaries("loguniform", [4, 0.05, 2], e), np.array([2, 3]), 1, PARAMS, loci=10, style=style)
        assert np.isclose(np.exp(x.initial).sum(), 1) and np.allclose(np.exp(x.stay) + np.exp(x.move).sum(1), 1)
        assert np.allclose(np.exp(x.emit).sum(2), 1)
        joint = np.exp(x.initial)[:, None] * np.exp(x.move)
        assert np.allclose(joint, joint.T, atol=2e-5)


@pytest.mark.parametrize("style", [s for s in STYLES if s != "simple"])
def test_one_lineage_has_nothing_to_coalesce(style):
    """A trunk of one haplotype absorbs at rate 1/size whatever the trunk's process."""
    e = bound(parse_demography("[0.2]\n{{0}}\n0.7\nnull\n0\n{{0}}\n1.5\nnull\n0\n"), [])
    b = boundaries("loguniform", [4, 0.05, 2], e)
    one, other = (tables(e, b, np.array([1]), 0, PARAMS, style=s, per_piece=48) for s in (style, "simple"))
    assert np.allclose(np.exp(one.initial), np.exp(other.initial), atol=1e-6)


def random_tables(s, demes, seed):
    r = np.random.default_rng(seed)
    p = r.dirichlet(np.ones(s + 1), s)
    with np.errstate(divide="ignore"):
        return hmm.Tables(np.log(r.dirichlet(np.ones(s))), np.log(p[:, 0]), np.log(p[:, 1:]), np.log(r.dirichlet(np.ones(2), (s, 2))), np.arange(s) % demes)


@pytest.mark.parametrize("demes", [1, 2])
def test_forward_and_backward(demes):
    s, h, steps = 2, 3, 4
    t = random_tables(s, demes, demes)
    share = t.shares([0, demes - 1, 0])
    counts = np.random.default_rng(5).integers(0, 3, (steps, h, 2, 2)).astype(float)
    e = hmm.emissions(counts, t)
    states = list(itertools.product(range(s), range(h)))
    total, first, moves = 0.0, np.zeros(s), np.zeros((s, s))
    for path in itertools.product(states, repeat=steps):
        p = np.exp(t.initial[path[0][0]] + share[path[0]] + e[(0, *path[0])])
        recombined = np.zeros((s, s))
        for k in range(1, steps):
            (a, x), (b, y) = path[k - 1], path[k]
            stay, move = np.exp(t.stay[a]) * (a == b and x == y), np.exp(t.move[a, b] + share[b, y])
            recombined[a, b] += move / (stay + move) if stay + move else 0
            p *= (stay + move) * np.exp(e[(k, b, y)])
        total += p
        first[path[0][0]] += p
        moves += p * recombined
    cells = hmm.Cells.dense(counts)
    loglik, (initial, stay, move, emit, own) = hmm.expected(cells, t, share)
    assert np.isclose(loglik, np.log(total)) and np.allclose(initial, first / total) and np.allclose(move, moves / total)
    assert np.isclose(stay.sum() + move.sum(), steps - 1) and np.isclose(emit.sum() * h, counts.sum(), rtol=1) and np.isclose(hmm.loglik(cells, t, share), loglik)
    assert (own <= np.diag(move) + 1e-12).all() and own.sum() > 0
    b = hmm.backward(counts, t, share)
    assert np.isclose(hmm.log_sum(t.initial[:, None] + share + e[0] + b[0]), loglik)
    assert all(np.allclose(x, y) for x, y in zip((initial, stay, move, emit, own), hmm.expected_in_logs(counts, t, share)[1], strict=True))


def test_blocks_and_underflow(monkeypatch):
    """Blocks of any size give the same; states that are too far apart for plain numbers go through logarithms."""
    t = random_tables(3, 1, 8)
    share = t.shares([0, 0, 0])
    counts = np.random.default_rng(2).integers(0, 4, (50, 3, 2, 2)).astype(float)
    want = hmm.expected_in_logs(counts, t, share)
    for block in (1, 7, 256):
        monkeypatch.setattr(hmm, "BLOCK", block)
        got = hmm.expected(hmm.Cells.dense(counts), t, share)
        assert np.isclose(got[0], want[0]) and all(np.allclose(x, y) for x, y in zip(got[1], want[1], strict=True))
        states = np.concatenate([p for _, p in sorted(hmm.decoded(hmm.Cells.dense(counts), t, share), key=lambda x: x[0])])
        assert states.shape == (50, 3) and np.allclose(states.sum(1), 1)
    sharp = hmm.Tables(t.initial, t.stay, t.move, np.log(np.array([[[1 - 1e-9, 1e-9], [1e-9, 1 - 1e-9]], [[1e-9, 1 - 1e-9], [1 - 1e-9, 1e-9]], [[0.5, 0.5], [0.5, 0.5]]])), t.deme)
    far = np.zeros((4, 3, 2, 2))
    far[:, :, 0, 0] = [[2000], [0], [2000], [0]]
    far[:, :, 0, 1] = [[0], [2000], [0], [2000]]
    assert np.isclose(hmm.loglik(hmm.Cells.dense(far), sharp, share), hmm.forward(far, sharp, share)[1])


def test_objectives():
    """With one haplotype in the trunk, a recombination into its own state is none for the lineage."""
    t = random_tables(2, 1, 3)
    share = t.shares([0])
    stats = hmm.expected(hmm.Cells.dense(np.random.default_rng(0).integers(0, 3, (20, 1, 2, 2)).astype(float)), t, share)[1]
    initial, stay, move, emit, own = stats
    assert np.allclose(own, np.diag(move))
    rest = (initial * t.initial).sum() + (emit * t.emit).sum()
    off = move - np.diag(np.diag(move))
    assert np.isclose(hmm.gain(stats, t, kind="transition"), rest + (stay * t.stay).sum() + (move * t.move).sum())
    assert np.isclose(hmm.gain(stats, t, (1,), "lineage"), rest + ((stay + own) * np.logaddexp(t.stay, np.diag(t.move))).sum() + (off * t.move).sum())
    assert np.isclose(hmm.gain(stats, t, kind="marginal"), (emit * t.emit).sum() + ((initial + stay + move.sum(0)) * t.initial).sum())


def test_trunk_sizes(spark):
    def sizes(n, wanted):
        perms = spark.createDataFrame([(0, list(range(n)))], "perm int, ord array<int>")
        return sorted(r.csd for r in csd.permuted(perms, wanted=wanted).collect())

    assert sizes(5, None) == [0, 1, 2, 3, 4] and sizes(5, 9) == [0, 1, 2, 3, 4] and sizes(5, 1) == [4] and sizes(5, 2) == [1, 4]
    assert sizes(20, 5) == [1, 5, 10, 14, 19]


def test_nelder_mead():
    x, value = nelder_mead(lambda v: float((v[0] - 3) ** 2 + (v[1] - 1) ** 2), np.array([1.0, 2.0]), 0.2, 120)
    assert np.allclose(x, [3, 1], atol=1e-3) and value < 1e-5


def test_offspring():
    r = np.random.default_rng(0)
    limits = [(0.1, 2.0), (0.1, 2.0)]
    got = offspring([[0.5, 0.5], [1.0, 1.9]], 30, limits, r)
    assert got[:2] == [[0.5, 0.5], [1.0, 1.9]] and len(got) == 30 and all(low <= x <= high for p in got for x, (low, high) in zip(p, limits, strict=True))


def test_em_and_search(spark):
    data, model = _data(spark, SF, "pcl", ONE, dict.fromkeys(range(4), 0))
    path = em(data, model, [1.0, 1.0], iterations=2, m_iterations=5)
    values = [r["loglik"] for r in path]
    assert len(values) == 3 and all(b >= a - 1e-6 * abs(a) for a, b in zip(values[:-1], values[1:], strict=True))
    model.limits = [(0.2, 5.0), (0.2, 5.0)]
    assert random_starts(model.limits, 40, 0) == random_starts(model.limits, 40, 0) and all(0.2 <= x <= 5 for p in random_starts(model.limits, 40, 0) for x in p)
    rows = genetic(data, model, [[1.0, 1.0], [0.3, 2.0], [4.0, 0.5]], generations=2, keep=1, seed=1)
    best = [max(r["loglik"] for r in rows if r["generation"] == g) for g in (0, 1)]
    assert best[1] >= best[0] and likelihoods(data, model, {0: [9.0, 9.0]}).count() == 0
    assert m_step({}, model, [1.0, 1.0], 3) == [1.0, 1.0]
    # With EM inside, every particle rises, and the next generation begins with the best one's last point.
    rows = genetic(data, model, [[1.0, 1.0], [0.3, 2.0]], generations=2, keep=1, seed=1, em_iterations=1, m_iterations=4)
    assert len(rows) == 8
    last = {(r["generation"], r["particle_id"]): r for r in rows if r["em_step"] == 1}
    for r in rows:
        if r["em_step"] == 0:
            assert last[r["generation"], r["particle_id"]]["loglik"] >= r["loglik"] - 1e-6 * abs(r["loglik"])
    best = max((last[0, i] for i in (0, 1)), key=lambda r: r["loglik"])
    assert [r["point"] for r in rows if (r["generation"], r["particle_id"], r["em_step"]) == (1, 0, 0)] == [best["point"]]


@pytest.mark.parametrize("objective", ["lineage", "transition"])
def test_rates_are_estimated(spark, objective):
    """The mutation rate and the recombination rate's factor are coordinates after the demography's."""
    data, model = _data(spark, SF, "pcl", ONE, dict.fromkeys(range(4), 0))
    model.scale_recombination = model.estimate_theta = True
    model.objective = objective
    assert model.at([1.0, 2.0, 3.0, 0.5])[0] == [1.0, 2.0] and model.at([1.0, 2.0, 3.0, 0.5])[1].theta == 0.5
    assert np.isclose(model.at([1.0, 2.0, 3.0, 0.5])[1].rho, 3 * model.params.rho)
    path = em(data, model, [1.0, 1.0, 1.0, model.params.theta], iterations=1, m_iterations=5)
    assert path[1]["loglik"] > path[0]["loglik"] and path[1]["point"][3] != path[0]["point"][3]


def test_steps_end_with_their_contig(spark):
    """A contig's expected transitions and posteriors do not depend on how long other contigs are."""
    def tensors(counts, lengths):
        haps = spark.createDataFrame([(0,), (1,), (2,)], "hap int")
        return step_tensors(spark.createDataFrame(counts, "chunk int, step int, add int, trunk int, a int, b int, n long"), csd.pairwise(haps), lengths=spark.createDataFrame(lengths, "chunk int, n_steps int"))

    pairs = [(i, j) for i in range(3) for j in range(3) if i != j]
    short = [(0, s, i, j, (s + i) % 2, (s + j) % 2, 3) for s in range(5) for i, j in pairs]
    long = [(1, s, i, j, (s * i) % 2, (s * j) % 2, 2) for s in range(0, 60, 3) for i, j in pairs]
    t = {((1,), 0): random_tables(3, 1, 2)}
    demes = dict.fromkeys(range(3), 0)
    alone, both = tensors(short, [(0, 5)]), tensors(short + long, [(0, 5), (1, 60)])
    found = [{(r.chunk, r.csd): r for r in evaluated(x, {0: t}, demes, 1, 2, with_stats=True).collect()} for x in (alone, both)]
    for key, r in found[0].items():
        assert np.isclose(found[1][key].loglik, r.loglik) and np.allclose(found[1][key].move, r.move)
        assert np.isclose(sum(r.move) + sum(r.stay), 4)
    for (chunk, _), r in found[1].items():
        assert np.isclose(sum(r.move) + sum(r.stay), {0: 4, 1: 59}[chunk])
    assert summed_stats(evaluated(both, {0: t}, demes, 1, 2, with_stats=True)).where("kind in ('move', 'stay')").groupBy().sum("value").first()[0] == pytest.approx(6 * 63)
    assert {(r.chunk, r.n) for r in posteriors(both, t, demes, 1, 2).groupBy("chunk", "csd").count().selectExpr("chunk", "count as n").distinct().collect()} == {(0, 15), (1, 180)}


def test_copies_and_particles(spark):
    """A haplotype that is there twice against enumeration: each copy is a member, and shares the trunk's deme evenly."""
    counts = [(0, s, i, j, (s + i) % 2, (s * j) % 2, 2) for s in range(3) for i in range(2) for j in range(2) if i != j]
    same = {(s, i): (s + i) % 2 if i == 0 else 0 for s in range(3) for i in range(2)}
    counts = [(0, s, i, j, same[s, i], same[s, j], 2) for s in range(3) for i, j in ((0, 1), (1, 0))]
    frame = spark.createDataFrame(counts, "chunk int, step int, add int, trunk int, a int, b int, n long")
    members = spark.createDataFrame([(0,), (1,), (2,)], "hap int")
    haps = {0: 0, 1: 0, 2: 1}
    x = step_tensors(frame, csd.leave_one_out(members), haps=haps)
    t = random_tables(2, 1, 1)
    other = random_tables(2, 1, 9)
    got = {(r.particle_id, r.csd): r.loglik for r in evaluated(x, {0: {((2,), 0): t}, 5: {((2,), 0): other}}, dict.fromkeys(range(3), 0), 1, 2).collect()}
    for particle, own in ((0, t), (5, other)):
        for add in range(3):
            trunk = [m for m in range(3) if m != add]
            dense = np.zeros((3, 2, 2, 2))
            for s in range(3):
                for k, m in enumerate(trunk):
                    dense[s, k, same[s, haps[add]], same[s, haps[m]]] = 2
            total = 0.0
            e = hmm.emissions(dense, own)
            for path in itertools.product(list(itertools.product(range(2), range(2))), repeat=3):
                p = np.exp(own.initial[path[0][0]] + np.log(0.5) + e[(0, *path[0])])
                for k in (1, 2):
                    (a, i), (b, j) = path[k - 1], path[k]
                    p *= (np.exp(own.stay[a]) * (a == b and i == j) + np.exp(own.move[a, b]) * 0.5) * np.exp(e[(k, b, j)])
                total += p
            assert got[particle, add] == pytest.approx(np.log(total))
    data = prepared(frame, csd.pairwise(members), Model(parse_demography(ONE), PARAMS, dict.fromkeys(range(3), 0), 1, interval_params=[3, 0.1, 2], haps=haps), 2)
    model = Model(parse_demography(ONE), PARAMS, dict.fromkeys(range(3), 0), 1, interval_params=[3, 0.1, 2], haps=haps)
    points = {3: [1.0, 1.0], 7: [0.5, 2.0], 9: [1e-9, 1.0]}
    single = {i: e_step(data, model, p)[0] for i, p in points.items()}
    assert {i: v for i, (v, _) in e_steps(data, model, points).items()} == pytest.approx(single) and single[9] == float("-inf")
    assert {r.particle_id: r.loglik for r in likelihoods(data, model, points).collect()} == pytest.approx({3: single[3], 7: single[7]})


def test_pac_of_two_haplotypes(spark):
    """Each permutation is the first haplotype's stationary probability times the second's, given the first."""
    model = Model(parse_demography(ONE), parse_params("0.01\n0.01\n0.9 0.1\n0.3 0.7\n"), {0: 0, 1: 0}, 1, loci=10, interval_params=[3, 0.1, 2])
    cells = [(0, 0, 0, 7), (0, 0, 1, 2), (0, 1, 1, 1), (1, 0, 0, 8), (1, 1, 1, 2)]
    pairs = [(0, step, 0, 1, x, y, n) for step, x, y, n in cells] + [(0, step, 1, 0, y, x, n) for step, x, y, n in cells]
    counts = spark.createDataFrame(pairs, "chunk int, step int, add int, trunk int, a int, b int, n long")
    perms = spark.createDataFrame([(0, [0, 1]), (1, [1, 0])], "perm int, ord array<int>")
    haps = spark.createDataFrame([(0,), (1,)], "hap int")
    # The stationary distribution is (3/4, 1/4); haplotype 0 has 17 and 3 loci of each allele, haplotype 1 has 15 and 5.
    first = {0: 17 * np.log(0.75) + 3 * np.log(0.25), 1: 15 * np.log(0.75) + 5 * np.log(0.25)}
    pair = csds_of("pcl", haps)
    data = prepared(counts, pair, model, 2)
    found = model.tables([1.0, 1.0], data.keys)
    second = {r.csd // 2: r.loglik for r in evaluated(data.tensors, {0: found}, model.demes, 1, 2).collect()}
    both = [first[1] + second[0], first[0] + second[1]]
    pac = prepared(counts, csds_of("pac", haps, perms), model, 2)
    assert likelihoods(pac, model, {0: [1.0, 1.0]}).first().loglik == pytest.approx(np.logaddexp(*both))
    value, stats = e_step(pac, model, [1.0, 1.0])
    assert value == pytest.approx(np.logaddexp(*both)) and list(stats) == [((1,), 0)]
    superpac = prepared(counts, csds_of("superpac", haps, perms), model, 2)
    assert likelihoods(superpac, model, {0: [1.0, 1.0]}).first().loglik == pytest.approx(sum(both))
    states = posteriors(pac.tensors, found, model.demes, 1, 2)
    assert states.select("perm", "csd").distinct().count() == 2


def test_doubling():
    """Jumping over blocks without segregating sites gives what going through them gives."""
    t = random_tables(3, 1, 4)
    share = t.shares([0, 0])
    counts = np.zeros((9, 2, 2, 2))
    counts[:, :, 0, 0] = 2.0
    counts[[0, 8], 0, 0, 1] = 1.0
    _, plain = hmm.forward(counts, t, share)
    between = t.emit[:, 0, 0] * 2
    jump = hmm.jump_tables(t, between, 3)[3]
    _, skipped = hmm.forward(counts[[0, 8]], hmm.Tables(t.initial, jump.stay, jump.move, t.emit, t.deme), share)
    assert np.isclose(plain, skipped)


@pytest.mark.parametrize("places", [[0, 8], [3], [2, 3, 30], [0, 40], []])
def test_skipping(places):
    """Going from one segregating site to the next gives what going locus by locus gives."""
    t, n = random_tables(3, 1, 4), 41
    share = t.shares([0, 0])
    counts = np.zeros((n, 2, 2, 2))
    counts[:, :, 0, 0] = 1
    for k in places:
        counts[k] = 0
        counts[k, 0, 1, 0] = counts[k, 1, 1, 1] = 1
    want = hmm.forward(counts, t, share)[1]
    cells = hmm.Cells.of(*(np.array(x, int) for x in ([p for p in places for _ in (0, 1)], [0, 1] * len(places), [1, 1] * len(places), [0, 1] * len(places), [1, 1] * len(places))), n, 2, 2)
    assert np.isclose(hmm.skipping(cells, t, share), want)


def dense_with_gaps(seed):
    """A chain of still, missing and segregating loci: (dense counts, cells, missing runs)."""
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 80))
    places = sorted(set(r.integers(0, n, int(r.integers(0, 6))).tolist()))
    missing, at = [], 0
    while at < n and seed % 2:
        at += int(r.integers(1, 12))
        run = int(r.integers(1, 9))
        if at < n:
            missing.append((at, min(run, n - at)))
        at += run + 1
    dense, rows = np.zeros((n, 2, 2, 2)), []
    dense[:, :, 0, 0] = 1
    for low, run in missing:
        dense[low : low + run] = 0
    for k in places:
        dense[k] = 0
        dense[k, 0, 1, 0] = dense[k, 1, 1, 1] = 1
        rows += [(k, 0, 1, 0, 1), (k, 1, 1, 1, 1)]
    return dense, hmm.Cells.of(*np.array(rows, int).reshape(-1, 5).T, n, 2, 2), np.array(missing, int).reshape(-1, 2)


@pytest.mark.parametrize("seed", range(12))
def test_expected_counts_under_skipping(seed):
    """Counts and posteriors that come out of jumps are those of the chain that goes locus by locus."""
    t = random_tables(3, 1, seed)
    share = t.shares([0, 0])
    dense, cells, missing = dense_with_gaps(seed)
    total, want = hmm.expected(hmm.Cells.dense(dense), t, share)
    found, got = hmm.skipping_expected(cells, t, share, missing=missing)
    assert np.isclose(found, total) and np.isclose(hmm.skipping(cells, t, share, missing=missing), total)
    for x, y in zip(got, want, strict=True):
        assert np.allclose(x, y, atol=1e-10)
    plain = np.concatenate([p for _, p in list(hmm.decoded(hmm.Cells.dense(dense), t, share))[::-1]])
    places = np.arange(0, len(dense), 4)
    steps, states = zip(*list(hmm.skipping_decoded(cells, t, share, places, missing=missing))[::-1], strict=True)
    assert np.concatenate(steps).tolist() == places.tolist() and np.allclose(np.concatenate(states), plain[places])


def test_logarithms_in_blocks(monkeypatch):
    """Where plain numbers do not reach, the chain goes in logarithms, block by block: counts and states are those of the whole."""
    monkeypatch.setattr(hmm, "BLOCK", 7)
    t = random_tables(3, 1, 2)
    r = np.random.default_rng(5)
    dense = r.integers(0, 3, (40, 2, 2, 2)) * 900.0
    move = np.where(np.eye(3) > 0, t.move, -800.0)
    sharp = hmm.Tables(t.initial, np.log1p(-np.exp(move).sum(1)), move, np.log(np.array([[[1 - 1e-9, 1e-9], [1e-9, 1 - 1e-9]], [[0.5, 0.5], [0.5, 0.5]], [[1e-9, 1 - 1e-9], [1 - 1e-9, 1e-9]]])), t.deme)
    share = sharp.shares([0, 0])
    with pytest.raises(hmm._Underflow):
        hmm._Chain(hmm.Cells.dense(dense), sharp, share).forward()
    total, want = hmm.expected_in_logs(dense, sharp, share)
    found, got = hmm.expected(hmm.Cells.dense(dense), sharp, share)
    assert np.isclose(found, total) and all(np.allclose(x, y) for x, y in zip(got, want, strict=True))
    assert hmm.logliks(hmm.Cells.dense(dense), [sharp, t], [share, t.shares([0, 0])]) == pytest.approx([total, hmm.forward(dense, t, share)[1]])
    f, value = hmm.forward(dense, sharp, share)
    states = np.concatenate([p for _, p in list(hmm.decoded(hmm.Cells.dense(dense), sharp, share))[::-1]])
    assert np.allclose(states, np.exp(f + hmm.backward(dense, sharp, share) - value).sum(2))


def test_particles_in_tasks(spark, monkeypatch):
    """Tables and M-steps that tasks make are those that the driver makes, and parts of the particles give what all do."""
    from popspark.jobs import inference

    counts = [(c, s, i, j, (s + i) % 2, (s * j) % 2, 2) for c in range(2) for s in range(4) for i in range(3) for j in range(3) if i != j]
    frame = spark.createDataFrame(counts, "chunk int, step int, add int, trunk int, a int, b int, n long")
    members = spark.createDataFrame([(0,), (1,), (2,)], "hap int")
    model = Model(parse_demography(ONE), PARAMS, dict.fromkeys(range(3), 0), 1, interval_params=[2, 0.1, 1], limits=[(0.1, 9.0), (0.1, 9.0)], style="simple")
    data = prepared(frame, csd.leave_one_out(members), model, 2)
    starts = inference.random_starts(model.limits, 5, 3) + [[100.0, 1.0]]
    found = []
    for own, groups in ((1, None), (100, None), (1, 3)):
        monkeypatch.setattr(inference, "OWN", own)
        if groups:
            monkeypatch.setattr(inference.Data, "groups", lambda self, particles, abreast: groups)
        rows = inference.genetic(data, model, starts, 2, 2, 4, em_iterations=1, m_iterations=3)
        found.append([(r["generation"], r["em_step"], r["particle_id"], r["loglik"], *r["point"]) for r in rows])
    assert len(found[0]) > 20 and any(x[3] == -np.inf for x in found[0])
    for other in found[1:]:
        assert [x[:3] for x in other] == [x[:3] for x in found[0]]
        assert np.allclose([x[3:] for x in other if x[3] > -np.inf], [x[3:] for x in found[0] if x[3] > -np.inf], rtol=1e-6)


BOUNDS = [0.0, 0.05, 0.2, 0.31, 0.9, 2.0, float("inf")]
#: Two demes with migration, a pulse, and one deme before; one deme that grows; two demes apart, of which the trunk is in one.
PULSED = "[0.1, ?0]\n{{0},{1}}\n?1 0.7\nnull\n0 0.4\n0.2 0\n{{0},{1}}\n0.9 0.6\n0 0.2\n0 0\n0 0.3\n0.5 0\n{{0,1}}\n1.5\nnull\n0\n"


def difference(x, y):
    return max(float(abs(np.exp(getattr(x, k)) - np.exp(getattr(y, k))).max()) for k in ("initial", "stay", "move", "emit"))


class TestCores:
    def epochs(self, text, point, **options):
        return bound(parse_demography(text, **options), point)

    def test_cores_agree(self):
        from popspark.model.cores import HELD, made

        two = self.epochs("[?0]\n{{0},{1}}\n?1 ?2\nnull\n0 ?3\n?3 0\n{{0,1}}\n?4\nnull\n0\n", [0.3, 1.0, 0.8, 0.5, 1.2])
        three = parse_params("0.05\n0.02\n0 .5 .5\n.2 .6 .2\n.4 .4 .2\n")
        for style in HELD:
            for one_event, params in ((True, PARAMS), (False, three)):
                same = (two, BOUNDS, np.array([2, 3]), 0, params, 5, style, one_event)
                exact = made("spectral", *same)
                # Rows of rare states divide by their mass, 2e-4 here, so a tolerance is met that much less.
                assert difference(exact, made("adaptive", *same, tolerance=1e-13)) < 1e-9
                assert difference(exact, made("adaptive", *same, tolerance=1e-11)) < 1e-7
                assert difference(exact, made("steps", *same)) < 1e-3
                assert difference(exact, made("auto", *same)) == 0
        moving = (two, BOUNDS, np.array([2, 3]), 1, PARAMS, 5, "migratingethan")
        assert difference(made("adaptive", *moving, tolerance=1e-12), made("steps", *moving, per_piece=200)) < 1e-5
        assert difference(made("auto", *moving), made("adaptive", *moving, tolerance=1e-12)) < 1e-6

    def test_one_deme_in_closed_form(self):
        """A trunk of n that stays in one deme of size s: the first state is exponential, and neighbours that have not recombined
        at rate 1 are as exponential with the sum of the rates."""
        from popspark.model.cores import made

        rho, rate = PARAMS.rho * 7, 4 / 1.5
        one = self.epochs("[0.2]\n{{0}}\n?0\nnull\n0\n{{0}}\n?0\nnull\n0\n", [1.5])
        t = np.array(BOUNDS)
        law = -np.diff(np.exp(-rate * t))
        still = -np.diff(np.exp(-(rate + rho) * t)) * rate / (rate + rho)
        for core in ("spectral", "adaptive"):
            got = made(core, one, BOUNDS, np.array([4]), 0, PARAMS, 7, "simple")
            assert np.allclose(np.exp(got.initial), law, atol=1e-8) and np.allclose(np.exp(got.stay), still / law, atol=1e-7)
            assert np.allclose(np.exp(got.stay) + np.exp(got.move).sum(1), 1)
            # Where both lineages are absorbed in later intervals than that of the recombination, they are independent.
            joint = np.exp(got.initial)[:, None] * np.exp(got.move)
            assert np.allclose(joint, joint.T, atol=1e-8)
            late = joint[-2:, -2:]
            assert np.isclose(late[0, 1] / late.sum(), joint[-2, -1] / late.sum())

    def test_pulses_and_demes_apart(self):
        from popspark.model.cores import made

        pulsed = self.epochs(PULSED, [0.5, 1.1])
        for style in ("simple", "migratingethan", "migmulticakeupdating"):
            for deme in (0, 1):
                same = (pulsed, BOUNDS, np.array([3, 2]), deme, PARAMS, 3, style)
                assert difference(made("adaptive", *same, tolerance=1e-11), made("steps", *same, per_piece=150)) < 1e-5
        assert difference(made("spectral", pulsed, BOUNDS, np.array([3, 2]), 0, PARAMS, 3, "simple"), made("adaptive", pulsed, BOUNDS, np.array([3, 2]), 0, PARAMS, 3, "simple", tolerance=1e-13)) < 1e-9
        # A deme without trunk that nothing leaves until the demes merge: an eigenvalue of 0.
        apart = self.epochs("[0.4]\n{{0},{1}}\n1 1\nnull\n0 0\n0 0\n{{0,1}}\n1\nnull\n0\n", [])
        same = (apart, BOUNDS, np.array([3, 0]), 1, PARAMS, 3, "simple")
        got = made("spectral", *same)
        assert difference(got, made("adaptive", *same, tolerance=1e-13)) < 1e-9
        assert np.isclose(np.exp(got.initial[0::2])[:3].sum(), 0) and np.isclose(np.exp(got.initial).sum(), 1)

    def test_growth(self):
        """With growth, error control meets ever finer steps; the spectral core refuses."""
        from popspark.model.cores import made

        grown = self.epochs("[0.5]\n{{0}}\n1.0\nnull\n0\n{{0}}\n0.6\nnull\n0\n", [], rates="1.3\n0\n")
        same = (grown, BOUNDS, np.array([3]), 0, PARAMS, 3, "simple")
        best = made("adaptive", *same, tolerance=3e-14)
        errors = [difference(best, made("steps", *same, per_piece=n)) for n in (20, 40, 80, 160)]
        assert errors[-1] < 2e-5 and all(a > 3 * b for a, b in zip(errors, errors[1:], strict=False))
        assert difference(best, made("adaptive", *same, tolerance=1e-13)) < 1e-9 and difference(best, made("adaptive", *same, tolerance=1e-10)) < 1e-7
        assert difference(best, made("auto", *same)) < 1e-6
        with pytest.raises(ValueError, match="growth"):
            made("spectral", *same)

    def test_matrices_without_eigenvectors(self):
        from popspark.model.spectral import spectrum

        with pytest.raises(ValueError, match="diagonalized"):
            spectrum(np.array([[-1.0, 1.0], [0.0, -1.0]]))
        values, parts = spectrum(np.array([[-2.0, 2.0], [0.0, 0.0]]))
        assert sorted(values.real) == [-2, 0] and np.allclose(parts.sum(0), np.eye(2))


class TestTrunks:
    @pytest.mark.parametrize("n", range(1, 9))
    def test_exact_cake_against_the_death_process(self, n):
        """n + 1 lineages that coalesce pair by pair: a matrix exponential of the chain of their number, in which one of them is
        left alone so far."""
        from popspark.model.coalescent import expm, unabsorbed, unabsorbed_time

        size = n + 2
        q = np.zeros((size, size))
        for k in range(2, n + 2):
            q[k, k] = -k * (k - 1) / 2
            q[k, k - 1] = (k - 1) * (k - 2) / 2
        for t in (0.0, 0.03, 0.4, 2.0):
            want = expm(q[None] * t)[0][n + 1, 2:].sum()
            assert unabsorbed(n, t) == pytest.approx(want, abs=1e-12)
            assert unabsorbed_time(n, t) == pytest.approx(-np.linalg.solve(q[2:, 2:], np.ones(n))[None] @ expm(q[None] * t)[0][n + 1, 2:], rel=1e-9)

    def test_many_lineages_keep_their_digits(self):
        from decimal import Decimal, getcontext

        from popspark.model.coalescent import unabsorbed

        getcontext().prec = 120
        n, t = 100, Decimal("0.013")
        share, total = Decimal(1), Decimal(0)
        for i in range(1, n + 2):
            share *= Decimal(n + 2 - i) / Decimal(n + i)
            if i > 1:
                total += (2 * i - 1) * i * (i - 1) * share / (n * (n + 1)) * (-Decimal(i * (i - 1)) / 2 * t).exp()
        assert unabsorbed(n, 0.013) == pytest.approx(float(total), rel=1e-12) and unabsorbed(n, 0.0) == pytest.approx(1, rel=1e-12)

    def test_exact_cake_absorbs_as_the_coalescent_does(self):
        from popspark.model.coalescent import unabsorbed
        from popspark.model.cores import made

        one = bound(parse_demography("[0.2]\n{{0}}\n2\nnull\n0\n{{0}}\n2\nnull\n0\n"), [])
        got = made("spectral", one, BOUNDS, np.array([5]), 0, PARAMS, 1, "exactcake")
        assert np.allclose(np.exp(got.initial), -np.diff([unabsorbed(5, t / 2) for t in BOUNDS[:-1]] + [0.0]), atol=1e-9)

    def test_migrating_updating_cake(self):
        """In one deme it is the updating cake; with migration, it keeps as many lineages as that leaves of each present deme."""
        from popspark.model.coalescent import Trunk
        from popspark.model.cores import made

        one = bound(parse_demography(ONE), [1.0, 2.0])
        for core in ("steps", "adaptive", "spectral"):
            assert difference(*(made(core, one, BOUNDS, np.array([4]), 0, PARAMS, 1, s) for s in ("multicakeupdating", "migmulticakeupdating"))) < 1e-12
        sizes, migration = np.array([1.0, 0.5]), np.array([[-0.4, 0.4], [0.9, -0.9]])
        moving, still = Trunk(np.array([3, 5]), "migmulticakeupdating"), Trunk(np.array([3, 5]), "multicakeupdating")
        for a, b in ((0.0, 0.2), (0.2, 0.7)):
            for x in (moving, still):
                x.begun()
            of_moving, of_still = (x.piece(a, b, sizes, migration) for x in (moving, still))
            for t in (a, (a + b) / 2, b):
                assert np.allclose(of_moving(t, 0.0).sum(1), of_still(t, 0.0).sum(1)) and (of_moving(t, 0.0) >= 0).all()


def test_rows_follow_the_number_of_haplotypes(spark):
    """A CSD's row holds its own haplotypes' alleles and gives what pair counts give; 60 haplotypes take rows that are as much longer
    as there are more of them."""
    from popspark.operators import blocks
    from popspark.operators.likelihood import code_tensors

    r = np.random.default_rng(7)

    def sites(n):
        rows = [(c, int(p), [None if p % 11 == 0 and h == 1 else int(x) for h, x in enumerate(r.integers(0, 2, n))]) for c in range(2) for p in range(0, 400, 3)]
        return spark.createDataFrame(rows, "chunk int, pos long, alleles array<int>")

    few = sites(4)
    still = spark.createDataFrame([(c, s, s % 2, 5) for c in range(3) for s in range(10)], "chunk int, step long, allele int, n long")
    haps = spark.createDataFrame([(h,) for h in range(4)], "hap int")
    csds = csd.pairwise_and_leave_one_out(haps).unionByName(csd.permuted(spark.createDataFrame([(1, [0, 1, 2, 3])], "perm int, ord array<int>")))
    tables_ = {0: {((k,), 0): random_tables(2, 1, 5) for k in range(1, 4)}}
    for stats in (False, True):
        old = step_tensors(blocks.pair_counts(few, 50), csds, still)
        new = code_tensors(few, csds, 50, still)
        got = [sorted((x.chunk, x.perm, x.csd, round(x.loglik, 8), *([round(v, 8) for v in x.emit] if stats else [])) for x in evaluated(t, tables_, dict.fromkeys(range(4), 0), 1, 2, with_stats=stats, stationary=np.array([0.6, 0.4])).collect()) for t in (old, new)]
        assert got[0] == got[1] and len(got[0]) == 3 * 20
    sizes = {}
    for n in (6, 60):
        members = spark.createDataFrame([(h,) for h in range(n)], "hap int")
        row = code_tensors(sites(n), csd.leave_one_out(members), 50).where("csd = 2 and chunk = 0").first()
        sizes[n] = sum(map(len, row.codes)) + 4 * len(row.steps)
        assert len(row.codes) == n and len(set(map(len, row.codes))) == 1
    assert sizes[60] < 10 * sizes[6]


def test_rates_by_interval():
    """Pieces of one rate are the one rate; others add up along the intervals."""
    from dataclasses import replace

    from popspark.model.cores import made

    two = bound(parse_demography("[?0]\n{{0},{1}}\n?1 ?2\nnull\n0 ?3\n?3 0\n{{0,1}}\n?4\nnull\n0\n"), [0.3, 1.0, 0.8, 0.5, 1.2])
    for one_event in (True, False):
        for core in ("spectral", "adaptive", "steps"):
            plain = made(core, two, BOUNDS, np.array([2, 3]), 0, PARAMS, 1, "simple", one_event)
            same = made(core, two, BOUNDS, np.array([2, 3]), 0, replace(PARAMS, thetas=(PARAMS.theta,) * 6), 1, "simple", one_event)
            assert difference(plain, same) < 1e-8
        rising = replace(PARAMS, thetas=(0.01, 0.02, 0.04, 0.08, 0.16, 0.32))
        found = [made(core, two, BOUNDS, np.array([2, 3]), 0, rising, 1, "simple", one_event, **more) for core, more in (("spectral", {}), ("adaptive", {"tolerance": 1e-12}), ("steps", {"per_piece": 100}))]
        assert difference(found[0], found[1]) < 1e-8 and difference(found[0], found[2]) < 1e-4
        plain = made("spectral", two, BOUNDS, np.array([2, 3]), 0, PARAMS, 1, "simple", one_event)
        assert found[0].emit[-1, 0, 1] > plain.emit[-1, 0, 1] and np.allclose(found[0].move, plain.move)
    with pytest.raises(ValueError, match="hidden intervals"):
        made("spectral", two, BOUNDS, np.array([2, 3]), 0, replace(PARAMS, thetas=(0.1,)), 1, "simple")


@pytest.mark.parametrize("block", [5, 256])
def test_rates_along_a_contig(monkeypatch, block):
    """A map of one rate gives what no map gives; of two, what enumeration of all paths gives, with counts that are the slopes of
    the likelihood in each rate's tables."""
    monkeypatch.setattr(hmm, "BLOCK", block)
    one, other = random_tables(2, 1, 3), random_tables(2, 1, 8)
    other = hmm.Tables(one.initial, other.stay, other.move, one.emit, one.deme)
    share = one.shares([0, 0])
    dense = np.random.default_rng(1).integers(0, 3, (9, 2, 2, 2)).astype(float)
    cells = hmm.Cells.dense(dense)
    total, want = hmm.expected(cells, one, share)
    for runs in ([[0, 7]], [[0, 7], [4, 7], [6, 7]]):
        found, stats = hmm.rated(cells, {7: one}, np.array(runs), share)
        assert np.isclose(found, total) and all(np.allclose(x, y) for x, y in zip(stats[7], want, strict=True))
    which = [0, 0, 0, 1, 1, 0, 0, 1, 1]
    runs = np.array([[0, 0], [3, 1], [5, 0], [7, 1]])

    def likelihood(tables_):
        e = hmm.emissions(dense, one)
        f = np.exp(tables_[0].initial[:, None] + share + e[0])
        for t in range(1, 9):
            own = tables_[which[t]]
            f = (np.exp(own.stay)[:, None] * f + (f.sum(1) @ np.exp(own.move))[:, None] * np.exp(share)) * np.exp(e[t])
        return np.log(f.sum())

    for chain in (hmm._Chain, hmm._LogChain):
        monkeypatch.setattr(hmm, "_Chain", chain)
        found, stats = hmm.rated(cells, {0: one, 1: other}, runs, share)
        assert np.isclose(found, likelihood([one, other])) and np.isclose(hmm.rated(cells, {0: one, 1: other}, runs, share, with_stats=False)[0], found)
        for r, own in enumerate((one, other)):
            for s in range(2):
                slope = hmm.Tables(own.initial, own.stay + 1e-6 * (np.arange(2) == s), own.move, own.emit, own.deme)
                pair = [slope, other] if r == 0 else [one, slope]
                assert (likelihood(pair) - found) / 1e-6 == pytest.approx(stats[r][1][s], abs=1e-3)
            assert stats[r][1].sum() + stats[r][2].sum() == pytest.approx([4, 4][r])
        assert sum(x[0].sum() for x in stats.values()) == pytest.approx(1)


def test_missing_alleles_are_put_in(spark):
    """Complete sites give what they gave; where a trunk's haplotype lacks its allele, the other one's allele, seen through its
    own tables, stands in; where the additional one lacks it, the locus tells nothing."""
    from popspark.jobs.inference import prepared_from_sites
    from popspark.operators.likelihood import code_tensors

    kinds = "chunk int, pos long, alleles array<int>"
    members = spark.createDataFrame([(0,), (1,), (2,)], "hap int")
    model = Model(parse_demography(ONE), PARAMS, dict.fromkeys(range(3), 0), 1, loci=10, interval_params=[2, 0.1, 1], style="simple")
    whole = spark.createDataFrame([(0, p, [p % 2, p // 2 % 2, 1]) for p in range(25)], kinds)
    both = [likelihoods(prepared_from_sites(whole, csd.leave_one_out(members), model, 2, impute=x), model, {0: [1.0, 2.0], 1: [0.5, 0.7]}) for x in (False, True)]
    plain, same = ({r.particle_id: r.loglik for r in x.collect()} for x in both)
    assert plain == pytest.approx(same)
    holes = spark.createDataFrame([(0, 0, [1, 0, None])], kinds)
    tensors = code_tensors(holes, csd.leave_one_out(members), 10, impute=True)
    data = prepared_from_sites(holes, csd.leave_one_out(members), model, 2, impute=True)
    from popspark.jobs.inference import _evaluated, made_tables

    found = made_tables(spark, model, {0: [1.0, 2.0]}, data.keys)
    got = {r.csd: r.loglik for r in _evaluated(data, model, found, {0: [1.0, 2.0]}).collect()}
    two, one = model.tables([1.0, 2.0], [((2,), 0), ((1,), 0)]).values()
    stand_in = lambda b: hmm.imputed_alleles(np.eye(2, dtype=int)[[b]], one)
    want = lambda a, b: np.exp(two.initial) @ (np.exp(two.emit)[:, b, a] + np.exp(two.emit)[:, :, a] @ stand_in(b)) / 2
    assert got == pytest.approx({0: np.log(want(1, 0)), 1: np.log(want(0, 1)), 2: 0.0})
    assert stand_in(0).sum() == pytest.approx(1) and stand_in(0)[0] > 0.5 and tensors.first().codes is not None
    with pytest.raises(ValueError, match="likelihoods alone"):
        e_step(data, model, [1.0, 2.0])
