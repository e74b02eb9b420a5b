"""Inference jobs: likelihoods of points, expectation-maximization, and a genetic search over start points."""

from __future__ import annotations

import ast
import pickle
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.model import hmm
from popspark.model.cores import made
from popspark.model.intervals import boundaries
from popspark.operators import csd as C
from popspark.operators.likelihood import Key, across_contigs, chunk_likelihood, code_tensors, evaluated, rate_of, rate_runs, step_tensors, summed_stats, table_key, with_rates
from popspark.shared import cut
from popspark.shipping import ship
from popspark.sources.models import Params, Template, bound, uniform, with_least_migration

Limits = list[tuple[float, float]]


@dataclass
class Model:
    """What a likelihood needs beside the data: a template, rates, hidden intervals, and where the sample's members live.

    demes: the deme of each member of the sample. haps: which haplotype each member is, where they are not numbered alike
    (copies of a haplotype, or one in several demes, are members of their own). A point has the template's coordinates and,
    with ``scale_recombination`` and ``estimate_theta``, the factor of the recombination rate and the mutation rate after them.
    """

    template: Template
    params: Params
    demes: dict[int, int]
    n_demes: int
    loci: int = 1
    interval_type: str = "loguniform"
    interval_params: list[float] | str = field(default_factory=lambda: [8, 0.01, 4])
    style: str = "migratingethan"
    least_migration: float = 0.005
    limits: Limits | None = None
    per_piece: int = 12
    haps: dict[int, int] | None = None
    scale_recombination: bool = False
    estimate_theta: bool = False
    objective: str = "lineage"
    cake: str = "average"
    core: str = "auto"

    def at(self, point: list[float]) -> tuple[list[float], Params]:
        """The demography's part of a point, and the rates there."""
        rest, params = list(point), self.params
        if self.estimate_theta:
            params = replace(params, theta=rest.pop())
        if self.scale_recombination:
            params = replace(params, rho=params.rho * rest.pop())
        return rest, params

    def tables(self, point: list[float], keys: list[Key]) -> dict[Key, hmm.Tables] | None:
        """Tables of each kind of CSD at a point; None where the point makes no demography."""
        if self.limits and any(not low <= x <= high for x, (low, high) in zip(point, self.limits, strict=True)):
            return None
        rest, params = self.at(point)
        epochs = bound(with_least_migration(self.template, params, self.least_migration), rest, halve_migration=self.style != "simple")
        if epochs is None or params.theta <= 0 or params.rho <= 0:
            return None
        out = {}
        for k in keys:
            bounds = boundaries(self.interval_type, self.interval_params, epochs, np.array(k[0]), k[1])
            own = replace(params, rho=params.rho * rate_of(k[2])) if len(k) > 2 else params
            out[k] = made(self.core, epochs, bounds, np.array(k[0]), k[1], own, self.loci, self.style, cake=self.cake, per_piece=self.per_piece)
        return out


@dataclass
class Data:
    """Packed counts of each CSD, kept for all evaluations, the kinds of CSD there are, whether permutations are summed once over
    all contigs, whether steps without counts are skipped, and how many rows (CSDs by contigs) there are."""

    tensors: DataFrame
    keys: list[Key]
    n_alleles: int
    together: bool = False
    skip: bool = False
    rows: int = 0
    impute: bool = False

    def groups(self, particles: int, abreast: int) -> int:
        """In how many parts to evaluate so many particles of which ``abreast`` cost little more than one: as many as keep all
        cores busy."""
        cores = self.tensors.sparkSession.sparkContext.defaultParallelism
        return max(1, min(-(-particles // abreast), -(-2 * cores // max(self.rows, 1))))

    def combined(self, rows: DataFrame) -> DataFrame:
        """(particle_id, loglik) of evaluated CSDs."""
        return (across_contigs if self.together else contigs_apart)(rows)


def contigs_apart(rows: DataFrame) -> DataFrame:
    """Permutations summed contig by contig."""
    return chunk_likelihood(rows, ["particle_id"]).groupBy("particle_id").agg(F.sum("loglik").alias("loglik"))


def prepared(counts: DataFrame, csds: DataFrame, model: Model, n_alleles: int, still: DataFrame | None = None, lengths: DataFrame | None = None, together: bool = False, skip: bool = False, missing: DataFrame | None = None) -> Data:
    """The counts are joined to their CSDs once and written to the shared checkpoint folder; each evaluation reads them there.

    With ``skip``, counts are those of segregating loci, a locus a step, and all others are jumped over but for ``missing``
    runs (chunk, start, n), which tell nothing.
    """
    return _kept(step_tensors(counts, csds, still, lengths, model.haps, missing), csds, (lengths or counts).select("chunk"), model, n_alleles, together, skip)


def prepared_from_sites(sites: DataFrame, csds: DataFrame, model: Model, n_alleles: int, still: DataFrame | None = None, lengths: DataFrame | None = None, together: bool = False, skip: bool = False, missing: DataFrame | None = None, rates: DataFrame | None = None, impute: bool = False) -> Data:
    """As ``prepared``, from sites (chunk, pos, alleles), whose pairs are counted in tasks: what travels follows the number of
    haplotypes in the CSDs, not that of their pairs. rates: a map (chunk, start, end, rate) of factors of the recombination rate
    along contigs. impute: sites that lack alleles count, with what the other haplotypes make likely in their place; then there
    are likelihoods only.
    """
    if impute and (skip or rates is not None):
        raise ValueError("missing alleles are put in with one rate and without skipping")
    tensors = code_tensors(sites, csds, model.loci, still, lengths, model.haps, missing, impute)
    tensors = tensors if rates is None else with_rates(tensors, rate_runs(rates, model.loci))
    return replace(_kept(tensors, csds, (lengths or sites).select("chunk"), model, n_alleles, together, skip), impute=impute)


def _kept(tensors: DataFrame, csds: DataFrame, chunks: DataFrame, model: Model, n_alleles: int, together: bool, skip: bool) -> Data:
    if skip and (model.loci != 1 or not uniform(model.params.matrix)):
        raise ValueError("loci can be skipped where a step is one locus and the mutation matrix is uniform")
    # A partition for each CSD, up to a few for each core, so that no task has several of them while cores are idle.
    parts = max(1, min(csds.count() * chunks.distinct().count(), 4 * tensors.sparkSession.sparkContext.defaultParallelism))
    tensors = cut(tensors.repartition(parts))
    kinds = tensors.where(F.size("trunk") > 0).select("add", "trunk").distinct()
    # A row for each CSD of the likelihood, none for each locus or contig.
    keys = sorted({table_key(r["add"], r["trunk"], model.demes, model.n_demes) for r in kinds.toLocalIterator()})
    if "rates" in tensors.columns:
        # A row for each rate that there is, of those that are not alike.
        ids = [r["id"] for r in tensors.select("rates").distinct().select(F.explode("rates.id").alias("id")).distinct().toLocalIterator()]
        keys = [(*k, i) for k in keys for i in sorted(ids)]
    return Data(tensors, keys, n_alleles, together, skip, tensors.count())


#: Particles that one job evaluates; each of their tables is a few hundred numbers.
WAVE = 64
#: Particles whose likelihoods cost about as much as that of one.
ABREAST = 16
#: Particles up to which the driver makes tables and M-steps itself, instead of in tasks.
OWN = 1


def made_tables(spark: SparkSession, model: Model, points: dict[int, list[float]], keys: list[Key]) -> dict[int, dict[Key, hmm.Tables]]:
    """Tables of each kind of CSD at each point that makes a demography: a task for each point and kind, whose result is a few
    hundred numbers."""
    if len(points) <= OWN:
        own = {i: model.tables(p, keys) for i, p in points.items()}
        return {i: t for i, t in own.items() if t is not None}
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, ids, kinds = (batch.column(c).to_pylist() for c in ("place", "particle_id", "kind"))
            packed = [pickle.dumps(model.tables(points[i], [keys[k]])) for i, k in zip(ids, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(packed, pa.binary())], ["place", "packed"])

    tasks = [(i, k) for i in points for k in range(len(keys))]
    rows = spark.createDataFrame([(n, *x) for n, x in enumerate(tasks)], "place long, particle_id long, kind int")
    out: dict[int, dict[Key, hmm.Tables]] = {}
    # A row for each point and kind of a wave.
    for r in rows.repartitionById(len(tasks), F.col("place").cast("int")).mapInArrow(run, "place long, packed binary").collect():
        if (found := pickle.loads(r["packed"])) is not None:
            out.setdefault(tasks[r["place"]][0], {}).update(found)
    return out


def _evaluated(data: Data, model: Model, found: dict[int, dict[Key, hmm.Tables]], points: dict[int, list[float]], with_stats: bool = False) -> DataFrame:
    still = {i: hmm.stationary(model.at(points[i])[1].matrix) for i in found}
    groups = data.groups(len(found), 1 if with_stats or data.skip else ABREAST)
    return evaluated(data.tensors, found, model.demes, model.n_demes, data.n_alleles, with_stats=with_stats, stationary=still, skip=data.skip, groups=groups, tables_of=_TablesOf(model, points) if data.impute else None)


class _TablesOf:
    """Tables of a kind of CSD at a particle's point, made once in a task."""

    def __init__(self, model: Model, points: dict[int, list[float]]):
        self.model, self.points, self.made = model, points, {}

    def __call__(self, particle: int, key: Key) -> hmm.Tables:
        if (particle, key) not in self.made:
            self.made[particle, key] = self.model.tables(self.points[particle], [key])[key]
        return self.made[particle, key]


def likelihoods(data: Data, model: Model, points: dict[int, list[float]]) -> DataFrame:
    """(particle_id, loglik) of points; those that make no demography have none.

    A task unpacks the counts of a CSD once and evaluates all particles of a wave on them. Points come in waves of WAVE, so a
    plan does not grow with their number; the result has a row for each.
    """
    spark = data.tensors.sparkSession
    out: list[tuple[int, float]] = []
    ids = list(points)
    for at in range(0, len(ids), WAVE):
        found = made_tables(data.tensors.sparkSession, model, {i: points[i] for i in ids[at : at + WAVE]}, data.keys)
        if found:
            out += [(r["particle_id"], r["loglik"]) for r in data.combined(_evaluated(data, model, found, points)).collect()]
    return spark.createDataFrame(out, "particle_id long, loglik double")


Stats = dict[Key, tuple[np.ndarray, ...]]


def e_steps(data: Data, model: Model, points: dict[int, list[float]]) -> dict[int, tuple[float, Stats]]:
    """For each particle, the log-likelihood and the summed expected counts of each kind of CSD: one job a wave, whose result
    has a row for each entry of the tables, whatever the size of the data."""
    out: dict[int, tuple[float, Stats]] = {i: (float("-inf"), {}) for i in points}
    for logliks, sums in _counted(data, model, points):
        stats: dict[int, list[dict]] = {}
        for r in sums.collect():
            stats.setdefault(r["particle_id"], []).append(r.asDict())
        out |= {i: (value, _shaped(stats.get(i, []), data.n_alleles)) for i, value in logliks.items()}
    return out


def _counted(data: Data, model: Model, points: dict[int, list[float]]) -> Iterator[tuple[dict[int, float], DataFrame]]:
    """Wave by wave, the log-likelihood of each particle that makes a demography, and the summed expected counts as rows
    (particle_id, key, kind, place, value)."""
    ids = list(points)
    for at in range(0, len(ids), WAVE):
        found = made_tables(data.tensors.sparkSession, model, {i: points[i] for i in ids[at : at + WAVE]}, data.keys)
        if found:
            rows = cut(_evaluated(data, model, found, points, with_stats=True))
            yield {r["particle_id"]: r["loglik"] for r in data.combined(rows).collect()}, summed_stats(rows, together=data.together)


def _shaped(rows: list[dict], n_alleles: int) -> Stats:
    """The counts of one particle's kinds of CSD, from a row for each number."""
    by: dict[str, dict[str, dict[int, float]]] = {}
    for r in rows:
        by.setdefault(r["key"], {}).setdefault(r["kind"], {})[r["place"]] = r["value"]
    out = {}
    for key, own in sorted(by.items()):
        s = len(own["initial"])
        shapes = {"initial": (s,), "stay": (s,), "move": (s, s), "emit": (s, n_alleles, n_alleles), "own": (s,)}
        out[ast.literal_eval(key)] = tuple(np.array([own[k][x] for x in range(int(np.prod(shape)))]).reshape(shape) for k, shape in shapes.items())
    return out


def m_steps(sums: DataFrame, data: Data, model: Model, points: dict[int, list[float]], iterations: int, **options: object) -> dict[int, list[float]]:
    """The next point of each particle, from rows of summed expected counts: each particle's M-step is a task, and only its
    point comes back."""
    ship(sums.sparkSession)
    n_alleles = data.n_alleles

    def run(table: pa.Table) -> pa.Table:
        i = table.column("particle_id")[0].as_py()
        point = m_step(_shaped(table.to_pylist(), n_alleles), model, points[i], iterations, **options)
        return pa.table({"particle_id": pa.array([i], pa.int64()), "point": pa.array([point], pa.list_(pa.float64()))})

    # More partitions than particles, so that hardly two share one, and a number that is not coalesced.
    own = sums.where(F.col("particle_id").isin(list(points))).repartition(4 * len(points), "particle_id")
    return {r["particle_id"]: r["point"] for r in own.groupBy("particle_id").applyInArrow(run, "particle_id long, point array<double>").collect()}


def e_step(data: Data, model: Model, point: list[float]) -> tuple[float, Stats]:
    """The log-likelihood and the summed expected counts at one point."""
    return e_steps(data, model, {0: point})[0]


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, fraction: float, iterations: int, spread: float | None = None) -> tuple[np.ndarray, float]:
    """The least value near start: reflection 1, expansion 2, contraction and shrinkage one half. It ends after so many
    iterations, or where the values of the simplex are within the relative ``spread`` of each other."""
    simplex = [(f(start), start)]
    for i in range(len(start)):
        x = start.copy()
        x[i] = max(1e-8, x[i] * (1 + fraction))
        simplex.append((f(x), x))
    for _ in range(iterations):
        simplex.sort(key=lambda p: p[0])
        if spread is not None and abs(simplex[-1][0] - simplex[0][0]) <= spread * max(abs(simplex[0][0]), 1e-300):
            break
        worst = simplex[-1]
        centre = np.mean([p[1] for p in simplex[:-1]], 0)
        at = lambda k: (f(x := centre + k * (centre - worst[1])), x)  # noqa: B023, E731
        new = at(1.0)
        if new[0] < simplex[0][0]:
            far = at(2.0)
            simplex[-1] = min(new, far, key=lambda p: p[0])
        elif new[0] < simplex[-2][0]:
            simplex[-1] = new
        else:
            near = at(0.5 if new[0] < worst[0] else -0.5)
            if near[0] < min(new[0], worst[0]):
                simplex[-1] = near
            else:
                best = simplex[0][1]
                simplex = [simplex[0], *((f(x := (p[1] + best) / 2), x) for p in simplex[1:])]
    return min(simplex, key=lambda p: p[0])[::-1]


def m_step(stats: Stats, model: Model, point: list[float], iterations: int, fraction: float = 0.2, coordinatewise: bool = True, order: list[int] | None = None, spread: float | None = None) -> list[float]:
    """A point with a higher expected log-likelihood. Only the summed counts are used; no job runs."""
    seen: dict[tuple[float, ...], float] = {}

    def loss(x: np.ndarray) -> float:
        key = tuple(float(v) for v in x)
        if key not in seen:
            found = model.tables(list(key), list(stats)) if min(key) > 0 else None
            seen[key] = float("inf") if found is None else -sum(hmm.gain(s, found[k], k[0], model.objective) for k, s in stats.items())
        return seen[key]

    x = np.array(point, float)
    if not coordinatewise:
        return nelder_mead(loss, x, fraction, iterations, spread)[0].tolist()
    for i in order or range(len(x)):
        def along(v: np.ndarray, i: int = i) -> float:
            y = x.copy()
            y[i] = v[0]
            return loss(y)

        value, got = nelder_mead(along, x[i : i + 1], fraction, iterations, spread)
        if got < loss(x):
            x[i] = value[0]
    return x.tolist()


def em_runs(data: Data, model: Model, starts: dict[int, list[float]], iterations: int, m_iterations: int, tolerance: float | None = None, change: float | None = None, **options: object) -> dict[int, list[dict]]:
    """The path of each particle: a row for each E-step, the last one without an M-step. A particle stops where its
    likelihood is minus infinity, where its relative rise is below ``tolerance``, or where no coordinate has changed by more
    than the relative ``change``. The E-steps of all particles that go on are one job a wave."""
    paths: dict[int, list[dict]] = {i: [] for i in starts}
    points = {i: list(p) for i, p in starts.items()}
    for step in range(iterations + 1):
        began = time.time()
        waves = list(_counted(data, model, points)) if iterations else [(_values(data, model, points), None)]
        took = int(1000 * (time.time() - began))
        after = {}
        for logliks, sums in waves:
            going = {}
            for i in logliks:
                paths[i].append({"em_step": step, "point": list(points[i]), "loglik": logliks[i], "ms": took})
                if logliks[i] != float("-inf") and step < iterations and not _settled(paths[i], tolerance, change):
                    going[i] = points[i]
            if len(going) > OWN:
                after |= m_steps(sums, data, model, going, m_iterations, **options)
            elif going:
                rows = [r.asDict() for r in sums.where(F.col("particle_id").isin(list(going))).collect()]
                for i, p in going.items():
                    after[i] = m_step(_shaped([r for r in rows if r["particle_id"] == i], data.n_alleles), model, p, m_iterations, **options)
        for i in points:
            if len(paths[i]) <= step:
                paths[i].append({"em_step": step, "point": list(points[i]), "loglik": float("-inf"), "ms": took})
        if not after:
            break
        points = {i: after[i] for i in points if i in after}
    return paths


def _settled(path: list[dict], tolerance: float | None, change: float | None) -> bool:
    """Whether the last step of a path changed so little that it ends."""
    if len(path) < 2:
        return False
    before, now = path[-2:]
    if tolerance and abs(now["loglik"] - before["loglik"]) < tolerance * abs(before["loglik"]):
        return True
    return bool(change) and max(abs(x - y) / max(abs(y), 1e-300) for x, y in zip(now["point"], before["point"], strict=True)) < change


def _values(data: Data, model: Model, points: dict[int, list[float]]) -> dict[int, float]:
    got = {r["particle_id"]: r["loglik"] for r in likelihoods(data, model, points).collect()}
    return {i: got.get(i, float("-inf")) for i in points}


def em(data: Data, model: Model, start: list[float], iterations: int, m_iterations: int, tolerance: float | None = None, **options: object) -> list[dict]:
    """The path of one run."""
    return em_runs(data, model, {0: start}, iterations, m_iterations, tolerance, **options)[0]


def random_starts(limits: Limits, n: int, seed: int) -> list[list[float]]:
    """Points that are uniform in the logarithm of each coordinate, inside positive limits."""
    low, high = np.log(np.array(limits, float)).T
    return np.exp(np.random.default_rng(seed).uniform(low, high, (n, len(limits)))).tolist()


def offspring(best: list[list[float]], n: int, limits: Limits, random: np.random.Generator, stretch: float = 0.25, disperse: float = 1.0, if_zero: float = 0.2) -> list[list[float]]:
    """The next generation: the best as they are, then mutants of them, by Gaussian steps of the best ones' spread (a fifth of
    the value where they agree) or, for a share of ``stretch``, by one factor for all coordinates; reflected at the limits."""
    sd = np.std(best, axis=0)
    out = [list(p) for p in best[:n]]
    while len(out) < n:
        parent = np.array(best[random.integers(len(best))])
        if random.random() < stretch:
            spread = np.exp(np.mean(np.log(np.where(sd < 1e-5, if_zero * parent, sd) / parent)))
            child = parent * np.exp(random.normal() * spread)
        else:
            child = parent + random.normal(size=len(parent)) * disperse * np.where(sd < 1e-5, if_zero * parent, sd)
        for i, (low, high) in enumerate(limits):
            for _ in range(50):
                if low <= child[i] <= high:
                    break
                child[i] = 2 * (low if child[i] < low else high) - child[i]
            child[i] = min(max(child[i], low), high)
        out.append(child.tolist())
    return out


def genetic(data: Data, model: Model, starts: list[list[float]], generations: int, keep: int, seed: int, em_iterations: int = 0, m_iterations: int = 10, em_options: dict | None = None, **options: object) -> list[dict]:
    """Generations of particles, each of which goes through expectation-maximization; rows of all E-steps of all particles.

    A generation's best particles, by their last likelihood, have the next one as offspring. With no EM iterations, particles
    get a likelihood only.
    """
    if generations > 1 and (len(starts) < 2 or not 0 < keep <= len(starts)):
        raise ValueError("generations need two start points at least, and how many of them to keep")
    random, points, rows = np.random.default_rng(seed), starts, []
    for generation in range(generations):
        paths = em_runs(data, model, dict(enumerate(points)), em_iterations, m_iterations, **(em_options or {}))
        rows += [{"generation": generation, "particle_id": i, **r} for i, path in paths.items() for r in path]
        ranked = sorted(((-path[-1]["loglik"], i, path[-1]["point"]) for i, path in paths.items()), key=lambda x: x[:2])
        if generation < generations - 1:
            points = offspring([p for _, _, p in ranked[:keep]], len(points), model.limits or [], random, **options)
    return rows


def csds_of(kind: str, members: DataFrame, perms: DataFrame | None = None, sizes: int | None = None, lists: DataFrame | None = None) -> DataFrame:
    """The CSDs of a composite likelihood by name, in any case: lol, pcl, pclol, pac, oldpac (the same CSDs as pac), superpac,
    or file. members (hap): the members of the sample. sizes: how many trunk sizes of a permutation to use."""
    kind = kind.lower()
    if (kind in ("pac", "oldpac", "superpac")) != (perms is not None):
        raise ValueError("pac, oldpac and superpac need permutations, and the others take none")
    match kind:
        case "lol":
            return C.leave_one_out(members)
        case "pcl":
            return C.pairwise(members)
        case "pclol":
            return C.pairwise_and_leave_one_out(members)
        case "pac" | "oldpac":
            return C.permuted(perms, wanted=sizes)
        case "superpac":
            return C.one_list(perms, wanted=sizes)
        case "file" if lists is not None:
            return C.listed(lists)
    raise ValueError(f"no composite likelihood of these data is called {kind}")
