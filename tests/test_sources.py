"""Files to sites, layouts and models: a small study whose results were worked out by hand."""

import pytest
from pyspark.sql import functions as F

from popspark.operators import blocks, csd, sites, variants
from popspark.sources import layout as L
from popspark.sources import models as M
from popspark.sources import text as T
from popspark.sources import vcf as VCF

VARIANTS = """##fileformat=test
#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT A B C D
1 5 . T . 36 . . GT ./. ./. ./. ./.
1 7 . G T 58 . . GT 0|1 1/1 1|0 0/0
1 8 . G A 98 . . GT 0|1 1|1 1|1 0|0
1 15 . A . 72 . . GT 0/0 0/0 0/0 0/0
"""
BASES = ">contig\nNACNTAGG\nGNNACCANAAC\n"
EIGHT = "20 2 1\n" + "1\n" * 8


@pytest.fixture
def study(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


def ingest(spark, study, variants_text=VARIANTS, layout=EIGHT, **options):
    return VCF.ingest(spark, [study("a.vcf", variants_text)], [study("a.fa", BASES)], L.parse_layout(layout), ".", **options)


def test_sites(spark, study):
    got = ingest(spark, study)
    assert sorted((r.pos, r.alleles) for r in got.sites.collect()) == [(6, [0, 1, 1, 1, 1, 0, 0, 0]), (7, [0, 1, 1, 1, 1, 1, 0, 0])]
    reference = {r.pos: r.allele for r in got.reference.collect()}
    assert sorted(p for p, a in reference.items() if a is None) == [0, 3, 4, 9, 10, 15]
    assert len(reference) == 17 and {a for a in reference.values()} == {0, None}


def test_blocks(spark, study):
    got = ingest(spark, study)
    still = blocks.still_counts(got.reference, 3)
    assert [r.n for r in still.orderBy("step").collect()] == [2, 1, 1, 1, 3, 2, 1]
    pairs = blocks.all_counts(blocks.pair_counts(got.sites, 3), still, list(range(8)))
    cells = {(r.add, r.trunk, r.a, r.b): r.n for r in pairs.where("step = 2").collect()}
    want = {(0, 1): (1, 2, 0, 0), (1, 0): (1, 0, 2, 0), (1, 2): (1, 0, 0, 2), (4, 5): (1, 0, 1, 1), (0, 7): (3, 0, 0, 0)}
    for (add, trunk), counts in want.items():
        assert tuple(cells.get((add, trunk, a, b), 0) for a in (0, 1) for b in (0, 1)) == counts
    assert blocks.step_count(19, 3) == 7 and blocks.step_count(19, 4) == 5


def test_projection(spark, study):
    two = "20 2 2\n1 0\n1 0\n0 1\n0 1\n" + "0 0\n" * 4
    got = ingest(spark, study, layout=two)
    assert [r.alleles for r in got.sites.orderBy("pos").collect()] == [[0, 1, 1, 1]] * 2
    assert [r.n for r in blocks.still_counts(got.reference, 4).orderBy("step").collect()] == [2, 1, 2, 3, 3]


def test_mask_and_filter(spark, study):
    mask = study("m.bed", "1\t6\t7\n1\t12\t14\n")
    got = ingest(spark, study, mask=[mask])
    assert [r.pos for r in got.sites.collect()] == [7]
    reference = {r.pos: r.allele for r in got.reference.collect()}
    assert reference[6] is None and reference[12] is None and reference[13] is None and reference[14] == 0
    failed = ingest(spark, study, VARIANTS.replace("98 .", "98 low"))
    assert [r.pos for r in failed.sites.collect()] == [6]
    assert {r.pos: r.allele for r in failed.reference.collect()}[7] is None


@pytest.mark.parametrize(
    "change",
    [("0|1 1/1", "0/1 1/1"), ("G T 58", "GG T 58"), ("58 . . GT", "58 . . GT:DP"), ("G T 58", "G G 58"), ("1 8 .", "1 7 ."), (" 0|0\n1 15", "\n1 15"), ("1 7 . G", "1 7 . C"), ("1 15 .", "1 99 .")],
)
def test_errors(spark, study, change):
    layout = EIGHT if change[0] != "G T 58" or change[1] != "G G 58" else EIGHT.replace("20 2", "20 4")
    with pytest.raises(Exception, match="unphased|kind|two lines|wide|REF is not|outside"):
        got = ingest(spark, study, VARIANTS.replace(*change), layout)
        # A line's errors show in the output that reads it.
        got.sites.collect()
        got.reference.collect()


def test_guards(spark, study):
    """What an ingest refuses: masks out of order, rising positions, headers, letters, a matrix, a study without sites."""
    with pytest.raises(ValueError, match="mask"):
        ingest(spark, study, mask=[study("m.bed", "1\t6\t9\n1\t8\t14\n")])
    with pytest.raises(ValueError, match="mask"):
        ingest(spark, study, mask=[study("n.bed", "1\t12\t14\n1\t6\t7\n")])
    lines = VARIANTS.splitlines()
    with pytest.raises(ValueError, match="order"):
        ingest(spark, study, "\n".join([*lines[:2], lines[4], lines[3], lines[5]]) + "\n")
    with pytest.raises(ValueError, match="no segregating"):
        ingest(spark, study, "\n".join([*lines[:3], lines[5]]) + "\n")
    with pytest.raises(Exception, match="header"):
        ingest(spark, study, VARIANTS.replace("REF ALT", "ALT REF"))
    with pytest.raises(Exception, match="base of a reference"):
        VCF.ingest(spark, [study("a.vcf", VARIANTS)], [study("z.fa", BASES.replace("CCA", "C*A"))], L.parse_layout(EIGHT), ".").reference.collect()
    with pytest.raises(ValueError, match="uniform"):
        ingest(spark, study, params=M.parse_params("0.1\n0.1\n0.5 0.5\n1 0\n"))
    assert ingest(spark, study, params=M.parse_params("0.1\n0.1\n0 1\n1 0\n")).sites.count() == 2


def test_reference_by_header(spark, study):
    study("own.fa", BASES)
    named = study("h.vcf", VARIANTS.replace("##fileformat=test\n", "##fileformat=test\n##reference=file://own.fa\n"))
    assert VCF.ingest(spark, [named], None, L.parse_layout(EIGHT), ".").sites.count() == 2
    with pytest.raises(ValueError, match="names no reference"):
        VCF.ingest(spark, [study("a.vcf", VARIANTS)], None, L.parse_layout(EIGHT), ".")


def test_blocks_of_a_reference(spark, study, monkeypatch):
    """However a reference is cut into blocks, masks and sites come out at their loci."""
    mask = study("m.bed", "1\t5\t6\n1\t11\t14\n1\t18\t40\n")
    want = None
    for size in (10_000, 4, 7):
        monkeypatch.setattr(variants, "BIN", size)
        got = ingest(spark, study, mask=[mask])
        rows = sorted((r.pos, r.allele) for r in got.reference.collect())
        assert [r.n for r in blocks.still_in_blocks(got.blocks, 3, 2).orderBy("step").collect()] == [r.n for r in blocks.still_counts(got.reference, 3).orderBy("step").collect()]
        assert got.lengths.first().n_loci == 19
        want = want or rows
        assert rows == want and dict(rows)[12] is None and dict(rows)[5] is None and dict(rows)[16] == 0


def test_members(spark):
    layout = L.parse_layout("9 2 2\n1 0\n0 0\n2 1\n")
    assert layout.members == [(0, 0), (1, 0), (1, 0), (1, 1)]
    assert [(r.hap, r.haplotype, r.deme) for r in csd.members(layout.table(spark)).orderBy("hap").collect()] == [(0, 0, 0), (1, 2, 0), (2, 2, 0), (3, 2, 1)]


def test_lookups_in_buckets(spark):
    """Buckets of any size give what one window over everything gives."""
    import random

    from popspark.operators.intervals import as_of, state_offsets
    from popspark.operators.ordered import last_before

    r = random.Random(0)
    rows = [(r.choice("ab"), r.randrange(50), k, None if r.random() < 0.4 else r.randrange(9)) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, x int, tie int, v int")
    changes = df.where("v is not null").dropDuplicates(["k", "x"]).selectExpr("k", "x as t", "v")
    times = df.where("v is null").selectExpr("k", "x as t", "cast(tie as long) as id")
    states = df.dropDuplicates(["k", "x"]).selectExpr("k as chunk", "x as state", "tie as n_haps")
    changes, states = (spark.createDataFrame(d.collect(), d.schema) for d in (changes, states))
    got = {}
    for size in (10**6, 37, 5):
        a = sorted(map(tuple, last_before(df, ["k"], "x", ["tie"], "v", "w", rows=size).collect()), key=repr)
        got[size] = (a, sorted(map(tuple, as_of(times, changes, "k", "v", size).collect()), key=repr), sorted(map(tuple, state_offsets(states, size).collect())))
    assert got[10**6] == got[37] == got[5]
    at = F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, t)")
    for kind in (at, at.cast("date"), at.cast("timestamp")):
        one, other = (as_of(times.withColumn("t", kind), changes.withColumn("t", kind), "k", "v", size).select("k", "id", "v") for size in (10**6, 9))
        assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, other.collect()), key=repr) == sorted(((k, i, v) for k, _, i, v in got[5][1]), key=repr)
    last: dict = {}
    for k, x, tie, v in sorted(rows, key=lambda q: (q[0], q[1], q[2])):
        assert (k, x, tie, v, last.get(k)) in got[5][0]
        last[k] = v if v is not None else last.get(k)


def test_lenient(spark, study):
    got = ingest(spark, study, VARIANTS.replace("0|1 1/1", "0/1 1/1"), phased_only=False)
    assert [None, None, 1, 1, 1, 0, 0, 0] in [r.alleles for r in got.sites.collect()]
    twice = ingest(spark, study, VARIANTS.replace("1 8 .", "1 7 ."), strict_duplicates=False)
    assert [r.pos for r in twice.sites.collect()] == [6]
    with pytest.raises(Exception, match="another number"):
        ingest(spark, study, layout="20 2 1\n" + "1\n" * 7).sites.collect()


def test_reference_bases(spark, study):
    got = VCF.read_lines(spark, [study("a.vcf", VARIANTS)])
    bases = T.read_reference(spark, [study("a.fa", BASES)])
    assert variants.reference_faults(got, bases).count() == 0
    wrong = VCF.read_lines(spark, [study("b.vcf", VARIANTS.replace("1 7 . G", "1 7 . C"))])
    assert [r.pos for r in variants.reference_faults(wrong, bases).collect()] == [6]
    small = T.read_reference(spark, [study("c.fa", BASES)], block=4)
    assert "".join(r.bases for r in small.orderBy("block").collect()) == "NACNTAGGGNNACCANAAC"


def test_mask_faults(spark, study):
    mask = T.read_mask(spark, [study("m.bed", "1 3 9\n1 8 12\n1 20 20\n")])
    assert sorted(r.start for r in variants.mask_faults(mask).collect()) == [8, 20]


def test_sequences(spark, study):
    path = study("s.seq", "# two of three\nACGT\nACGA\nNCGT\n")
    got = VCF.sequences(spark, [path], L.parse_layout("4 4 1\n1\n0\n1\n"))
    assert [r.alleles for r in got.orderBy("pos").collect()] == [[0, None], [1, 1], [2, 2], [3, 3]]
    assert [r.segregating for r in sites.classified(got).orderBy("pos").collect()] == [True, False, False, False]


def test_lists(spark, study):
    got = csd.listed(T.chunked_lines(spark, [study("l.txt", "0 1 2\n2 0\n")])).collect()
    assert [(r.add, r.trunk) for r in got] == [(0, [1, 2]), (2, [0])]
    with pytest.raises(Exception, match="twice"):
        csd.listed(T.chunked_lines(spark, [study("l2.txt", "0 1 1\n")])).collect()
    points = T.read_start_points(spark, study("p.start", "1 2\n3 4\n"), 2)
    assert [r.point for r in points.orderBy("particle_id").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    with pytest.raises(ValueError, match="two points"):
        T.read_start_points(spark, study("q.start", "1 2\n"), 2)


def test_layouts():
    got = L.per_deme([2, 0, 1])
    assert got.used == [0, 1, 2] and [d for _, d in got.members] == [0, 0, 2]
    with pytest.raises(ValueError):
        L.parse_layout("1 2\n1\n")


DEMOGRAPHY = "[ ?0, ?1 ]\n{{0},{1}}\n?2 ?3\nnull\n0 ?6\n?6 0\n{{0,1}}\n?4\nnull\n0\n{{0,1}}\n?5\nnull\n0\n"


def test_demographies():
    t = M.parse_demography(DEMOGRAPHY)
    assert len(t.epochs) == 3 and t.dimension == 7
    e = M.bound(t, [0.1, 0.2, 1, 1, 1, 1, 3.0], halve_migration=True)
    assert e[0].migration == ((-1.5, 1.5), (1.5, -1.5)) and e[2].end == float("inf")
    assert M.bound(t, [0.2, 0.1, 1, 1, 1, 1, 3.0]) is None and M.bound(t, [0.1, 0.2, 0, 1, 1, 1, 3.0]) is None
    assert M.bound(t, [0.1, 0.2, 1, 1, 1, 1, 3.0], [(0, 2)] * 7) is None
    pulsed = M.parse_demography("[?0]\n{{0},{1}}\n1 1\n0 ?1\n0 0\n0 0\n0 0\n{{0,1}}\n1\nnull\n0\n")
    assert len(pulsed.epochs) == 3 and M.bound(pulsed, [0.1, 0.03])[0].pulse == ((0.97, 0.03), (0.0, 1.0))
    grown = M.parse_demography("[?1]\n{{0}}\n?2\nnull\n0\n{{0}}\n1\nnull\n0\n", rates="?0\n0\n")
    assert grown.dimension == 3
    with pytest.raises(ValueError, match="gaps"):
        M.parse_demography("[?1]\n{{0}}\n1\nnull\n0\n{{0}}\n1\nnull\n0\n").dimension
    params = M.parse_params("0.0005\n0.0005\n0 2\n2 0\n")
    raised = M.with_least_migration(M.parse_demography(DEMOGRAPHY.replace("?6", "0").replace("?5", "1")), params)
    assert raised.epochs[0].migration[0][1] == 0.005 * 0.0005


def test_compressed(spark, study):
    layout = L.parse_layout("6 4 1\n1\n1\n0\n")
    one = study("c.txt", "NUM LOCI\n6\nREFERENCE\nAxCGxA\nHAPLOTYPES\nAC\nTN\nGG\n")
    other = study("d.txt", "NUM LOCI\n6\nSEGREGATING SITES\n1 4\nHAPLOTYPES\nAC\nTN\nGG\n")
    for path in (one, other):
        got = VCF.compressed_sequences(spark, path, layout)
        assert [(r.pos, r.alleles) for r in got.orderBy("pos").collect()] == [(1, [0, 3]), (4, [1, None])]


def test_whole_study(spark, study, tmp_path):
    from popspark.jobs.cli import main

    args = {"vcf": study("a.vcf", VARIANTS), "reference": study("a.fa", BASES), "layout": study("a.config", EIGHT), "params": study("a.param", "0.01\n0.01\n0 1\n1 0\n"), "demography": study("a.demo", "[0.2]\n{{0}}\n?0\nnull\n0\n{{0}}\n1\nnull\n0\n")}
    flat = [y for k, v in args.items() for y in (f"--{k}", v)]
    more = ["--filter-pass", ".", "--loci-per-step", "3", "--interval-params", "2,0.1,1", "--likelihood", "lol"]
    main(spark, [*flat, *more, "--start", "1", "--em-iterations", "1", "--m-iterations", "3", "--out", str(tmp_path / "em")])
    path = spark.read.parquet(str(tmp_path / "em")).orderBy("em_step").collect()
    assert len(path) == 2 and path[1].loglik >= path[0].loglik
    study("p.txt", "0 1 2 3 4 5 6 7\n7 6 5 4 3 2 1 0\n")
    study("c.txt", "0 1 2\n3 4\n5\n")
    study("s.txt", "0.8\n1.3\n")
    for kind, extra in (
        ("pac", ["--permutations", str(tmp_path / "p.txt"), "--csds-per-permutation", "3"]), ("oldpac", ["--random-permutations", "3"]),
        ("superpac", ["--random-permutations", "2", "--csds-per-permutation", "2"]), ("file", ["--csd-list", str(tmp_path / "c.txt")]), ("pclol", []),
    ):
        out = str(tmp_path / f"k-{kind}")
        main(spark, [*flat, *more, "--likelihood", kind, *extra, "--starts", str(tmp_path / "s.txt"), "--out", out])
        rows = spark.read.parquet(out).collect()
        assert len(rows) == 2 and all(float("-inf") < r.loglik < 0 for r in rows)
    with pytest.raises(ValueError, match="permutations"):
        main(spark, [*flat, *more, "--likelihood", "pac", "--start", "1", "--out", str(tmp_path / "none")])
    main(spark, [*flat, *more, "--bounds", "0.5,2", "--random-starts", "2", "--generations", "2", "--em-iterations", "1", "--m-iterations", "2", "--text", str(tmp_path / "text"), "--decode", str(tmp_path / "decoded"), "--print-snps", "--out", str(tmp_path / "ga")])
    assert spark.read.parquet(str(tmp_path / "ga")).count() == 8 and spark.read.text(str(tmp_path / "text")).count() == 8
    assert {r.pos for r in spark.read.parquet(str(tmp_path / "decoded")).select("pos").distinct().collect()} == {6, 7}
    main(spark, [*flat, *more, "--bounds", "0.5,2", "--grid", "2", "--out", str(tmp_path / "grid")])
    assert spark.read.parquet(str(tmp_path / "grid")).count() == 2


def test_lines_are_checked_whatever_their_filter(spark, study):
    """Offsets past a line, indels and foreign REFs are errors on lines that fail the filter, too; masked lines may be anything
    inside the reference."""
    head = VARIANTS.splitlines()[1] + "\n"
    for offset, pos in ((1, 1), (2, 1), (5, 3), (0, 21)):
        with pytest.raises(Exception, match="outside the reference"):
            VCF.ingest(spark, [study("a.vcf", f"{head}1 {pos} . N A 36 LOW . GT ./. ./. ./. ./.\n")], [study("a.fa", BASES)], L.parse_layout(EIGHT), ".", offset=offset)
    for ref, message in (("GA", "several bases"), ("J", "no base"), ("C", "not the reference's base")):
        bad = VARIANTS.replace("1 7 . G T 58 .", f"1 7 . {ref} T 58 LOW")
        with pytest.raises(Exception, match=message):
            VCF.ingest(spark, [study("b.vcf", bad)], [study("a.fa", BASES)], L.parse_layout(EIGHT), ".")
    masked = VCF.ingest(spark, [study("b.vcf", bad)], [study("a.fa", BASES)], L.parse_layout(EIGHT), ".", [study("m.bed", "1 6 7\n")])
    assert masked.lines.where("status = 'masked'").count() == 1


def test_study_from_sequences(spark, study, tmp_path):
    """Sequence files of all kinds with the same letters give the same likelihood, and with numbers for each deme as with a layout."""
    from popspark.jobs.cli import main

    rest = ["--params", study("a.param", "0.01\n0.01\n0 1\n1 0\n"), "--demography", study("a.demo", "[0.2]\n{{0}}\n?0\nnull\n0\n{{0}}\n1\nnull\n0\n"), "--interval-params", "2,0.1,1", "--likelihood", "lol", "--start", "1", "--loci-per-step", "2"]
    full = study("f.txt", "AACAAA\nACAAAC\nAAAAAC\n")
    short = study("c.txt", "NUM LOCI\n6\nSEGREGATING SITES\n1 2 5\nHAPLOTYPES\nACA\nCAC\nAAC\n")
    old = study("o.txt", "1 2 5\nACA\nCAC\nAAC\n")
    layout = study("l.config", "6 2 1\n1\n1\n1\n")
    values = []
    for i, kind in enumerate((["--sequences", full, "--layout", layout], ["--compressed", short, "--layout", layout], ["--old-compressed", old, "--layout", layout], ["--sequences", full, "--num-per-deme", "3"])):
        main(spark, [*kind, *rest, "--out", str(tmp_path / f"s{i}")])
        values.append(spark.read.parquet(str(tmp_path / f"s{i}")).first().loglik)
    assert values == pytest.approx([values[0]] * 4) and values[0] < 0
    with pytest.raises(ValueError, match="kind of sequence"):
        main(spark, ["--sequences", full, "--old-compressed", old, "--layout", layout, *rest, "--out", "none"])


def test_rate_maps(spark, study, tmp_path):
    """A map of the rate 1 changes nothing, in likelihoods or EM; three times the rate everywhere is the rate times three."""
    from popspark.jobs.cli import main
    from popspark.operators.likelihood import rate_runs

    lines = "".join("".join("AC"[(h * k + k // 5) % 3 % 2] for k in range(60)) + "\n" for h in range(3))
    base = ["--sequences", study("f.txt", lines), "--num-per-deme", "3", "--demography", study("a.demo", "[0.2]\n{{0}}\n?0\nnull\n0\n{{0}}\n1\nnull\n0\n"), "--interval-params", "2,0.1,1", "--likelihood", "lol", "--start", "1", "--loci-per-step", "5", "--em-iterations", "1", "--m-iterations", "3"]
    slow, fast = study("a.param", "0.01\n0.01\n0 1\n1 0\n"), study("b.param", "0.01\n0.03\n0 1\n1 0\n")
    found = {}
    for name, more in (("plain", [slow]), ("ones", [slow, "--rate-map", study("m.txt", "0 20 1\n31 40 1.00001\n")]), ("threes", [slow, "--rate-map", study("n.txt", "# a map\n0 25 3\n25 60 3\n")]), ("fast", [fast])):
        main(spark, [*base, "--params", *more, "--out", str(tmp_path / name)])
        found[name] = [x for r in spark.read.parquet(str(tmp_path / name)).orderBy("em_step").collect() for x in (r.loglik, *r.point)]
    assert found["ones"] == pytest.approx(found["plain"], rel=1e-7) and found["threes"] == pytest.approx(found["fast"], rel=1e-3)
    assert found["plain"] != pytest.approx(found["fast"], rel=1e-4)
    rates = T.read_rates(spark, [study("r.txt", "7 20 2\n20 22 4\n40 50 2\n")])
    assert sorted((r.first, r.id) for r in rate_runs(rates, 5).collect()) == [(0, 0), (2, 6931), (4, 13863), (5, 0), (8, 6931), (10, 0)]
    for text, message in (("0 5 1\n3 9 1\n", "overlap"), ("0 5\n", "three columns"), ("0 5 0\n", "above 0")):
        with pytest.raises(Exception, match=message):
            rate_runs(T.read_rates(spark, [study("w.txt", text)]), 5).collect()


def test_skipping_from_the_command_line(spark, study, tmp_path):
    """Skipping loci gives what steps of one locus give: likelihood, EM path and decoded states, with masked runs and a site that
    lacks an allele."""
    from popspark.jobs.cli import main

    letters = "".join("ACGT"[(7 * i * i) % 4] for i in range(400))
    lines = [(p, letters[p], "ACGT"["ACGT".index(letters[p]) - 1], g) for p, g in ((3, "0|1 0|0"), (40, "1|1 0|1"), (41, "0|0 1|0"), (170, ".|1 0|1"), (300, "0|1 1|1"), (399, "1|0 0|0"))]
    vcf = "#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT A B\n" + "".join(f"1 {p + 1} . {r} {a} 1 PASS . GT {g}\n" for p, r, a, g in lines)
    args = {"vcf": study("a.vcf", vcf), "reference": study("a.fa", letters[:250] + "\n" + letters[250:310] + "NNNN" + letters[314:] + "\n"), "mask": study("m.bed", "1 100 150\n1 160 165\n"), "layout": study("a.config", "400 2 1\n1\n1\n1\n1\n"), "params": study("a.param", "0.01\n0.01\n0 1\n1 0\n"), "demography": study("a.demo", "[0.2]\n{{0}}\n?0\nnull\n0\n{{0}}\n1\nnull\n0\n")}
    flat = [y for k, v in args.items() for y in (f"--{k}", v)]
    more = ["--interval-params", "2,0.1,1", "--likelihood", "lol", "--start", "1", "--em-iterations", "1", "--m-iterations", "3", "--print-snps", "--print-loci", "50"]
    for name, extra in (("one", ["--loci-per-step", "1"]), ("skip", ["--skip-loci"])):
        main(spark, [*flat, *more, *extra, "--out", str(tmp_path / name), "--decode", str(tmp_path / f"{name}-d")])
    paths = [[(r.em_step, pytest.approx(r.loglik), pytest.approx(r.point)) for r in spark.read.parquet(str(tmp_path / n)).orderBy("em_step").collect()] for n in ("one", "skip")]
    assert len(paths[0]) == 2 and [(a, b.expected, c.expected) for a, b, c in paths[1]] == paths[0]
    states = [{(r.pos, r.csd, r.state): r.probability for r in spark.read.parquet(str(tmp_path / f"{n}-d")).collect()} for n in ("one", "skip")]
    assert {p for p, _, _ in states[0]} == {0, 3, 40, 41, 50, 100, 150, 170, 200, 250, 300, 350, 399} and states[1] == pytest.approx(states[0])
    with pytest.raises(ValueError, match="one locus"):
        main(spark, [*flat, *more, "--skip-loci", "--loci-per-step", "2", "--out", str(tmp_path / "no")])


def test_counters(spark, study):
    got = ingest(spark, study, VARIANTS.replace("98 .", "98 low"))
    assert {r.status: r.n for r in VCF.line_counters(got).collect()} == {"usable": 3, "filter_failed": 1}


def test_lines_in_pieces(spark, tmp_path, monkeypatch):
    """Lines of any length come in pieces with their line and column: letters at the ends of files and lines, files that end
    with a mark or not, comments, empty lines, and a folder whose files break inside a line."""
    texts = ["ACAA\n#A comment\nTTAAG\n\nAC", "A\nA", "TT\n", ">xA\nGGG\n"]
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.txt").write_text(text)
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "part-0").write_text("ACGA")
    (folder / "part-1").write_text("TTA\n#zA\nCA")
    (folder / "part-2").write_text("AC\n")
    paths = [*(str(tmp_path / f"{k}.txt") for k in range(len(texts))), str(folder)]
    want = {}
    for chunk, text in enumerate([*texts, "ACGATTA\n#zA\nCAAC\n"]):
        for row, line in enumerate(x for x in text.split("\n") if x and x[0] not in "#>"):
            want[chunk, row] = line
    got = {}
    for r in T.sequence_pieces(spark, paths).orderBy("chunk", "row", "col").collect():
        assert len(got.get((r.chunk, r.row), "")) == r.col
        got[r.chunk, r.row] = got.get((r.chunk, r.row), "") + r.piece
    assert got == want
    long = "".join("ACGTN"[(i * i + i // 7) % 5] for i in range(5000))
    (tmp_path / "long.txt").write_text(f"{long}\n{long[::-1]}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        pieces = T.sequence_pieces(spark, [str(tmp_path / "long.txt")]).orderBy("row", "col").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ["".join(r.piece for r in pieces if r.row == k) for k in (0, 1)] == [long, long[::-1]] and max(len(r.piece) for r in pieces) < 30


def test_numbers_and_layout_tables(spark, study):
    from popspark.operators.ordered import numbered

    rows = [(k % 3, (k * 37) % 101, k) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, x int, tie int")
    for keys in ([], ["g"]):
        got = {(r.g, r.x, r.tie): r.n for r in numbered(df, keys, "x", ["tie"], "n", rows=40).collect()}
        for g in [None] if not keys else range(3):
            own = sorted((r for r in rows if g is None or r[0] == g), key=lambda r: (r[1], r[2], r[0]))
            assert [got[r] for r in own] == list(range(len(own)))
    assert numbered(df.limit(0), [], "x", [], "n").count() == 0
    table = L.read_layout_table(spark, study("t.config", "# c\n9 2 2\n1 0\n\n2 1\n0 0\n"))
    assert sorted((r.hap, r.multiplicity) for r in table.collect()) == [(0, [1, 0]), (1, [2, 1]), (2, [0, 0])]
    with pytest.raises(Exception, match="each deme"):
        L.read_layout_table(spark, study("u.config", "9 2 2\n1 0\n1\n")).collect()
    same = csd.shuffled(spark.range(40).select(F.col("id").alias("hap")), 3, 9).select("perm", F.posexplode("ord").alias("place", "hap"))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, csd.shuffled_rows(spark.range(40).select(F.col("id").alias("hap")), 3, 9).collect()))


def test_multisets(spark):
    from popspark.operators import multisets

    kinds = "deme int, hap string, multiplicity long"
    one = spark.createDataFrame([(0, "a", 2), (0, "b", 1), (1, "a", 3)], kinds)
    change = spark.createDataFrame([(0, "a", -2), (1, "c", 4), (1, "a", -1)], kinds)
    left = multisets.adjusted(one, change)
    assert sorted(map(tuple, left.collect())) == [(0, "b", 1), (1, "a", 2), (1, "c", 4)]
    assert sorted(map(tuple, multisets.deme_totals(left).collect())) == [(0, 1, 1), (1, 2, 6)]
    with pytest.raises(Exception, match="more often"):
        multisets.adjusted(one, spark.createDataFrame([(0, "b", -2)], kinds)).collect()
    assert multisets.combined(one.limit(0), one).count() == 3
