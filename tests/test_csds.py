"""CSDs of many haplotypes: what goes through joins and shuffles, and what comes out."""

from pyspark.sql import functions as F

from popspark.jobs.inference import csds_of
from popspark.operators import csd


def test_superpac_joins_no_trunks(spark):
    """The numbers are there before the trunks, so no join sends these to the driver or through a shuffle."""
    perms = spark.range(3).select(F.col("id").alias("perm"), F.sequence(F.lit(0), F.col("id") + 4).alias("ord"))
    got = csds_of("superpac", spark.range(7), perms)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("AS trunk") < plan.index("Join")
    want, number = [], 0
    for n in (5, 6, 7):
        for rank in range(n):
            number += 1
            want.append((0, number, n - 1 - rank, list(range(n - 1, n - 1 - rank, -1))))
    assert sorted((r.perm, r.csd, r["add"], r.trunk) for r in got.collect()) == want


def test_superpac_in_pieces(spark, monkeypatch):
    """Pieces that are dealt out give the same list as one, with and without a choice of sizes."""
    perms = spark.range(4).select(F.col("id").alias("perm"), F.sequence(F.lit(0), F.col("id") * 3 + 1).alias("ord"))
    for sizes in (None, [0, 4, 7]):
        kept = sorted((r.perm, r.csd, r["add"], r.trunk) for r in csd.permuted(perms, sizes=sizes).collect())
        want = [(0, i + 1, *r[2:]) for i, r in enumerate(kept)]
        for piece in (1, 3, 256):
            monkeypatch.setattr(csd, "PIECE", piece)
            monkeypatch.setattr(csd, "TASK", 10)
            assert sorted((r.perm, r.csd, r["add"], r.trunk) for r in csd.one_list(perms, sizes=sizes).collect()) == want


def left_out(rows):
    """What left_out_by_group gives, by the definition: every row against every row of its group."""
    found = {}
    for g, hap, m in rows:
        if g is None or hap is None or not m or m < 1:
            continue
        for g2, other, n in rows:
            if g2 == g and other is not None and n and n - (other == hap) > 0:
                found.setdefault((g, hap, m), []).append((other, n - (other == hap)))
    return sorted((*k, " ".join(f"{o}:{n}" for o, n in sorted(v)), sum(n for _, n in v)) for k, v in found.items())


def test_left_out_is_shared_out(spark, monkeypatch):
    """No row for each pair is made, and trunks are made by several tasks."""
    monkeypatch.setattr(csd, "TASK", 1_000, raising=False)
    monkeypatch.setattr(csd, "PIECE", 8, raising=False)
    rows = [(1, h, h % 3 + 1) for h in range(-40, 60)] + [(2, 7, 1), (3, 7, 2), (4, 1, 1), (4, 10, 2)]
    got = csd.left_out_by_group(spark.createDataFrame(rows, "chunk int, hap long, multiplicity long").coalesce(1), "chunk")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 60
    assert sorted(map(tuple, got.collect())) == left_out(rows)


def test_left_out_with_repeats(spark):
    """Rows that repeat a haplotype count one by one on both sides; those without a group, haplotype or copies do not."""
    rows = [(1, 5, 2), (1, 5, 2), (1, 6, 1), (1, 6, 1), (1, 6, 3), (1, 12, 4), (1, 70, 0), (None, 5, 2), (1, None, 2), (1, 80, None), (2, 5, 1), (2, 5, 1), (3, 9, 1)]
    got = csd.left_out_by_group(spark.createDataFrame(rows, "chunk int, hap long, multiplicity long"), "chunk")
    assert sorted(map(tuple, got.collect())) == left_out(rows)


def test_pairs_are_shared_out(spark, monkeypatch):
    """The pairs of one large group are made by several tasks, each pair once; repeated haplotypes count one by one."""
    monkeypatch.setattr(csd, "TASK", 1_000, raising=False)
    monkeypatch.setattr(csd, "BLOCK", 16, raising=False)
    rows = [(1, h) for h in range(-30, 70)] + [(1, 5)] * 20 + [(2, 7), (3, 7), (3, 7), (4, 1), (4, 2), (None, 1), (None, 2), (1, None)]
    haps = spark.createDataFrame(rows, "chunk int, hap long").coalesce(1)
    got = csd.pairs_by_group(haps, "chunk")
    assert got.columns == ["chunk", "add", "trunk", "factor"]
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 5_000
    want = sorted((g, a, [b], 1.0) for g, a in rows for h, b in rows if g == h and g is not None and a is not None and b is not None and a != b)
    assert sorted(map(tuple, got.collect())) == want
    texts = csd.pairs_by_group(haps, "chunk", F.lit(0.5), F.col("hap").cast("string"))
    assert sorted(map(tuple, texts.collect())) == sorted((g, a, [str(b)], 0.5) for g, a, (b,), _ in want)


def test_no_haplotypes(spark):
    """Empty tables give empty lists."""
    none = spark.createDataFrame([], "chunk int, hap long, multiplicity long")
    assert csd.pairs_by_group(none, "chunk").count() == csd.left_out_by_group(none, "chunk").count() == 0
    assert csd.one_list(spark.createDataFrame([], "perm int, ord array<long>")).count() == 0
