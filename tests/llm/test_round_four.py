"""Near dedup and components in fewer passes."""

import numpy as np
from pyspark.sql import functions as F

from popspark.llm import near_dedup
from popspark.llm.components import components


def stages_of(spark, name, run):
    """How many stages a run takes, and what it gives."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds]
    return sum(i is not None and i.numCompletedTasks > 0 for i in infos), out


def test_stars_need_no_round(spark):
    links = spark.createDataFrame([(100 * s, 100 * s + i) for s in range(1, 4) for i in range(1, 40)], "a long, b long")
    n, rows = stages_of(spark, "stars", lambda: components(links).collect())
    assert {r.node: r.component for r in rows} == {100 * s + i: 100 * s for s in range(1, 4) for i in range(40)}
    # Two to make the links distinct, three to see that they are stars, two for the result; a round has six or more.
    assert n <= 8


def test_columns_are_as_in_tasks(spark):
    r = np.random.default_rng(5)
    rows = []
    for _ in range(300):
        both = r.integers(0, 2**63, r.integers(0, 60), dtype=np.uint64)
        x, y = (np.unique(np.concatenate([both, r.integers(0, 2**64, r.integers(1, 20), dtype=np.uint64)])) for _ in range(2))
        regs = [near_dedup.registers(s) for s in (x, y)]
        near = bool(near_dedup.estimate(regs[0], regs[1][None])[0] >= near_dedup.floor_of(80, 100))
        rows.append(([*map(int, regs[0].view(np.int16))], [*map(int, regs[1].view(np.int16))], x.view(np.int64).tolist(), y.view(np.int64).tolist(), near, near_dedup.similar(x, y, 80, 100)))
    assert {x[4] for x in rows} == {x[5] for x in rows} == {True, False}
    found = spark.createDataFrame(rows, "p array<short>, q array<short>, x array<long>, y array<long>, near boolean, alike boolean")
    near, alike = near_dedup.promising(F.col("p"), F.col("q"), near_dedup.floor_of(80, 100)), near_dedup.reaching(F.col("x"), F.col("y"), 80, 100)
    assert found.where((near != F.col("near")) | (alike != F.col("alike"))).count() == 0
