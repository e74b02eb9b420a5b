"""Half-open intervals of time: breakpoints, refinements and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from popspark.operators.ordered import ROWS, last_before, sum_before


def from_breakpoints(points: DataFrame, key: str = "model") -> DataFrame:
    """points (key, t) to consecutive intervals (key, idx, start, end); the last one never ends."""
    order = Window.partitionBy(key).orderBy("t")
    after = F.lead("t").over(order)
    return points.select(key, "t").distinct().select(key, (F.row_number().over(order) - 1).alias("idx"), F.col("t").alias("start"), F.coalesce(after, F.lit(float("inf"))).alias("end"))


def refined(one: DataFrame, other: DataFrame, key: str = "model", epsilon: float = 1e-10) -> DataFrame:
    """The common refinement of two sets of breakpoints (key, t); points within epsilon of the one before are one."""
    points = one.select(key, "t").unionByName(other.select(key, "t")).distinct()
    before = F.lag("t").over(Window.partitionBy(key).orderBy("t"))
    return from_breakpoints(points.withColumn("before", before).where("before is null or t - before > " + repr(epsilon)), key)


def as_of(times: DataFrame, changes: DataFrame, key: str, value: str, rows: int = ROWS) -> DataFrame:
    """times (key, t, id) with the value of the last change (key, t, value) at or before t; null before the first.

    Both go through one order of (key, t), changes first at equal times, in buckets of time; nothing is compared pairwise.
    """
    kind = dict(changes.dtypes)[value]
    a = changes.select(key, "t", F.lit(None).cast("long").alias("id"), F.lit(0).alias("side"), F.col(value).alias("_value"))
    b = times.select(key, "t", "id", F.lit(1).alias("side"), F.lit(None).cast(kind).alias("_value"))
    found = last_before(a.unionByName(b), [key], "t", ["side"], "_value", value, rows=rows)
    return found.where("side = 1").select(key, "t", "id", value)


def state_offsets(states: DataFrame, rows: int = ROWS) -> DataFrame:
    """states (chunk, state, n_haps) with offset, where a state's haplotypes begin in a flat array."""
    return sum_before(states, ["chunk"], "state", [], "n_haps", "offset", rows)
