"""What goes before a row in an order within a key, without one task for each key.

Rows are dealt into buckets of the order's number, as many as the rows need; windows run within buckets, and one row for
each bucket carries on what the buckets before it hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Rows of a bucket, about, if the numbers are spread evenly.
ROWS = 1_000_000


def _number(df: DataFrame, x: str) -> Column:
    """A number in the order of x."""
    kind = dict(df.dtypes)[x]
    if kind in ("timestamp_ntz", "date"):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(x).cast("timestamp_ntz")).cast("double")
    return F.col(x).cast("double")


def _bucketed(df: DataFrame, x: str, rows: int) -> DataFrame:
    number = _number(df, x)
    low, high, n = df.agg(F.min(number), F.max(number), F.count("*")).first()
    buckets = -(-n // rows)
    if buckets < 2 or low is None or high == low:
        return df.withColumn("_bucket", F.lit(0))
    share = (number - F.lit(float(low))) / (float(high) - float(low)) * buckets
    return df.withColumn("_bucket", F.least(F.floor(share), F.lit(buckets - 1)).cast("int"))


def last_before(df: DataFrame, keys: list[str], x: str, ties: list[str], value: str, name: str, inclusive: bool = False, rows: int = ROWS) -> DataFrame:
    """df with ``name``: the last value that is not null before the row (or at it, with ``inclusive``), in the order of x, a
    number or time, and then ties, within keys; null if there is none."""
    dealt = _bucketed(df, x, rows)
    order = Window.partitionBy(*keys, "_bucket").orderBy(x, *ties).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    at = F.struct(x, *ties)
    tails = dealt.groupBy(*keys, "_bucket").agg(F.max_by(value, F.when(F.col(value).isNotNull(), at)).alias("_tail"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each key and bucket.
    carried = tails.withColumn("_carried", F.last("_tail", ignorenulls=True).over(earlier)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bucket").alias("_of"), "_carried")
    same = F.col("_bucket") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = dealt.withColumn("_inside", F.last(value, ignorenulls=True).over(order))
    return inside.join(carried, same, "left").withColumn(name, F.coalesce("_inside", "_carried")).select(*df.columns, name)


def sum_before(df: DataFrame, keys: list[str], x: str, ties: list[str], value: str, name: str, rows: int = ROWS) -> DataFrame:
    """df with ``name``: the sum of the values of all rows before it, in the order of x and then ties, within keys."""
    dealt = _bucketed(df, x, rows)
    order = Window.partitionBy(*keys, "_bucket").orderBy(x, *ties).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_carried", F.sum("_total").over(earlier)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bucket").alias("_of"), "_carried")
    same = F.col("_bucket") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(order), F.lit(0)))
    return inside.join(carried, same, "left").withColumn(name, F.col("_inside") + F.coalesce("_carried", F.lit(0))).select(*df.columns, name)


def numbered(df: DataFrame, keys: list[str], x: str, ties: list[str], name: str, rows: int = ROWS) -> DataFrame:
    """df with ``name``: how many rows go before each, in the order of x, a number, and then ties, within keys; from 0 on."""
    counted = sum_before(df.withColumn("_one", F.lit(1).cast("long")), keys, x, ties, "_one", name, rows)
    return counted.drop("_one").withColumn(name, F.col(name).cast("int"))
