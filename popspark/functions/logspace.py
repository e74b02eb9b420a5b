"""Sums in log space as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUS_INFINITY = float("-inf")


def log_add(a: Column, b: Column) -> Column:
    """ln(exp(a) + exp(b)) without overflow; null counts as nothing."""
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(a.isNull(), b).when(b.isNull(), a).when(high == MINUS_INFINITY, high).otherwise(high + F.log1p(F.exp(low - high)))


def log_sub(a: Column, b: Column) -> Column:
    """ln(exp(a) - exp(b)) for a >= b; minus infinity if they are equal."""
    return F.when(a == b, F.lit(MINUS_INFINITY)).otherwise(a + F.log1p(-F.exp(b - a)))


def log_sum_exp(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and name = ln(sum(exp(value))) of each group: one shuffle for the greatest value, one for the shifted sum.

    A group of minus infinities gives minus infinity. The greatest values have one row for each group; Spark broadcasts them
    where they are small and shuffles them otherwise.
    """
    top = df.groupBy(*keys).agg(F.max(value).alias("_top")) if keys else df.agg(F.max(value).alias("_top"))
    both = df.join(top, keys) if keys else df.crossJoin(F.broadcast(top))
    shifted = F.when(F.col("_top") == MINUS_INFINITY, F.lit(0.0)).otherwise(F.exp(F.col(value) - F.col("_top")))
    grouped = both.groupBy(*keys, "_top") if keys else both.groupBy("_top")
    total = grouped.agg(F.sum(shifted).alias("_sum"))
    return total.select(*keys, F.when(F.col("_top") == MINUS_INFINITY, F.col("_top")).otherwise(F.col("_top") + F.ln("_sum")).alias(name))
