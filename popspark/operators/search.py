"""Particles of a search over parameters: rows (generation, particle_id, point, loglik)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def grid(spark: SparkSession, bounds: list[tuple[float, float]], per_axis: int) -> DataFrame:
    """The full factorial of log-spaced values in positive bounds: (particle_id, point).

    Ids are numbers in base ``per_axis``, so the points come from a range without any join.
    """
    ids = spark.range(per_axis ** len(bounds)).withColumnRenamed("id", "particle_id")
    point = []
    for k, (low, high) in enumerate(bounds):
        digit = F.expr(f"(particle_id div {per_axis ** (len(bounds) - 1 - k)}) % {per_axis}")
        share = digit / (per_axis - 1) if per_axis > 1 else F.lit(0.0)
        point.append(F.exp(F.ln(F.lit(float(low))) + share * (F.ln(F.lit(float(high))) - F.ln(F.lit(float(low))))))
    return ids.select("particle_id", F.array(*point).alias("point"))


def in_bounds(particles: DataFrame, bounds: list[tuple[float, float]]) -> DataFrame:
    """Particles whose every coordinate is inside its bounds, ends included."""
    limits = F.array(*[F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for a, b in bounds])
    return particles.where(F.forall(F.zip_with("point", limits, lambda x, b: (x >= b["low"]) & (x <= b["high"])), lambda x: x))


def keep_best(particles: DataFrame, k: int) -> DataFrame:
    """Each generation's k particles with the highest likelihood; ties to the smaller id."""
    order = Window.partitionBy("generation").orderBy(F.desc("loglik"), "particle_id")
    return particles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def argmax(particles: DataFrame) -> DataFrame:
    """Each generation's best particle and its point."""
    best = F.max(F.struct("loglik", (-F.col("particle_id")).alias("least"), "point"))
    return particles.groupBy("generation").agg(best.alias("b")).select("generation", (-F.col("b.least")).alias("particle_id"), F.col("b.loglik").alias("loglik"), F.col("b.point").alias("point"))


def spread(particles: DataFrame) -> DataFrame:
    """Each coordinate's population standard deviation within a generation: (generation, coordinate, sd)."""
    rows = particles.select("generation", F.posexplode("point").alias("coordinate", "x"))
    return rows.groupBy("generation", "coordinate").agg(F.stddev_pop("x").alias("sd"))


def geometric_mean(spreads: DataFrame) -> DataFrame:
    """The geometric mean of a generation's standard deviations."""
    return spreads.groupBy("generation").agg(F.exp(F.avg(F.ln("sd"))).alias("mean_sd"))
