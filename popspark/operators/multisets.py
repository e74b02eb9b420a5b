"""Samples as multisets: rows (deme, hap, multiplicity), one for each haplotype of a deme."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combined(*samples: DataFrame) -> DataFrame:
    """All samples together: multiplicities of equal haplotypes of a deme add up."""
    rows = reduce(DataFrame.unionByName, samples)
    return rows.groupBy("deme", "hap").agg(F.sum("multiplicity").cast("long").alias("multiplicity"))


def adjusted(sample: DataFrame, changes: DataFrame) -> DataFrame:
    """The sample with changes, rows of the same kind whose multiplicities may be negative. Haplotypes of which none is left go;
    fewer than none is an error."""
    left = combined(sample, changes)
    checked = F.when(F.col("multiplicity") >= 0, F.col("multiplicity")).otherwise(F.raise_error(F.lit("a haplotype is taken more often than it is there")).cast("long"))
    return left.withColumn("multiplicity", checked).where("multiplicity <> 0")


def deme_totals(sample: DataFrame) -> DataFrame:
    """(deme, types, total): how many different haplotypes a deme has, and how many in all."""
    rows = combined(sample).where("multiplicity > 0")
    return rows.groupBy("deme").agg(F.count("*").alias("types"), F.sum("multiplicity").alias("total"))
