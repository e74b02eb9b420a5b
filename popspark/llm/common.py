"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contracts' white space: space and the code points 9 to 13.
SPACE = " \t\n\x0b\f\r"
#: A word by the contracts, as a regular expression that Java, Python and RE2 read alike.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(columns: list[str]) -> list[Column]:
    """Columns by their whole names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; a string of ASCII alone takes the faster built-in."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def hash128(c: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds: as a pair, a key whose collisions can be left out of account."""
    return F.xxhash64(c), F.xxhash64(F.lit(0x5EED), c)


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right by one 64-bit key, where right comes out of an aggregate by that key.

    Dealt by the aggregate, its partitions could not be split where left has a hot key. Joining by half of the key, and
    comparing the rest apart, gives right an exchange of its own; then Spark splits hot partitions at run time.
    """
    half = F.shiftrightunsigned(key, 1)
    a = left.withColumn("_half", half)
    b = right.withColumn("_half", half).withColumnRenamed(key, "_key")
    return a.join(b, (a["_half"] == b["_half"]) & (a[key].bitwiseXOR(b["_key"]) == 0), how).drop("_half", "_key")
