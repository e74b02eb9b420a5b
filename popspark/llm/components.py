"""Connected components of a graph of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popspark.shared import cut


def hung(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """Edges (u, v), v the smaller, that reach what the links (a, b) reach: after so many rounds, or, without ``rounds``, when
    every node hangs under its component.

    Each round hangs the larger neighbours of every node, and then the smaller ones, under the smallest of them, until
    every node hangs under its component: as many rounds as the logarithm of the longest path. Only a flag leaves the cluster
    after each round. Groups are aggregated to their minimum and joined, so a node with many links makes no large group.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    done = 0
    while done != rounds and (rounds or not _settled(edges)):
        done += 1
        both = _both(edges)
        # Merged as dealt: to broadcast a side, small as it may be, takes a pass over the partitions more.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).hint("merge")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m")).hint("merge")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u <> v").distinct())
    return edges


def _both(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, in one pass."""
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and no larger one, or none that is smaller."""
    own = _both(edges).groupBy("u").agg(F.count_if(F.col("v") < F.col("u")).alias("smaller"), F.count_if(F.col("v") > F.col("u")).alias("larger"))
    return not own.agg(F.max((F.col("smaller") > 1) | ((F.col("smaller") > 0) & (F.col("larger") > 0)))).first()[0]


def nearest(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v), v the smaller: its smallest neighbour, or itself."""
    nodes = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), "v"))).alias("e"))
    return nodes.groupBy(F.col("e.u").alias("node")).agg(F.min("e.v").alias("component"))


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node that can be reached.

    With ``rounds``, it stops after so many: component is then some node that can be reached, the smallest in small groups.
    No links give no rows.
    """
    return nearest(hung(links, rounds))
