"""Exact top-k search: branch and bound over blocks of dimensions in vertical layout."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm.common import table
from popspark.llm.vectors import best, matrix, usable
from popspark.shipping import ship

#: Dimensions that are added up before candidates are judged again.
DIMS = 8
#: Candidates of a block at most, and at least; queries of a block at most.
LARGEST, SMALLEST, QUERIES = 65_536, 4096, 131_072
#: Components of a block at most, which bounds its rows where they have many dimensions; queries that are made dense at once.
CELLS, SLICE = 1 << 23, 8192


class VerticalBlock:
    """Candidates by dimension, with the mass of each block of dimensions."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.parts = [np.ascontiguousarray(self.rows[:, d : d + DIMS].T) for d in range(0, rows.shape[1], DIMS)]
        self.mass = [np.einsum("ij,ij->j", p, p, dtype=np.float64) for p in self.parts]
        self.total = np.sum(self.mass, axis=0)

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best but for the query's own row; ties to the smaller id.

        Blocks of dimensions go in order of the query's mass. What the rest can still add is at most the product of the
        rest's lengths (Cauchy-Schwarz). The candidates that lead after the first block are scored in full, and their k-th
        score is the bar; those that cannot reach it leave, and the others are compacted.
        """
        k += int(np.searchsorted(self.ids, own, "right") - np.searchsorted(self.ids, own))
        parts = [query[d : d + DIMS] for d in range(0, len(query), DIMS)]
        masses = np.array([float(p.astype(np.float64) @ p) for p in parts])
        rest, bar = masses.sum(), -np.inf
        alive, left = None, self.total
        scores = np.zeros(len(self.ids), query.dtype)
        for step, b in enumerate(np.argsort(-masses, kind="stable")):
            if alive is None:
                scores = scores + parts[b] @ self.parts[b]
                left = left - self.mass[b]
            else:
                scores += parts[b] @ self.parts[b][:, alive]
                left = left - self.mass[b][alive]
            rest -= masses[b]
            if step == 0 and len(scores) > 4 * k:
                leaders = np.argpartition(-scores, 2 * k)[: 2 * k]
                bar = np.partition(self.rows[leaders] @ query, -k)[-k]
            if len(scores) > 2 * k and bar > -np.inf:
                reach = scores + np.sqrt(np.maximum(left, 0) * max(rest, 0.0)) * (1 + 1e-6) + 1e-3
                keep = reach >= bar
                if (n := int(keep.sum())) < 0.7 * len(scores):
                    alive = np.flatnonzero(keep) if alive is None else alive[keep]
                    scores, left = scores[keep], left[keep]
                    assert n >= k
        ids = self.ids if alive is None else self.ids[alive]
        if len(scores) > k:
            at_least = scores >= np.partition(scores, -k)[-k]
            ids, scores = ids[at_least], scores[at_least]
        order = np.lexsort((ids, -scores))[:k]
        order = order[ids[order] != own]
        return ids[order], scores[order]


RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _searched(k: int) -> Callable:
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(queries) or not len(candidates):
            return RESULT.empty_table()
        c = matrix(candidates.column("vector"), np.int64)
        slices = [queries.slice(at, SLICE) for at in range(0, len(queries), SLICE)]
        most = float(abs(c).max()) * c.shape[1] * max(float(abs(matrix(q.column("vector"), np.int64)).max()) for q in slices)
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        block = VerticalBlock(candidates.column("vec_id").to_numpy(), c.astype(kind))
        out = []
        for q in slices:
            rows = matrix(q.column("vector"), np.int64).astype(kind)
            out += [(own, *block.search(own, row, k)) for own, row in zip(q.column("vec_id").to_pylist(), rows, strict=True)]
        ids = np.repeat([x[0] for x in out], [len(x[1]) for x in out])
        return pa.table([ids.astype(np.int64), np.concatenate([x[1] for x in out]), np.concatenate([x[2] for x in out]).astype(np.int64)], schema=RESULT)

    return run


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k candidates with the highest inner product, ties to the smaller
    vec_id. Vectors (column ``vector``, whole numbers) with a null vec_id take no part.

    A query's candidates are the rows with another vec_id and as many dimensions; all of them, if fewer than k. Where a
    vec_id repeats, each of its rows is a candidate, and as a query it is asked once, with its least vector. Sums are exact
    while they stay below 2**63. Other columns are not read; an empty table gives no rows.

    Rows are dealt into blocks by a hash of their content, so a task that is run again gets the same rows; equal rows are
    counted first, and no more than k of them are told apart, so that they cannot fill one block. Each block of queries
    meets each block of candidates in one task, which passes on k rows a query. A block has a bound on its rows and on its
    components, so a task's memory grows neither with the table nor with the dimensions.
    """
    ship(vectors.sparkSession)
    known = vectors.where("vec_id is not null").select("vec_id", "vector", F.coalesce(is_query, F.lit(False)).alias("asked"))
    n, m, dims = (x or 0 for x in known.agg(F.count("*"), F.count_if("asked"), F.max(F.size("vector"))).first())
    rows = known.groupBy("vec_id", "vector").agg(F.least(F.count("*"), F.lit(k)).alias("copies"), F.max("asked").alias("asked")).withColumn("dims", F.size("vector"))
    queries = rows.where("asked").groupBy("vec_id", "dims").agg(F.min("vector").alias("vector"))
    most = max(1, CELLS // max(dims, 1))
    blocks = max(1, -(-n // min(LARGEST, most, max(SMALLEST, -(-n // 12)))))
    query_blocks = max(1, -(-m // min(QUERIES, 2 * most)))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    single = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    dealt = single.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector", "copy"), F.lit(blocks)).cast("int")).withColumn("query_block", every(query_blocks))
    asked = queries.withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("block", every(blocks))
    keys = ["block", "query_block", "dims"]
    found = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_searched(k), "query_id long, vec_id long, score long")
    return best(found, k)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth vector, the 20 others with the highest inner product of components floor(64 * x)."""
    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("long"))
    return exact_topk(rows.select("vec_id", whole.alias("vector")), F.col("vec_id") % 20 == 0)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as vector from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.vector, c.vector) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 20
"""
