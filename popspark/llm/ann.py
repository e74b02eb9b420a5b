"""Approximate nearest neighbours: balanced posting lists, boundary replicas, a centroid graph, distance-ratio pruning."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm.common import table
from popspark.llm.vectors import best, matrix, usable
from popspark.shared import cut
from popspark.shipping import ship

#: Rows of a task about, and queries of a task at most; rows whose distances to all centroids are held at once.
ROWS, QUERIES, SLICE = 65_536, 65_536, 2048


@dataclass
class Centroids:
    """Centroids in a space with one more dimension, where the largest inner product is the least distance.

    A vector gets the length that it lacks to the longest one; a query gets 0.
    """

    points: np.ndarray
    graph: np.ndarray
    longest: float

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        lack = np.maximum(self.longest**2 - np.einsum("ij,ij->i", rows, rows), 0)
        return np.concatenate([rows, np.sqrt(lack)[:, None]], 1)

    def distances(self, rows: np.ndarray) -> np.ndarray:
        square = np.einsum("ij,ij->i", rows, rows)[:, None] + np.einsum("ij,ij->i", self.points, self.points)[None] - 2 * rows @ self.points.T
        return np.sqrt(np.maximum(square, 0))

    def nearest(self, query: np.ndarray, width: int) -> list[tuple[float, int]]:
        """About the ``width`` nearest centroids, by a best-first walk over the graph from its entry."""
        far = lambda i: float(np.linalg.norm(self.points[i] - query))
        seen = np.zeros(len(self.points), bool)
        seen[0] = True
        heap = [(far(0), 0)]
        kept = [(-heap[0][0], 0)]
        while heap:
            d, i = heapq.heappop(heap)
            if len(kept) >= width and d > -kept[0][0]:
                break
            fresh = self.graph[i][~seen[self.graph[i]]]
            if not len(fresh):
                continue
            seen[fresh] = True
            for e, j in zip(np.linalg.norm(self.points[fresh] - query, axis=1).tolist(), fresh.tolist(), strict=True):
                if len(kept) < width or e < -kept[0][0]:
                    heapq.heappush(heap, (e, j))
                    heapq.heappush(kept, (-e, j))
                    if len(kept) > width:
                        heapq.heappop(kept)
        return sorted((-d, i) for d, i in kept)


def fitted(sample: np.ndarray, longest: float, lists: int, degree: int = 24, rounds: int = 8, seed: int = 0) -> Centroids:
    """k-means whose distances carry a charge for full lists, so that lists come out balanced, and the centroids' graph."""
    empty = Centroids(np.empty((0, 0)), np.empty((0, 0), int), longest)
    rows = empty.lifted(sample)
    lists = max(1, min(lists, len(rows)))
    random = np.random.default_rng(seed)
    points = rows[random.choice(len(rows), lists, replace=False)]
    charge, even = np.zeros(lists), len(rows) / lists
    for _ in range(rounds):
        own = np.concatenate([(np.einsum("ij,ij->i", points, points)[None] - 2 * rows[at : at + SLICE] @ points.T + charge).argmin(1) for at in range(0, len(rows), SLICE)])
        sizes = np.bincount(own, minlength=lists)
        spread = max(float(np.var(rows, 0).sum()), 1e-12)
        charge += 0.05 * spread * (sizes / even - 1).clip(-1, 4)
        sums = np.zeros_like(points)
        np.add.at(sums, own, rows)
        points = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], rows[random.choice(len(rows), lists)])
    whole = Centroids(points, empty.graph, longest)
    near = np.concatenate([np.argsort(whole.distances(points[at : at + SLICE]), 1, kind="stable")[:, : degree // 2 + 1] for at in range(0, lists, SLICE)])
    # A few random edges beside the near ones keep the graph in one piece.
    graph = np.concatenate([near, random.integers(0, lists, (lists, degree - degree // 2))], 1)
    graph[:, 0] = np.roll(np.arange(lists), -1)
    return Centroids(points, graph, longest)


def _posted(model: Centroids, ratio: float, copies: int) -> Callable:
    """Each vector in its nearest list, and in the next ones whose centroids are hardly farther."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = pa.Table.from_batches([batch.slice(at, SLICE)])
                away = model.distances(model.lifted(matrix(part.column("vector"))))
                order = np.argsort(away, 1, kind="stable")[:, :copies]
                near = np.take_along_axis(away, order, 1)
                rows, which = np.nonzero(near <= ratio * near[:, :1])
                where = order[rows, which]
                out = part.take(pa.array(rows, pa.int64())).append_column("list", pa.array(where.astype(np.int32)))
                yield from out.append_column("first", pa.array(which == 0)).combine_chunks().to_batches()

    return run


class Deal:
    """Which blocks of lists go to which task: (block, blocks, task, unit) of each list; a list beyond a task's rows has several."""

    def __init__(self, sizes: dict[int, int]):
        total = sum(sizes.values())
        self.tasks = max(12, -(-total // ROWS))
        self.rows: list[tuple[int, int, int, int, int]] = []
        heap = [(0, t) for t in range(self.tasks)]
        for c, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
            blocks = max(1, -(-n // min(ROWS, max(4096, total // 12))))
            for b in range(blocks):
                load, t = heapq.heappop(heap)
                self.rows.append((c, b, blocks, t, len(self.rows)))
                heapq.heappush(heap, (load + n // blocks, t))
        self.of: dict[int, list[tuple[int, int]]] = {}
        for c, _, _, t, unit in self.rows:
            self.of.setdefault(c, []).append((t, unit))


def _routed(model: Centroids, ratio: float, probes: int, firsts: np.ndarray, least: int, deal: Deal) -> Callable:
    """The lists that a query visits: those whose centroids are at most ``ratio`` times as far as the nearest, and then the
    next ones until the rows that have them as their first list are ``least`` or all. A query travels once to each task that
    holds some of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(pa.Table.from_batches([batch]).column("vector"))
            rows = np.concatenate([rows, np.zeros((len(rows), 1))], 1)
            own, tasks, units = [], [], []
            for i, query in enumerate(rows):
                found = model.nearest(query, probes)
                chosen = [c for d, c in found if d <= ratio * found[0][0] + 1e-12]
                if firsts[chosen].sum() < least:
                    order = np.linalg.norm(model.points - query, axis=1).argsort(kind="stable")
                    chosen = order[: int(np.searchsorted(np.cumsum(firsts[order]), least)) + 1].tolist()
                by_task: dict[int, list[int]] = {}
                for c in chosen:
                    for task, unit in deal.of.get(c, ()):
                        by_task.setdefault(task, []).append(unit)
                own += [i] * len(by_task)
                tasks += by_task
                units += by_task.values()
            out = pa.Table.from_batches([batch]).take(pa.array(own, pa.int64())).append_column("task", pa.array(tasks, pa.int32())).append_column("units", pa.array(units, pa.list_(pa.int32())))
            yield from out.combine_chunks().to_batches()

    return run


RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of different ids, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def _scored(k: int) -> Callable:
    """The k best of each query over the lists of one task, by inner products in double precision."""

    def run(queries: pa.Table, postings: pa.Table) -> pa.Table:
        if not len(queries) or not len(postings):
            return RESULT.empty_table()
        q, v = matrix(queries.column("vector")), matrix(postings.column("vector"))
        ids, own, unit_v = (np.asarray(t) for t in (postings.column("vec_id"), queries.column("query_id"), postings.column("unit")))
        units = queries.column("units").combine_chunks()
        unit_q, asks = np.asarray(units.flatten()), np.repeat(np.arange(len(q)), np.asarray(units.value_lengths()))
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for unit in np.unique(unit_q):
            mine, asked = np.flatnonzero(unit_v == unit), asks[unit_q == unit]
            if not len(mine):
                continue
            rows = v[mine]
            for at in range(0, len(asked), 512):
                rough = q[asked[at : at + 512]] @ rows.T
                for i, scores in zip(asked[at : at + 512].tolist(), rough, strict=True):
                    other = ids[mine] != own[i]
                    slack = 1e-9 * (1 + abs(scores).max())
                    bar = np.partition(scores[other], -k)[-k] - slack if other.sum() > k else -np.inf
                    near = np.flatnonzero((scores >= bar) & other)
                    # Added up row by row, so that equal vectors have equal scores wherever they stand.
                    exact = (rows[near] * q[i]).sum(1)
                    names = ids[mine[near]]
                    keep = top(exact, names, k)
                    found.setdefault(i, []).append((names[keep], exact[keep]))
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for i, parts in found.items():
            names, scores = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            keep = top(scores, names, k)
            out.append((int(own[i]), names[keep], scores[keep]))
        counts = [len(x[1]) for x in out]
        if not sum(counts):
            return RESULT.empty_table()
        return pa.table([np.repeat([x[0] for x in out], counts).astype(np.int64), np.concatenate([x[1] for x in out]), np.concatenate([x[2] for x in out])], schema=RESULT)

    return run


def _exactly(k: int) -> Callable:
    """The k best of each query over a block of candidates, all of them."""
    scored = _scored(k)

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(queries) or not len(candidates):
            return RESULT.empty_table()
        queries = queries.append_column("units", pa.array([[0]] * len(queries), pa.list_(pa.int32())))
        return scored(queries, candidates.append_column("unit", pa.array(np.zeros(len(candidates), np.int32))))

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, sample_rows: int = 20_000, lists: int | None = None, sample_per_list: int = 16, post_ratio: float = 1.2, copies: int = 4, probe_ratio: float = 1.4, probe_share: float = 0.2, min_probes: int = 14) -> DataFrame:
    """query_id, rank, vec_id, score: for each query about the k candidates with the largest inner product (score, in
    double precision), ties to the smaller vec_id. Candidates are all rows with another vec_id and as many dimensions.

    Rows without vec_id take no part. Equal rows count once; where a vec_id repeats with several vectors, its best one
    counts, and as a query it is asked once, with its least vector. Vectors with another number of dimensions than most are
    searched exactly, in blocks. Other columns are not read; an empty table gives no rows.

    Centroids number the root of the row count and are fitted on the rows with the least hashes: ``sample_rows`` of them,
    or ``sample_per_list`` for each list if that is more. With their graph they go to every task; at a thousand million rows
    they take about 20 MB. Every row is indexed, in up to ``copies`` lists. A query walks the graph to its ``probe_share``
    nearest lists, ``min_probes`` at least, and visits those within ``probe_ratio`` of the nearest one's distance. Lists are
    dealt to tasks of about ROWS rows; a list that is longer is split.
    """
    spark = vectors.sparkSession
    ship(spark)
    known = vectors.where("vec_id is not null").select("vec_id", "vector", F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = cut(known.groupBy("vec_id", "vector").agg(F.max("asked").alias("asked")).withColumn("dims", F.size("vector")))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    common = rows.groupBy("dims").agg(F.count("*").alias("n"), F.max(norm).alias("longest")).orderBy(F.desc("n"), "dims").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = rows.where(F.col("dims") == common["dims"])
    lists = lists or round(math.sqrt(common["n"]))
    sample = most.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(max(sample_rows, sample_per_list * lists)).select("vector").toArrow()
    model = fitted(matrix(sample.column("vector")), common["longest"], lists)
    probes = max(min_probes, math.ceil(probe_share * len(model.points)))

    postings = cut(most.select("vec_id", "vector").mapInArrow(_posted(model, post_ratio, copies), "vec_id long, vector array<double>, list int, first boolean"))
    # One row for each list.
    counts = postings.groupBy("list").agg(F.count("*").alias("n"), F.count_if("first").alias("firsts")).collect()
    firsts = np.zeros(len(model.points), np.int64)
    for r in counts:
        firsts[r["list"]] = r["firsts"]
    deal = Deal({r["list"]: r["n"] for r in counts})
    queries = most.where("asked").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    routed = cut(queries.mapInArrow(_routed(model, probe_ratio, probes, firsts, k + 1, deal), "vec_id long, vector array<double>, task int, units array<int>"))
    groups = max(1, -(-most.where("asked").count() // QUERIES))
    # A row for each list and block of one, so it grows as the lists do.
    units = F.broadcast(spark.createDataFrame(deal.rows, "list int, block int, blocks int, task int, unit int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    placed = postings.join(units, "list").where(F.pmod(F.xxhash64("vec_id", "vector"), "blocks") == F.col("block")).withColumn("part", every(groups))
    asked = routed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumnRenamed("vec_id", "query_id")
    keys = ["task", "part"]
    pairs = asked.select(*keys, "units", "query_id", "vector").groupBy(*keys).cogroup(placed.select(*keys, "unit", "vec_id", "vector").groupBy(*keys))
    found = pairs.applyInArrow(_scored(k), "query_id long, vec_id long, score double")

    rest = rows.where(F.col("dims") != common["dims"])
    few = rest.count()
    if few:
        blocks = max(1, -(-few // ROWS))
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int")).select("dims", "block", "vec_id", "vector")
        both = rest.where("asked").groupBy("vec_id", "dims").agg(F.min("vector").alias("vector")).select("dims", every(blocks).alias("block"), F.col("vec_id").alias("query_id"), "vector")
        found = found.unionByName(both.groupBy("dims", "block").cogroup(dealt.groupBy("dims", "block")).applyInArrow(_exactly(k), "query_id long, vec_id long, score double"))
    return best(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth vector, about the 20 others with the largest inner product."""
    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    vectors = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return nearest(vectors, F.col("vec_id") % 20 == 0)
