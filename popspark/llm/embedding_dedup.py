"""Near copies among vectors by an epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from popspark.llm.common import hash128, named, spread_join, table
from popspark.llm.components import components
from popspark.llm.vectors import matrix, usable
from popspark.shared import cut, written
from popspark.shipping import ship

#: Leading principal dimensions that make cells and boxes.
LEADING = 8
#: Rows of an interval below which its rows are compared one by one, and of a block at most and at least.
LEAF, LARGEST, SMALLEST = 256, 65_536, 2048
#: Components of a block at most, which bounds its rows where they have many dimensions.
CELLS = 1 << 23
#: What rounding may cost a distance or a product: by so much a bound must miss before anything is skipped.
SLACK = 1e-9


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors scaled to length 1, scaled by their largest component first so that no square leaves the range of doubles."""
    rows = matrix(column)
    rows = rows / abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of outer products of a task's unit vectors, by number of dimensions."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        part = pa.Table.from_batches([batch])
        for d in np.unique(part.column("dims").to_numpy()):
            u = _units(part.filter(pa.compute.equal(part.column("dims"), pa.scalar(d, pa.int32()))).column("vector"))
            sums[int(d)] = sums.get(int(d), 0) + np.concatenate([(u.T @ u).ravel(), [len(u)]])
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["dims", "sums"])


def principal_axes(classes: DataFrame, leading: int) -> np.ndarray:
    """The leading principal axes of all unit vectors of the commonest number of dimensions (of no axes, if there are none).

    A task sends one square matrix, and the driver adds them up; vectors with other numbers of dimensions keep their own axes.
    """
    common = classes.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return np.zeros((0, leading))
    d = common["dims"]
    parts = classes.where(F.col("dims") == d).mapInArrow(_moments, "dims int, sums array<double>")
    each = parts.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("x")).orderBy("pos").toArrow().column("x").to_numpy()
    return np.linalg.eigh(each[:-1].reshape(d, d) / each[-1])[1][:, ::-1][:, :leading]


def _placed(axes: np.ndarray, width: float) -> Callable:
    """Adds each row's place: its projections on the leading axes, the length of what they leave, and the cells of the former."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.Table.from_batches([batch])
            for d in np.unique(part.column("dims").to_numpy()):
                rows = part.filter(pa.compute.equal(part.column("dims"), pa.scalar(d, pa.int32())))
                u = _units(rows.column("vector"))
                place = u @ axes if len(axes) == d else u[:, : axes.shape[1]]
                rest = np.sqrt(np.maximum(0, 1 - (place * place).sum(1)))
                cells = np.floor(place / width).astype(np.int32)
                place = np.concatenate([place, rest[:, None]], 1)
                out = rows.append_column("place", pa.array(place.tolist(), pa.list_(pa.float64()))).append_column("cells", pa.array(cells.tolist(), pa.list_(pa.int32())))
                yield from out.to_batches()

    return run


def _blocks(classes: DataFrame, axes: np.ndarray, width: float) -> DataFrame:
    """The classes in epsilon grid order, cut into intervals: columns block, at (place within it) and place are added."""
    n, dims = classes.agg(F.count("*"), F.max("dims")).first()
    size = max(1, min(LARGEST, CELLS // max(dims or 1, 1), max(SMALLEST, -(-n // 8))))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema) + ", place array<double>, cells array<int>"
    placed = classes.mapInArrow(_placed(axes, width), kinds)
    order = ["dims", "cells", "node"]
    ranges = written(placed.repartitionByRange(max(1, -(-n // size)), *order).withColumn("range", F.spark_partition_id()), "grid")
    # Ranges are balanced by a sample; each is cut into intervals of a fixed size at most, so that a bound holds whatever it holds.
    at = F.row_number().over(Window.partitionBy("range", "dims").orderBy("cells", "node")) - 1
    numbered = ranges.withColumn("at", at)
    block = F.struct("dims", "range", F.floor(F.col("at") / size).cast("int").alias("part"))
    return written(numbered.withColumn("block", F.xxhash64(block)).drop("range", "cells"), "blocks")


def block_pairs(blocks: DataFrame, width: float) -> DataFrame:
    """(x, y) of the intervals, x <= y, whose boxes are not provably further apart than ``width``; each meets itself.

    Intervals meet by the cells that they hold in the first dimension, so only neighbours in the grid's order are compared.
    """
    k = LEADING + 1
    # Rows of fewer dimensions than leading axes have shorter places; what is missing counts as 0 for all of them.
    value = lambda i: F.coalesce(F.get("place", F.lit(i)), F.lit(0.0))
    boxes = blocks.groupBy("block", "dims").agg(*[f(value(i)).alias(f"{name}{i}") for i in range(k) for f, name in ((F.min, "low"), (F.max, "high"))])
    boxes = cut(boxes)
    cell = lambda c: F.floor(F.col(c) / width).cast("int")
    own = boxes.withColumn("cell", F.explode(F.sequence(cell("low0"), cell("high0"))))
    near = boxes.withColumn("cell", F.explode(F.sequence(cell("low0") - 1, cell("high0") + 1)))
    a, b = own.alias("a"), near.alias("b")
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a.low{i}") - F.col(f"b.high{i}"), F.col(f"b.low{i}") - F.col(f"a.high{i}")), 2) for i in range(k)), F.lit(0.0))
    met = a.join(b, ["cell", "dims"]).where((F.col("a.block") <= F.col("b.block")) & (gap <= width * width + SLACK))
    return met.select(F.col("a.block").alias("x"), F.col("b.block").alias("y")).distinct()


class Interval:
    """Rows of one interval of the order, with the boxes of its halves, their halves and so on."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("at")
        self.node = rows.column("node").to_numpy()
        self.copies = rows.column("copies").to_numpy()
        self.vector = matrix(rows.column("vector"))
        self.unit = _units(rows.column("vector"))
        self.place = matrix(rows.column("place"))
        self._boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        if (low, high) not in self._boxes:
            part = self.place[low:high]
            self._boxes[low, high] = part.min(0), part.max(0)
        return self._boxes[low, high]

    def __len__(self) -> int:
        return len(self.node)


def joined(a: Interval, b: Interval, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i in a, j in b) of linked rows, leaf by leaf; of an interval with itself, i < j.

    Two parts whose boxes are further apart than the threshold allows are skipped; of others, the longer is halved, until
    both are short. What a box bounds is the distance in the leading dimensions and of the lengths of what these leave.
    """
    reach = 2 - 2 * cosine + SLACK
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if a is b and k + 1 >= m and i >= k or a is b and i >= m:
            continue
        (alow, ahigh), (blow, bhigh) = a.box(i, j), b.box(k, m)
        gap = np.maximum(0, np.maximum(alow - bhigh, blow - ahigh))
        if gap @ gap > reach:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            x, y = np.nonzero(a.unit[i:j] @ b.unit[k:m].T >= cosine - SLACK)
            x, y = x + i, y + k
            if a is b:
                x, y = x[x < y], y[x < y]
            if len(x):
                # The measure itself, on the vectors as they are.
                sure = _cosines(a.vector[x], b.vector[y]) >= cosine
                yield x[sure], y[sure]
        elif j - i >= m - k:
            half = (i + j) // 2
            todo += [(half, j, k, m), (i, half, k, m)]
        else:
            half = (k + m) // 2
            todo += [(i, j, half, m), (i, j, k, half)]


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows; those with squares beyond the range of doubles are scaled first."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        out = (x * y).sum(1) / (np.sqrt(xx) * np.sqrt(yy))
    odd = np.flatnonzero(~((xx > 1e-200) & (xx < 1e200) & (yy > 1e-200) & (yy < 1e200)))
    if len(odd):
        u, v = x[odd] / abs(x[odd]).max(1, keepdims=True), y[odd] / abs(y[odd]).max(1, keepdims=True)
        out[odd] = (u * v).sum(1) / (np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1)))
    return out


class Forest:
    """Groups of linked rows of one task; a row's root is the least node of its group."""

    def __init__(self, nodes: np.ndarray):
        self.nodes = nodes
        self.root = np.arange(len(nodes))

    def _flat(self) -> None:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return
            self.root = up

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        """Joins the groups of x[i] and y[i]. Nodes are sorted, so the lesser place is the lesser node."""
        while len(x):
            a, b = self.root[x], self.root[y]
            apart = a != b
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            if len(x):
                np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
                self._flat()


LINKED = "node long, links long, root long"


def _linked(cosine: float) -> Callable:
    """For two intervals, how many links each row has across them, and the least node of its group there: a row a node at
    most, however many pairs are linked."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a = Interval(left)
        same = left.column("block")[0] == right.column("block")[0]
        b = a if same else Interval(right)
        nodes = np.unique(np.concatenate([a.node, b.node]))
        copies, links = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        in_a, in_b = np.searchsorted(nodes, a.node), np.searchsorted(nodes, b.node)
        copies[in_a], copies[in_b] = a.copies, b.copies
        forest = Forest(nodes)
        for x, y in joined(a, b, cosine):
            x, y = in_a[x], in_b[y]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            forest.link(x, y)
        got = np.flatnonzero(links)
        return pa.table([pa.array(nodes[got]), pa.array(links[got]), pa.array(nodes[forest.root[got]])], ["node", "links", "root"])

    return run


def linked_classes(classes: DataFrame, cosine: float) -> DataFrame:
    """(node, links, root): for each class and pair of intervals with links, those to rows of other classes there."""
    width = float(np.sqrt(2 - 2 * cosine))
    axes = principal_axes(classes, LEADING)
    blocks = _blocks(classes, axes, width)
    pairs = cut(block_pairs(blocks, width).withColumn("pair", F.xxhash64("x", "y")))
    columns = ["block", "at", "node", "copies", "vector", "place"]
    left = blocks.join(pairs.select(F.col("x").alias("block"), "pair"), "block").select("pair", *columns)
    right = blocks.join(pairs.select(F.col("y").alias("block"), "pair"), "block").select(*[F.col(c).alias(c) for c in ["pair", *columns]])
    return left.groupBy("pair").cogroup(right.groupBy("pair")).applyInArrow(_linked(cosine), LINKED)


def embedding_groups(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, vector): how many other rows have a cosine of at
    least ``cosine`` with it, the smallest vec_id that links reach, and whether that is its own.

    Rows without vec_id, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing;
    their component_id is their own vec_id, and they are kept. Vectors of different numbers of dimensions do not link. Rows
    that repeat a vec_id are vectors of their own. Equal vectors are compared once, as one class with a count, and have
    ``copies - 1`` links among themselves. Other columns are not read; an empty table gives no rows.

    Classes are sorted by the cells of a grid as wide as the largest distance of linked unit vectors, on the leading
    principal dimensions, and cut into intervals. Pairs of intervals that are not provably too far apart meet in one task,
    which halves them on and on. A task returns a row a class at most: its number of links and its group's least node.
    """
    ship(vectors.sparkSession)
    fine = F.col("vec_id").isNotNull() & usable(F.col("vector")) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    a, b = hash128(F.col("vector"))
    rows = vectors.select("vec_id", F.when(fine, F.col("vector")).alias("vector"))
    rows = rows.select("vec_id", "vector", F.when(F.col("vector").isNotNull(), a).alias("a"), F.when(F.col("vector").isNotNull(), b).alias("b"))
    known = rows.where("vector is not null").groupBy("a", "b").agg(F.any_value("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = written(known.select(F.monotonically_increasing_id().alias("node"), "a", "b", "vector", "copies", "least", F.size("vector").alias("dims")), "classes")
    found = cut(linked_classes(classes.select("node", "vector", "copies", "dims"), cosine))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = classes.select("node", "a", "b", "copies", "least").join(links, "node", "left").join(nodes, "node", "left")
    placed = cut(placed.select("a", "b", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    classed = spread_join(placed, smallest, "component").select(F.col("a").alias("x"), F.col("b").alias("y"), "n_links", "component_id")
    out = rows.select("vec_id", "a", "b").join(classed, (F.col("a") == F.col("x")) & (F.col("b").bitwiseXOR(F.col("y")) == 0), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def embedding_dedup(docs: DataFrame, vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """The rows of docs that their groups keep, with all their columns: those with the group's smallest vec_id."""
    keep = embedding_groups(docs.select("vec_id", named([vector])[0].cast("array<double>").alias("vector")), cosine).where("kept and vec_id is not null").select("vec_id").distinct()
    own = named(docs.columns)
    return docs.where(F.col("vec_id").isNotNull()).join(keep, "vec_id", "left_semi").select(*own).unionByName(docs.where(F.col("vec_id").isNull()))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors with a cosine of 0.9 or more."""
    return embedding_groups(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector")))


SQL = """
with recursive unit as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as materialized (
  select a.vec_id as x, b.vec_id as y from unit a join unit b on a.vec_id <> b.vec_id
  where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.9
), reach(vec_id, other) as (
  select vec_id, vec_id from embeddings
  union
  select r.vec_id, l.y from reach r join links l on r.other = l.x
), groups as (select vec_id, min(other) as component_id from reach group by vec_id),
counts as (select x as vec_id, count(*) as n from links group by x)
select e.vec_id, coalesce(c.n, 0) as n_links, g.component_id, e.vec_id = g.component_id as kept
from embeddings e join groups g using (vec_id) left join counts c using (vec_id)
"""
