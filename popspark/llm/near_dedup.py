"""Near duplicates by HyperMinHash: compressed registers, banding, collision-corrected estimates, checks on full sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popspark.llm.common import named, spread_join, table
from popspark.llm.components import components, hung, nearest
from popspark.llm.words import mix, shingles, word_hashes
from popspark.shared import cut
from popspark.shipping import ship

#: Registers of a sketch, mantissa bits of a register, and bands at most.
REGISTERS, MANTISSA, BANDS = 96, 10, 24
EMPTY = 0xFFFF
#: Registers of different minima that agree all the same, by the HyperMinHash paper's constant.
CHANCE = 0.169919487159739 / 2**MANTISSA
#: Standard errors by which an estimate may fall short of the threshold before a pair is given up.
ERRORS = 5
#: What a pair of nodes carries: where each one's text is, and its set's digest.
PAIR = ["x", "x_doc", "x_a", "x_b", "y", "y_doc", "y_a", "y_b"]
#: Documents of a bucket that one task compares with as many others.
BLOCK = 1024
#: Pairs of a block whose sketches are compared together.
PAIRS = 1 << 14

_BUCKET_STARTS = np.arange(REGISTERS + 1, dtype=np.uint64)
_ODD = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """A 16-bit register for each bucket: the leading zeros of the bucket's least value, and the bits after its first one.

    hashes: the distinct shingles' 64-bit hashes, sorted. The top half of a hash is its bucket; a second mix gives its value.
    """
    out = np.full(REGISTERS, EMPTY, np.uint16)
    bucket = (hashes >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)
    starts = np.searchsorted(bucket, _BUCKET_STARTS)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        least = np.minimum.reduceat(mix(hashes ^ np.uint64(0xA5A5A5A5)), starts[full])
        fraction, exponent = np.frexp(least.astype(np.float64))
        zeros = np.clip(64 - exponent, 0, 62)
        out[full] = (zeros << MANTISSA) + ((fraction * 2 - 1).clip(0, 1 - 1e-9) * 2**MANTISSA).astype(np.int64)
    return out


class Bands:
    """Keys of a sketch, so that sets as similar as num/den share one, but for a chance of 3 in a million at most (at 0.8).

    Sets of up to ``small`` shingles are banded by size class, with so many bands that the shingles in which two such sets
    may differ cannot reach them all; each set has the keys of its class and the next, so similar sets share a class.
    Larger sets have BANDS bands of REGISTERS / BANDS registers. A band without shingles makes no key; a small set that has
    no more bands with shingles than it may differ in has its least shingles as keys besides.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.threshold = num / den
        self.differ = (den - num) / num
        self.log = math.log(den / num) * 1.0001
        self.small = math.ceil(BANDS / self.differ)

    def _full(self, regs: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(regs != EMPTY, starts, dtype=np.int64) > 0

    def _keys(self, regs: np.ndarray, bands: int, salt: int) -> np.ndarray:
        starts = _starts(bands)
        full = self._full(regs, starts)
        sums = np.add.reduceat((regs.astype(np.uint64) + np.uint64(1)) * _ODD, starts)
        return mix(sums + np.uint64(salt * 1000) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[full]

    def labels(self, n: int) -> list[tuple[int, int]]:
        """(bands, salt) of each class that a set of n shingles belongs to."""
        out = []
        if 0 < n < self.small:
            c = int(math.log(n) / self.log)
            out = [(min(BANDS, int(self.differ * math.exp((k + 1) * self.log)) + 1), k + 1) for k in (c, c + 1)]
        if n >= self.small * self.threshold - 1:
            out.append((BANDS, 0))
        return out

    def keys(self, regs: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([self._keys(regs, *x) for x in self.labels(n)] or [np.empty(0, np.uint64)])

    def least(self, regs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Further keys of a small set, for the classes in which every band with shingles may differ from a similar set's.

        Two similar sets of a class that share no band's key are both of this kind: each band with shingles is touched by
        one in which they differ. The least shingle that both have is then among the first of either, since a set of n has
        at most n * (den - num) / den shingles that a similar one has not.
        """
        n = len(hashes)
        risky = [salt for bands, salt in self.labels(n) if salt and self._full(regs, _starts(bands)).sum() <= n * (self.den - self.num) // self.num]
        first = hashes[: n * (self.den - self.num) // self.den + 1]
        return np.concatenate([mix(first ^ mix(np.array([salt], np.uint64))) for salt in risky] or [np.empty(0, np.uint64)])


def _starts(bands: int) -> np.ndarray:
    return -(-np.arange(bands) * REGISTERS // bands)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of one sketch to each of many, corrected for registers that agree by chance."""
    filled = ((one != EMPTY) | (many != EMPTY)).sum(1)
    same = ((one == many) & (one != EMPTY)).sum(1)
    return (same - CHANCE * filled) / np.maximum(filled, 1)


def floor_of(num: int, den: int) -> float:
    """Estimates below this belong to pairs below the threshold, but for a chance of about a millionth."""
    t = num / den
    return t - ERRORS * math.sqrt(t * (1 - t) / REGISTERS)


def _sketched(ngram: int, num: int, den: int) -> Callable:
    bands = Bands(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, name, regs, keys, least = [], [], [], [], []
            for words in word_hashes(batch.column("text"), lower=True):
                found = shingles(words, ngram)
                n.append(len(found))
                name.append(_digest(found))
                regs.append(r := registers(found))
                least.append(bands.least(r, found).view(np.int64))
                keys.append(np.concatenate([bands.keys(r, len(found)).view(np.int64), least[-1]]))
            a = np.frombuffer(b"".join(name), np.int64)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a[::2]), pa.array(a[1::2]), _lists([r.view(np.int16) for r in regs], np.int16), _lists(keys), _lists(least)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "a", "b", "regs", "keys", "least"])

    return run


def _lists(arrays: list[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    flat = np.concatenate(arrays) if arrays else np.empty(0, kind)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.from_numpy_dtype(kind)))


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and where each list ends; nulls are not expected."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(), ends[1:] - ends[0]


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _sets(ngram: int) -> Callable:
    """The full set of each text, under its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(words, ngram) for words in word_hashes(batch.column("text"), lower=True)]
            name = np.frombuffer(b"".join(map(_digest, sets)), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(name[::2]), pa.array(name[1::2]), _lists([x.view(np.int64) for x in sets])], ["a", "b", "shingles"])

    return run


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return _flat(column)[0].view(np.uint16).reshape(-1, REGISTERS)


def promising(x: Column, y: Column, least: float) -> Column:
    """Whether two sketches come near the threshold: ``estimate`` as a column."""
    # A filled register counts 1, one that agrees 1,000 more.
    code = F.zip_with(x, y, lambda a, b: F.when(a != b, 1).when(a == F.lit(EMPTY - 0x10000), 0).otherwise(1001))
    both = F.aggregate(code, F.lit(0), lambda total, c: total + c)
    filled, same = both % 1000, F.floor(both / 1000)
    return (same - F.lit(CHANCE) * filled) / F.greatest(filled, F.lit(1)) >= F.lit(least)


def similar(one: np.ndarray, other: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets reach the threshold, in whole numbers."""
    small, large = (one, other) if len(one) <= len(other) else (other, one)
    if len(small) * den < num * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return den * both >= num * (len(one) + len(other) - both)


def reaching(x: Column, y: Column, num: int, den: int) -> Column:
    """Whether two sets, as arrays, reach the threshold: ``similar`` as a column."""
    n, m, both = (F.size(c).cast("long") for c in (x, y, F.array_intersect(x, y)))
    # Sizes tell first.
    return F.when(F.least(n, m) * den >= F.greatest(n, m) * num, both * den >= (n + m - both) * num).otherwise(F.lit(False))


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """Consecutive rows with the same values in names, which may go over several batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy() for n in names], 1)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for at, stop in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(keys[at].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, stop - at))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _open_pairs(group: pa.Table, bands: Bands, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all later j) of a block whose documents are in different components, near enough by their sketches, and share
    no key below the block's own, so that each pair is met in one bucket only."""
    part, side = group.column("component").to_numpy(), group.column("side").to_numpy()
    regs, n, least_keys = _sketches(group.column("regs")), group.column("n").to_numpy(), group.column("least")
    key = group.column("key")[0].as_py()
    diagonal = bool((side == 2).all())
    below: dict[int, np.ndarray] = {}

    def lower(k: int) -> np.ndarray:
        if k not in below:
            keys = np.concatenate([bands.keys(regs[k], int(n[k])).view(np.int64), np.array(least_keys[k].as_py(), np.int64)])
            below[k] = keys[keys < key]
        return below[k]

    # Many rows of small blocks, few of large ones, so that the pairs looked at together are no more than PAIRS or so.
    step = max(1, PAIRS // len(part))
    for at in range(0, len(part), step):
        rows = np.arange(at, min(at + step, len(part)))
        apart = part[rows, None] != part
        apart &= rows[:, None] < np.arange(len(part)) if diagonal else (side[rows] == 0)[:, None] & (side != 0)
        one, other = np.nonzero(apart)
        one += at
        if len(one):
            near = estimate(regs[one], regs[other]) >= least
            one, other = one[near], other[near]
        for later in np.split(other, np.flatnonzero(one[1:] != one[:-1]) + 1) if len(one) else []:
            i = int(one[0])
            one = one[len(later) :]
            theirs = [lower(j) for j in later.tolist()]
            shared = np.isin(np.concatenate(theirs), lower(i))
            met_before = np.bincount(np.repeat(np.arange(len(later)), [len(t) for t in theirs]), shared, len(later)) > 0
            if not met_before.all():
                yield i, later[~met_before]


def _needed(num: int, den: int) -> Callable:
    bands, least = Bands(num, den), floor_of(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, ("key", "low", "high")):
            wanted = sorted({x for i, later in _open_pairs(group, bands, least) for x in (i, *later.tolist())})
            if wanted:
                yield group.take(pa.array(wanted)).combine_chunks().to_batches()[0]

    return run


def _linked(num: int, den: int) -> Callable:
    bands, least = Bands(num, den), floor_of(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, ("key", "low", "high")):
            ids, part = group.column("node").to_pylist(), group.column("component").to_pylist()
            values, ends = _flat(group.column("shingles"))
            sets = np.split(values.view(np.uint64), ends[:-1])
            root = {c: c for c in part}

            def find(c: int, root: dict[int, int] = root) -> int:
                while root[c] != c:
                    c = root[c]
                return c

            a, b = [], []
            for i, later in _open_pairs(group, bands, least):
                for j in later:
                    x, y = find(part[i]), find(part[j])
                    if x != y and similar(sets[i], sets[j], num, den):
                        root[x] = y
                        a.append(ids[i])
                        b.append(ids[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_groups(docs: DataFrame, ngram: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept (whether that is the row's own).

    A document's set holds its distinct runs of ``ngram`` words (split at white space, A-Z lower-cased); one with fewer
    words has their sequence as its only member; one without words, or with a null text, has none and is linked with
    nothing. Documents are linked where den * |both| >= num * |either|, counted on the full sets. Rows that repeat a doc_id
    are one document: each of their texts may link it, and all of them have one component. A row with a null doc_id is
    linked with nothing, has a null component and is kept. Texts of any length are read whole, a slice at a time. Other
    columns are not read. An empty table gives no rows.

    1. Each text becomes a sketch, a digest of its set and band keys, once; equal sets become one node.
    2. Nodes that share a key meet through the bucket's centre, the member whose keys are the most common: a group of
       near copies then costs one pair for each copy. Pairs pass by their estimate, then by their full sets.
    3. Buckets that still hold several components are gone through in blocks; each pair in different components is met
       once, under its least common key. Sketches travel first; full sets follow only for nodes that have such a pair.
    """
    spark = docs.sparkSession
    ship(spark)
    sketches = cut(docs.select("doc_id", "text").mapInArrow(_sketched(ngram, num, den), "doc_id long, n long, a long, b long, regs array<short>, keys array<long>, least array<long>"))
    known = sketches.where("n > 0 and doc_id is not null")
    # Equal sets have equal sketches, so any row of a class will do. Numbers are given once, before the checkpoint is read.
    same = [F.any_value(c).alias(c) for c in ("n", "regs", "keys", "least")]
    reps = cut(known.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), *same).withColumn("node", F.monotonically_increasing_id()))
    entries = reps.select(F.explode("keys").alias("key"), "node")
    common = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = cut(spread_join(entries, common, "key"))
    # A node has some fifty keys at most.
    weighed = met.withColumn("weight", F.sum("size").over(Window.partitionBy("node")))
    centres = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("least"))).alias("c")).select("key", (-F.col("c.least")).alias("centre"))
    stars = spread_join(met.select("key", "node"), centres, "key").where("node <> centre").groupBy(F.col("node").alias("x")).agg(F.collect_set("centre").alias("ys"))
    side = lambda s: reps.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{k}") for k, c in (("doc", "doc_id"), ("a", "a"), ("b", "b"), ("regs", "regs"))])
    both = stars.join(side("x"), "x").withColumn("y", F.explode("ys")).join(side("y"), "y")
    pairs = cut(both.where(promising(F.col("x_regs"), F.col("y_regs"), floor_of(num, den))).select(*PAIR))
    links = cut(_checked(docs, pairs, ngram, num, den).unionByName(_same_id(known, reps)))
    edges = hung(links, rounds=1)
    first = cut(nearest(edges))

    parts = met.select("key", "node").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key", "size")
    # Comparing takes more time than its bytes tell, so the number of partitions is not left to Spark.
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    rows = spread_join(parts, mixed, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"), "node", "component")
    # A block off the diagonal needs the members of both sides; the diagonal block only its own.
    placed = rows.join(reps.select("node", "doc_id", "a", "b", "n", "regs", "least"), "node").repartition(spread, "key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    kinds = "node long, doc_id long, a long, b long, key long, low int, high int, side int, component long, n long, regs array<short>, least array<long>"
    needed = cut(placed.select(*[x.split()[0] for x in kinds.split(", ")]).mapInArrow(_needed(num, den), kinds))
    sets = _full_sets(docs, needed.select("doc_id"), needed.select("a", "b"), ngram)
    more = needed.join(sets, ["a", "b"]).repartition(spread, "key", "low", "high").sortWithinPartitions("key", "low", "high", "node").mapInArrow(_linked(num, den), "a long, b long")
    # What the first round has hung stays so.
    nodes = components(edges.toDF("a", "b").unionByName(more))

    placed = reps.select("a", "b", "node", "doc_id").join(nodes, "node", "left").select("a", "b", "doc_id", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = spread_join(placed.select("a", "b", "component"), least, "component").select(F.col("a").alias("x"), F.col("b").alias("y"), "component_id")
    out = sketches.select("doc_id", "n", "a", "b").join(found, (F.col("a") == F.col("x")) & (F.col("b").bitwiseXOR(F.col("y")) == 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _same_id(known: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the nodes of doc_ids that have several: to the least of them. Without such ids, hardly any work."""
    several = known.groupBy("doc_id").agg(F.min("a").alias("x"), F.max("a").alias("y")).where("x <> y").select("doc_id")
    own = known.select("doc_id", "a", "b").join(several, "doc_id", "left_semi").join(reps.select("a", "b", "node"), ["a", "b"]).select("doc_id", "node")
    least = own.groupBy("doc_id").agg(F.min("node").alias("m"))
    return own.join(least, "doc_id").where("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b")).distinct()


def _full_sets(docs: DataFrame, ids: DataFrame, digests: DataFrame, ngram: int) -> DataFrame:
    """(a, b, shingles) of the wanted digests, from the texts of some doc_ids; each set once."""
    found = docs.select("doc_id", "text").join(ids.distinct(), "doc_id", "left_semi").mapInArrow(_sets(ngram), "a long, b long, shingles array<long>")
    return found.groupBy("a", "b").agg(F.any_value("shingles").alias("shingles")).join(digests.distinct(), ["a", "b"], "left_semi")


def _checked(docs: DataFrame, pairs: DataFrame, ngram: int, num: int, den: int) -> DataFrame:
    """The pairs whose full sets reach the threshold.

    Members meet their sets first; then those of one centre may be very many, so its set comes in an exchange of its own
    and Spark can split them.
    """
    x, y = pairs.select(F.col("x_a").alias("a"), F.col("x_b").alias("b")), pairs.select(F.col("y_a").alias("a"), F.col("y_b").alias("b"))
    # Kept, since plans over the same Python step are not shared, and the sets would be made twice.
    sets = cut(_full_sets(docs, pairs.select(F.explode(F.array("x_doc", "y_doc")).alias("doc_id")), x.unionByName(y), ngram))
    members = pairs.select("x", "y", F.col("x_a").alias("a"), F.col("x_b").alias("b"), F.col("y_a").alias("k"), F.col("y_b").alias("l")).join(sets, ["a", "b"])
    members = members.select("x", "y", "k", "l", F.col("shingles").alias("x_set"))
    centres = sets.join(y.distinct(), ["a", "b"]).select(F.col("a").alias("k"), F.col("b").alias("other"), F.col("shingles").alias("y_set"))
    both = spread_join(members, centres, "k").where(F.col("l").bitwiseXOR(F.col("other")) == 0)
    return both.where(reaching(F.col("x_set"), F.col("y_set"), num, den)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_dedup(docs: DataFrame, ngram: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each group of near copies, the one with the smallest doc_id; where that id repeats, the row whose text has
    the least hash. Rows without doc_id all stay. Columns are those of docs, whatever their names."""
    keep = near_groups(docs, ngram, num, den).where("kept and doc_id is not null").select("doc_id").distinct()
    # Rows that repeat an id are brought together before the shuffle, however many they are.
    one = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min_by(F.struct(*named(docs.columns)), F.xxhash64("text")).alias("_row"))
    return one.join(keep, "doc_id", "left_semi").select("_row.*").unionByName(docs.where(F.col("doc_id").isNull()))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 3-word shingles have a similarity of 0.85 or more."""
    return near_groups(table(spark, sf_dir, "documents"), ngram=3, num=85, den=100)
