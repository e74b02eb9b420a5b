"""Substring dedup: a de Bruijn graph whose edges are the windows, named by digests of the words at their source coordinates;
repeated nonbranching paths are compacted by joins, and what branches is unfolded there into windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from popspark.llm.common import hash128, spread_join, table
from popspark.shared import written
from popspark.llm.words import windows, word_hashes
from popspark.shipping import ship

#: Words of a k-mer, the part of a window by which equal windows find each other.
KMER = 12


def anchors(words: np.ndarray, size: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k-mers that are least, by hash, in some window of ``size`` words: (hash, place, first window, last window).

    Which k-mer is a window's least (ties: the first) depends on the window's words alone, so equal windows have equal
    anchors at equal places. The windows of one anchor are consecutive.
    """
    n = len(words) - size + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    grams = windows(words, kmer, 7)
    span = size - kmer + 1
    # The place of the least k-mer of each window, by doubling: the least of two overlapping halves.
    least, width = np.arange(len(grams)), 1
    while width < span:
        step = min(width, span - width)
        m = len(least) - step
        one, other = least[:m], least[step : step + m]
        least = np.where(grams[other] < grams[one], other, one)
        width += step
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    stops = np.concatenate([starts[1:], [n]]) - 1
    place = least[starts]
    return grams[place], place, starts, stops


EDGES = "doc long, version long, gram long, span long, place long, copies int"
#: Where windows stand: the first and the last of them in a row of the table; edges have both in one number. doc and version
#: are 128 bits of a digest of the row's doc_id and text.
PLACE = ("doc", "version", "first", "last")


def _ends() -> tuple[Column, Column]:
    return F.shiftright("place", 32).alias("first"), F.col("place").bitwiseAND(0xFFFFFFFF).alias("last")


def _hashes(batch: pa.RecordBatch, bits: int) -> Iterator[np.ndarray]:
    """Hashes of the words of each text, of which ``bits`` bits are kept."""
    for words in word_hashes(batch.column("text")):
        yield words if bits == 64 else words & np.uint64((1 << bits) - 1)


def _edges(size: int, kmer: int, bits: int) -> Callable:
    """A row for each run of edges with one anchor, named by a digest of the words that it covers. Equal neighbours, as in a
    word said over and over, make one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            parts: list[tuple] = []
            for row, hashes in enumerate(_hashes(batch, bits)):
                gram, _, first, last = anchors(hashes, size, kmer)
                if len(gram):
                    words = texts[row].as_py().encode().split()
                    # The words with one space behind each, and where each begins.
                    line = b" ".join(words)
                    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
                    names = [hashlib.blake2b(line[a:b], digest_size=8).digest() for a, b in zip(ends[first].tolist(), (ends[last + size] - 1).tolist(), strict=True)]
                    span = np.frombuffer(b"".join(names), np.int64)
                    new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (span[1:] != span[:-1]) | (np.diff(last - first) != 0)]))
                    stop = np.concatenate([new[1:], [len(gram)]])
                    parts.append((np.full(len(new), row), gram[new].view(np.int64), span[new], first[new] << 32 | last[stop - 1], (stop - new).astype(np.int32)))
            if parts:
                row, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
                columns = [batch.column(c).take(pa.array(row)) for c in ("doc", "version")] + [*map(pa.array, rest)]
                for at in range(0, len(row), 1 << 17):
                    yield pa.RecordBatch.from_arrays([c.slice(at, 1 << 17) for c in columns], [x.split()[0] for x in EDGES.split(", ")])

    return run


def _names(words: list[bytes], size: int, first: np.ndarray | range) -> list[bytes]:
    """128 bits of a digest of the words themselves of each window."""
    return [hashlib.blake2b(b" ".join(words[k : k + size]), digest_size=16).digest() for k in first]


def _unfolded(size: int) -> Callable:
    """The windows of each path, one row each, from the words at its source coordinates; ``single`` where the path occurs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[bytes] = []
            out: list[list] = [[], [], [], []]
            for doc, version, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc", "version", "text", "paths")), strict=True):
                words = (text or "").encode().split()
                for x in found:
                    first = range(x["place"] >> 32, (x["place"] & 0xFFFFFFFF) + 1)
                    names += _names(words, size, first)
                    for column, values in zip(out, ([doc] * len(first), [version] * len(first), first, [x["n"] == 1] * len(first)), strict=True):
                        column.extend(values)
            digest = np.frombuffer(b"".join(names), np.int64)
            columns = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(digest[::2]), pa.array(digest[1::2])], ["doc", "version", "first", "single", "d", "e"])

    return run


def _cleaned(size: int, with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest, kept_text = [], [], [], []
            for text, found in zip(batch.column("text"), batch.column("places"), strict=True):
                words, removed = (text.as_py() or "").encode().split(), 0
                words_left = words
                if found.is_valid:
                    places = found.as_py()
                    turns = np.zeros(len(words) + size + 1, np.int64)
                    np.add.at(turns, [x["first"] for x in places], 1)
                    np.add.at(turns, [x["last"] + size for x in places], -1)
                    keep = np.cumsum(turns)[: len(words)] == 0
                    removed = len(words) - int(keep.sum())
                    words_left = list(compress(words, keep.tolist()))
                joined = b" ".join(words_left)
                n_words.append(len(words))
                n_removed.append(removed)
                digest.append(hashlib.sha256(joined).hexdigest())
                kept_text.append(joined.decode() if with_text else "")
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept_text, pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


WINDOWS = "doc long, version long, first long, single boolean, d long, e long"


def _branching(texts: DataFrame, forks: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Where paths branch: the edges whose path occurs again, and PLACE of the windows of the other ones that do.

    Each different path is unfolded into its windows once, from its source coordinates.
    """
    paths = forks.groupBy("gram", "span").agg(F.sum("copies").alias("n"), F.min(F.struct("doc", "version", "place")).alias("at"))
    again = paths.where("n > 1").select(F.col("gram").alias("of"), F.xxhash64("gram", "span").alias("path"))
    repeated = spread_join(forks.withColumn("path", F.xxhash64("gram", "span")), again, "path").where(F.col("gram") == F.col("of")).drop("of", "path")
    sources = paths.select("at.doc", "at.version", F.struct("at.place", "n").alias("s")).groupBy("doc", "version").agg(F.collect_list("s").alias("paths"))
    unfolded = texts.join(sources, ["doc", "version"]).mapInArrow(_unfolded(size), WINDOWS)
    twice = unfolded.groupBy("d", F.col("e").alias("x")).agg(F.count("*").alias("n")).where("n > 1").select("d", "x")
    found = spread_join(unfolded.where("single"), twice, "d").where(F.col("e").bitwiseXOR(F.col("x")) == 0)
    return repeated, found.select("doc", "version", "first", F.col("first").alias("last"))


def _compacted(edges: DataFrame) -> DataFrame:
    """Repeated edges (doc, version, first, last, piece, copies) as long spans (doc, version, first, last).

    An edge's out-degree counts what follows it in the texts, its in-degree what goes before it; the end of what repeats
    counts as one such thing, and so does a word said over and over. Where an edge has one successor only, and is the only
    predecessor of that one, the path goes on without a branching: a join of degrees finds these, and a join with all
    occurrences cuts them into spans, so that all occurrences of a span are the same edges.
    """
    order = Window.partitionBy("doc", "version").orderBy("first")
    # Equal texts of one doc_id are there once.
    once = edges.repartition("doc", "version").distinct()
    single = F.col("copies") == 1
    follows = F.coalesce((F.lead("first").over(order) == F.col("last") + 1) & single, F.lit(False))
    preceded = F.coalesce((F.lag("last").over(order) == F.col("first") - 1) & single, F.lit(False))
    near = lambda f, gap: F.when(gap, f("piece").over(order)).otherwise(F.lit(0).cast("long"))
    steps = once.withColumn("next", near(F.lead, follows)).withColumn("previous", near(F.lag, preceded))
    degrees = steps.groupBy("piece").agg(F.min("next").alias("n"), F.max("next").alias("m"), F.min("previous").alias("o"), F.max("previous").alias("p"))
    out = degrees.where("n = m and n <> 0").select(F.col("piece").alias("from"), F.col("n").alias("to"))
    into = degrees.where("o = p and o <> 0").select("piece", F.col("o").alias("source"))
    through = out.join(into, (F.col("to") == F.col("piece")) & (F.col("from") == F.col("source"))).select("piece", F.lit(True).alias("through"))
    marked = spread_join(steps.drop("next", "previous"), through, "piece", "left")
    runs = marked.withColumn("run", F.sum(F.when(F.col("through"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc", "version", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def substring_dedup(docs: DataFrame, size: int = 35, kmer: int = KMER, with_text: bool = True, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``with_text``, text: the words that stay, joined by one space.

    Words are runs of anything but white space; a null text has none. A word goes if it stands in a window of ``size``
    consecutive words whose sequence also starts anywhere else, in this document or another; windows are judged on the
    input. Rows that repeat a doc_id are documents of their own (told apart by 128 bits of a digest of doc_id and text); a null
    doc_id stays null.
    Texts of any length are read whole, a slice at a time. Other columns are not read. An empty table gives no rows.

    The graph: a window of ``size`` words is an edge between its first and its last size - 1 words. Edges travel as runs of
    consecutive ones that share an anchor, the least word k-mer (``kmer`` words) of each of them, so a twelfth of the words
    makes rows. Anchors that occur once are dropped. Of the others, paths count as equal by a digest of the words at their
    source coordinates, so the result is exact whatever the words' hashes do (``bits`` narrows them, to test that): where
    all paths of an anchor are equal, they repeat; where they branch, those that are there again repeat, and the others are
    unfolded into windows, which are counted by digests of their words. What repeats without branching is compacted.

    Counts are partly made before each shuffle, and what repeats meets the edges again in joins that Spark can split.
    Texts are shuffled once, for the unfolding and for the result.
    """
    ship(docs.sparkSession)
    doc, version = hash128(F.struct("doc_id", "text"))
    texts = docs.select("doc_id", doc.alias("doc"), version.alias("version"), "text")
    edges = texts.mapInArrow(_edges(size, kmer, bits), EDGES)
    grams = edges.groupBy("gram").agg(F.sum("copies").alias("n"), F.min("span").alias("x"), F.max("span").alias("y")).where("n > 1")
    hits = written(spread_join(edges, grams.select("gram", (F.col("x") != F.col("y")).alias("forks")), "gram"), "edges")
    repeated, windows = _branching(texts, hits.where("forks"), size)
    whole = hits.where("not forks").unionByName(repeated)
    runs = _compacted(whole.select("doc", "version", *_ends(), F.xxhash64("gram", "span").alias("piece"), "copies"))
    covered = runs.unionByName(windows).groupBy("doc", "version").agg(F.collect_list(F.struct("first", "last")).alias("places"))
    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return texts.join(covered, ["doc", "version"], "left").mapInArrow(_cleaned(size, with_text), kinds)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, how many stand in repeated passages, and the SHA-256 of the others."""
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False)
