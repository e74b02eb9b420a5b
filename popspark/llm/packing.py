"""Packing by lexical retrieval: a window starts with a seed and is filled with what resembles it most."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm.common import table
from popspark.llm.tokens import default_tokenizer, id_type, word_tokens
from popspark.shared import cut
from popspark.shipping import ship

K1, B = 1.2, 0.75


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens)


def tokenized(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[Piece]:
    """Each document as one piece, the end id included."""
    encoder = word_tokens(path)
    end = np.array([end_id], np.uint32)
    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
            yield Piece(doc_id, 0, np.concatenate([ids, end]), len(ids) + 1)


@dataclass(frozen=True)
class Corpus:
    """What BM25 needs to know of all pieces: how many have each term, how many there are, and their mean length.

    It has a number for each token id of the tokenizer, so its size does not grow with the documents.
    """

    df: np.ndarray
    n: int
    mean: float

    def weights(self, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, term, weight) of each term of each piece, in order of pieces; ids are those of all pieces together."""
        pairs, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) << 32 | ids, return_counts=True)
        docs, terms = pairs >> 32, pairs & 0xFFFFFFFF
        idf = np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))
        scale = K1 * (1 - B + B * sizes / self.mean)
        return docs, terms, idf[terms] * (tf * (K1 + 1) / (tf + scale[docs]))


class Bm25:
    """An inverted index over the pieces of one shard, with the weights that all pieces of the corpus give.

    Terms that an eighth of the pieces have are kept as rows with a weight for every piece, as many as take 32 MB; the
    others as postings. Pieces that are used up can be left out of both.
    """

    def __init__(self, pieces: list[Piece], corpus: Corpus):
        self.n = len(pieces)
        docs, terms, weight = corpus.weights(np.array([len(p.ids) for p in pieces], np.int64), np.concatenate([p.ids for p in pieces]).astype(np.int64))
        _, local, df = np.unique(terms, return_inverse=True, return_counts=True)
        order = np.argsort(local, kind="stable")
        self.docs, self.weights = docs[order].astype(np.int32), weight[order]
        self.ends = np.concatenate([[0], np.cumsum(df)])
        self.df, self.local = df, local
        own = np.searchsorted(docs, np.arange(self.n + 1))
        self.first, self.last = own[:-1], own[1:]
        common = np.flatnonzero(df >= max(2, self.n // 8))
        common = common[np.argsort(-df[common], kind="stable")][: max(1, (32 << 20) // (8 * self.n))]
        self.row = np.full(len(df), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n))
        for i, t in enumerate(common.tolist()):
            at = slice(self.ends[t], self.ends[t + 1])
            self.rows[i, self.docs[at]] = self.weights[at]

    def keep(self, kept: np.ndarray) -> None:
        """Leave out the other pieces; those kept are numbered anew, in their order, and their scores stay the same."""
        left = kept[self.docs]
        self.docs, self.weights = (np.cumsum(kept, dtype=np.int32) - 1)[self.docs[left]], self.weights[left]
        self.ends = np.concatenate([[0], np.cumsum(left)])[self.ends]
        self.df = np.diff(self.ends)
        self.first, self.last = self.first[kept], self.last[kept]
        self.rows = np.compress(kept, self.rows, 1)
        self.n = len(self.first)

    def scores(self, piece: int) -> np.ndarray:
        """The score of each piece for all different terms of one of them."""
        terms = self.local[self.first[piece] : self.last[piece]]
        row = self.row[terms]
        out = np.zeros(self.n)
        for r in row[row >= 0].tolist():
            out += self.rows[r]
        few = terms[(row < 0) & (self.df[terms] > 1)]
        df = self.df[few]
        at = np.repeat(self.ends[few] - np.cumsum(df) + df, df) + np.arange(df.sum())
        np.add.at(out, self.docs[at], self.weights[at])
        return out

    def neighbours(self, piece: int, unused: np.ndarray) -> Iterator[int]:
        """Unused pieces that share a term with the seed, best first; ties to the earlier piece.

        The best are sorted alone, as a window seldom takes more, and the others only where it does.
        """
        scores = np.where(unused, self.scores(piece), 0)
        few = min(16, self.n)
        least = np.partition(scores, self.n - few)[self.n - few]
        for found in (np.flatnonzero((scores >= least) & (scores > 0)), np.flatnonzero((scores < least) & (scores > 0))):
            yield from found[np.argsort(-scores[found], kind="stable")].tolist()


def pack_shard(pieces: list[Piece], window: int, corpus: Corpus) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, and the pieces left over, which fill no window.

    Seeds come in order. A seed's neighbours enter its window by score; the first that does not fit is cut, and its rest
    stays in the index under the same terms. Where neighbours run out, the next unused pieces follow in order.
    """
    if sum(len(p.ids) for p in pieces) < window:
        return [], pieces
    index, rest, windows = Bm25(pieces, corpus), list(pieces), []
    unused = np.ones(len(pieces), bool)
    left = sum(len(p.ids) for p in pieces)
    first = 0
    while left >= window:
        if unused.sum() * 8 < 7 * len(unused):
            index.keep(unused)
            rest = [rest[i] for i in np.flatnonzero(unused)]
            unused = np.ones(len(rest), bool)
            first = 0
        while not unused[first]:
            first += 1
        filled, space = [rest[first]], window - len(rest[first].ids)
        unused[first] = False

        def put(i: int, filled: list[Piece] = filled) -> None:
            nonlocal space
            piece = rest[i]
            if len(piece.ids) > space:
                piece, rest[i] = piece.split(space)
            else:
                unused[i] = False
            filled.append(piece)
            space -= len(piece.ids)

        for i in index.neighbours(first, unused):
            if not space:
                break
            put(i)
        at = first
        while space:
            while not unused[at]:
                at += 1
            put(at)
        windows.append(filled)
        left -= window
    return windows, [rest[i] for i in np.flatnonzero(unused)]


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """What is left at the end of a partition, cut into sequences whose lengths are powers of two, so that none is padded."""
    left = sum(len(p.ids) for p in pieces)
    pieces, out = pieces[::-1], []
    while left:
        size = 1 << left.bit_length() - 1
        left -= size
        out.append([])
        while size:
            piece = pieces.pop()
            if len(piece.ids) > size:
                piece, rest = piece.split(size)
                pieces.append(rest)
            out[-1].append(piece)
            size -= len(piece.ids)
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
TOKENS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, ids binary"


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), types[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def numbered(sequences: list[list[Piece]], first: int, with_ids: bool) -> pa.RecordBatch:
    """A row for each piece."""
    rows: list[tuple] = []
    for k, sequence in enumerate(sequences):
        offset = 0
        for p in sequence:
            raw = p.ids.astype("<u4").tobytes()
            rows.append((p.doc_id, p.start, len(p.ids), zlib.crc32(raw), p.doc_tokens, 2 * (first + k), offset, *([raw] * with_ids)))
            offset += len(p.ids)
    return _columns(rows, SCHEMA + ", ids binary" * with_ids)


def _cut_up(path: str, kind: str, window: int, end_id: int, with_ids: bool) -> Callable:
    """Full windows of a document, each a sequence of its own, with an odd number; then what is left of it, without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        for piece in tokenized(batches, path, end_id):
            while len(piece.ids) >= window:
                full, piece = piece.split(window)
                raw = full.ids.astype("<u4").tobytes()
                rows.append((full.doc_id, full.start, window, zlib.crc32(raw), full.doc_tokens, 2 * number + 1, raw if with_ids else None))
                number += 1
            if len(piece.ids):
                rows.append((piece.doc_id, piece.start, len(piece.ids), None, piece.doc_tokens, None, piece.ids.astype(kind).tobytes()))
            if len(rows) >= 4096:
                yield _columns(rows, TOKENS)
                rows = []
        yield _columns(rows, TOKENS)

    return run


def _pieces(batch: pa.RecordBatch, kind: str) -> list[Piece]:
    doc_id, start, doc_tokens, ids = (batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))
    return [Piece(d, s, np.frombuffer(x, kind).astype(np.uint32), n) for d, s, n, x in zip(doc_id, start, doc_tokens, ids, strict=True)]


def _flat(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each row has, and all of them."""
    ids = batch.column("ids")
    ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(ids.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return np.diff(ends).astype(np.int64) // size, raw.view(kind).astype(np.int64)


def _frequencies(kind: str) -> Callable:
    """How many pieces of a task have each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << 17, np.int64)
        for batch in batches:
            if batch.num_rows:
                sizes, ids = _flat(batch, kind)
                pairs = np.sort(np.repeat(np.arange(len(sizes)), sizes) << 32 | ids)
                found = np.bincount(pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] & 0xFFFFFFFF)
                df = np.pad(df, (0, max(0, len(found) - len(df))))
                df[: len(found)] += found
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(df[terms], pa.int64())], ["term", "df"])

    return run


def _placed(kind: str, corpus: Corpus) -> Callable:
    """Pieces with the two terms that weigh most in them, of those that other pieces have too."""
    shared = corpus.df > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                docs, terms, weight = corpus.weights(*_flat(batch, kind))
                first = np.searchsorted(docs, np.arange(batch.num_rows))
                best = []
                weight = np.where(shared[terms], weight, 0)
                for _ in range(2):
                    top = np.maximum.reduceat(weight, first)
                    # The least term of those that weigh most.
                    at = np.where(weight == top[docs], terms, 1 << 40)
                    best.append(np.minimum.reduceat(at, first))
                    weight = np.where(terms == best[-1][docs], -1, weight)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.astype(np.int32)) for x in best)], [*batch.schema.names, "t1", "t2"])

    return run


def _packer(kind: str, window: int, shard_tokens: int, corpus: Corpus, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        pool: list[Piece] = []
        size = 0

        def give(sequences: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for at in range(0, len(sequences), 512):
                part = sequences[at : at + 512]
                yield numbered(part, number, with_ids)
                number += len(part)

        for batch in batches:
            pool += _pieces(batch, kind)
            size = sum(len(p.ids) for p in pool)
            if size >= shard_tokens:
                windows, pool = pack_shard(pool, window, corpus)
                yield from give(windows)
        windows, pool = pack_shard(pool, window, corpus)
        yield from give(windows + powers(pool))

    return run


def retrieval_pack(docs: DataFrame, tokenizer: str | None = None, window: int = 2048, end_id: int = 1, shard_tokens: int = 2_000_000, with_ids: bool = True) -> DataFrame:
    """A row for each piece of each document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with
    ``with_ids``, the ids (little-endian, 32 bits each).

    Sequences have exactly ``window`` tokens, but for a shard's last ones, whose lengths are powers of two; so no token is
    padding. Null and empty texts are documents of the end id alone; texts of any length are cut without loss. A null
    doc_id stays null; rows that repeat a doc_id are packed each for itself. Other columns are not read. An empty table
    gives no rows.

    Full windows of long documents are sequences at once; the rest is packed by retrieval. Document frequencies, the number
    of pieces and their mean length are counted over all of them. The index is sharded: pieces stand in the order of the two
    shared terms that weigh most in them, and ranges of that order of about ``shard_tokens`` tokens are the shards, so
    pieces that share their weightiest terms meet, wherever they were read; a range that holds more is several shards.
    Each shard is an inverted index with BM25 weights of the whole corpus; a seed's query has all its different terms.
    Token ids travel once, 16 bits each where the vocabulary allows it.
    """
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or default_tokenizer()
    kind = id_type(path)
    tokens = cut(docs.select("doc_id", "text").mapInArrow(_cut_up(path, kind, window, end_id, with_ids), TOKENS))
    whole = tokens.where("sequence_id is not null").withColumn("offset", F.lit(0).cast("long"))
    rest = tokens.where("sequence_id is null").select("doc_id", "start", "doc_tokens", "ids", "length")
    n, total = (x or 0 for x in rest.agg(F.count("*"), F.sum("length")).first())
    # A row for each token id of the vocabulary at most.
    counts = rest.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(_frequencies(kind), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(max([end_id, *counts.column("term").to_pylist()]) + 1, np.int64)
    df[counts.column("term").to_numpy()] = counts.column("df").to_numpy()
    corpus = Corpus(df, n, total / max(n, 1))
    placed = rest.drop("length").mapInArrow(_placed(kind, corpus), "doc_id long, start long, doc_tokens long, ids binary, t1 int, t2 int")
    placed = placed.withColumn("h", F.xxhash64("doc_id", "start", "ids"))
    order = ["t1", "t2", "h"]
    ranged = placed.repartitionByRange(max(1, -(-total // shard_tokens)), *order).sortWithinPartitions(*order)
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
    packed = ranged.drop(*order).mapInArrow(_packer(kind, window, 2 * shard_tokens, corpus, with_ids), SCHEMA + ", ids binary" * with_ids)
    return whole.select(*names).unionByName(packed)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens: a row for each piece."""
    return retrieval_pack(table(spark, sf_dir, "documents"), with_ids=False)
