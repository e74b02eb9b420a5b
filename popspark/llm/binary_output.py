"""Token-id output: best-fit-decreasing packing into id matrices with segment lengths and position resets."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm.common import table
from popspark.llm.packing import Piece, tokenized
from popspark.llm.tokens import default_tokenizer, id_type
from popspark.shared import fresh
from popspark.shipping import ship


class CapacityTree:
    """Bins by the room they have left; a segment tree over the room finds the fullest bin that still takes a length."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, bin) of the least room that is at least length; the bin leaves the tree."""
        at = self.leaves + length
        if not self.count[at]:
            while at > 1 and not (at % 2 == 0 and self.count[at + 1]):
                at >>= 1
            if at == 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """Bins of at most window: the longest item first, each into the bin that it fills best; ties to the earlier item."""
    tree, bins = CapacityTree(window), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if lengths[i] > window:
            raise ValueError("an item is longer than the window")
        if found := tree.take(lengths[i]):
            room, number = found
            bins[number].append(i)
        else:
            room, number = window, len(bins)
            bins.append([i])
        if room > lengths[i]:
            tree.put(room - lengths[i], number)
    return bins


SCHEMA = "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids_crc32 long, positions_crc32 long"


def position_type(window: int) -> str:
    return "<u2" if window <= 1 << 16 else "<u4"


def matrix_rows(sequences: list[list[Piece]], first: int, window: int, pad_id: int, kind: str, with_ids: bool) -> pa.RecordBatch:
    """A row for each sequence: its ids padded to the window, and positions that begin again at 0 with each segment; padding has position 0."""
    rows = []
    for k, pieces in enumerate(sequences):
        sizes = [len(p.ids) for p in pieces]
        n = sum(sizes)
        ids, positions = np.full(window, pad_id, kind), np.zeros(window, position_type(window))
        ids[:n] = np.concatenate([p.ids for p in pieces])
        positions[:n] = np.concatenate([np.arange(s) for s in sizes])
        raw, at = ids.tobytes(), positions.tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        rows.append((first + k, n, [p.doc_id for p in pieces], [p.start for p in pieces], ends, zlib.crc32(raw), zlib.crc32(at), *([raw, at] if with_ids else ())))
    names = ["sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids_crc32", "positions_crc32"] + ["ids", "positions"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64()] + [pa.binary()] * (2 * with_ids)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)


def _packer(path: str, kind: str, window: int, end_id: int, pad_id: int, shard_tokens: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        pool: list[Piece] = []
        size = 0

        def give(sequences: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for at in range(0, len(sequences), 128):
                yield matrix_rows(sequences[at : at + 128], number, window, pad_id, kind, with_ids)
                number += len(sequences[at : at + 128])

        for piece in tokenized(batches, path, end_id):
            while len(piece.ids) > window:
                full, piece = piece.split(window)
                pool.append(full)
                size += window
            pool.append(piece)
            size += len(piece.ids)
            if size >= shard_tokens:
                yield from give([[pool[i] for i in b] for b in best_fit([len(p.ids) for p in pool], window)])
                pool, size = [], 0
        yield from give([[pool[i] for i in b] for b in best_fit([len(p.ids) for p in pool], window)])

    return run


def pack_matrices(docs: DataFrame, tokenizer: str | None = None, window: int = 2048, end_id: int = 1, pad_id: int = 0, shard_tokens: int = 2_000_000, with_ids: bool = True) -> DataFrame:
    """A row for each sequence: sequence_id, n_tokens, doc_ids, starts, cu_seqlens, ids_crc32, positions_crc32 and, with
    ``with_ids``, ids and positions (little-endian, padded to the window; ids have 16 bits where the vocabulary allows it,
    positions where the window does, else 32).

    Segment i of a sequence holds the ids of doc_ids[i] from starts[i] on, at cu_seqlens[i] up to cu_seqlens[i + 1]. A
    document of over ``window`` tokens is cut into full windows and a rest; none of its ids is lost. Null and empty texts
    are documents of the end id alone; a null doc_id stays null; repeated rows are packed each for itself. Other columns
    are not read. An empty table gives no rows.

    Best-fit-decreasing runs over shards of about ``shard_tokens`` tokens, inside the task that read them: no shuffle.
    """
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    run = _packer(path, id_type(path), window, end_id, pad_id, shard_tokens, with_ids)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + ", ids binary, positions binary" * with_ids)


def write_matrices(packed: DataFrame, path: str, window: int = 2048) -> None:
    """Parquet files of matrix rows; every row holds exactly window ids and positions."""
    packed.withColumn("window", F.lit(window)).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """Written matrix rows, with digests of the ids and positions as the files hold them."""
    rows = spark.read.parquet(path)
    return rows.select("sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"), "ids", "positions", "window")


def op10_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as id matrices of 2048 columns, written to the shared folder and read back: what each row holds, with
    digests of its ids and positions as they stand in the files."""
    path = fresh(spark, "matrices")
    write_matrices(pack_matrices(table(spark, sf_dir, "documents")), path)
    return read_matrices(spark, path).select(*[x.split()[0] for x in SCHEMA.split(", ")])
