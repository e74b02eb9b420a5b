"""Alignment of two tokenizers' ids over the same bytes, and how often each pair of ids ends together."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm.common import table
from popspark.llm.tokens import _byte_letters
from popspark.shared import fresh, written
from popspark.shipping import ship

#: Bytes of text that are handled at once.
SLICE = 1 << 19
#: When a worker's cache holds more chunks than this, it starts anew.
CHUNKS = 250_000
#: Ends of the shorter list that search the longer one side by side, and how far apart those are that gallop.
STRIDE, ANCHOR = 8192, 32
#: Chunks that are tokenized as one text.
TOGETHER = 256
#: Pairs of ids whose counts go to every task; those of all others are joined.
COMMON = 1_000_000


def _bisected(long: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where each x would go among long[low:high], side by side."""
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        less = (long[np.minimum(middle, len(long) - 1)] < x) & open_
        low = np.where(less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return low


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in both sorted lists of what they share.

    Elements of the shorter list drive, a stride of them at a time: every ANCHOR-th and the last one gallop, from where the
    stride before ended, in steps into the longer list that double until they reach the element, and a binary search closes the
    last step. Those in between search the stretch that their neighbours leave.
    """
    in_short, in_long = [], []
    at = 0
    for first in range(0, len(short), STRIDE):
        if at >= len(long):
            break
        x = short[first : first + STRIDE]
        which = np.append(np.arange(0, len(x) - 1, ANCHOR), len(x) - 1)
        goal = x[which]
        low, step = np.full(len(goal), at), np.ones(len(goal), np.int64)
        while True:
            reach = np.minimum(at + step, len(long)) - 1
            behind = (long[reach] < goal) & (at + step < len(long))
            if not behind.any():
                break
            low[behind] = reach[behind] + 1
            step[behind] *= 2
        found = _bisected(long, goal, low, np.minimum(at + step, len(long)))
        between = np.minimum(np.arange(len(x)) // ANCHOR, len(which) - 1)
        low = _bisected(long, x, found[between], found[np.minimum(between + 1, len(which) - 1)])
        met = (low < len(long)) & (long[np.minimum(low, len(long) - 1)] == x)
        in_short.append(first + np.flatnonzero(met))
        in_long.append(low[met])
        at = int(low[-1])
    empty = np.empty(0, np.int64)
    return np.concatenate(in_short or [empty]), np.concatenate(in_long or [empty])


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the ends that both have; the shorter list drives."""
    if len(a) <= len(b):
        return gallop(a, b)
    j, i = gallop(b, a)
    return i, j


class _Store:
    """Ids and their byte lengths, a stretch for each chunk."""

    def __init__(self):
        self.ids, self.sizes = np.empty(1 << 18, np.uint32), np.empty(1 << 18, np.uint32)
        self.begin, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def put(self, place: int, ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> None:
        """Stretches of so many ids each, for the chunks from ``place`` on."""
        while self.used + len(ids) > len(self.ids):
            self.ids, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.ids, self.sizes))
        while place + len(counts) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        self.ids[self.used : self.used + len(ids)] = ids
        self.sizes[self.used : self.used + len(ids)] = sizes
        self.begin[place : place + len(counts)] = self.used + np.cumsum(counts) - counts
        self.count[place : place + len(counts)] = counts
        self.used += len(ids)

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, byte lengths, and for each place where its stretch stops."""
        counts = self.count[places]
        stops = np.cumsum(counts)
        where = np.repeat(self.begin[places] - stops + counts, counts) + np.arange(stops[-1] if len(stops) else 0)
        return self.ids[where], self.sizes[where], stops


class Pair:
    """Both tokenizers. A text with a space before it is cut before each single space that stands behind a letter, digit or
    sign: there both begin a new token whatever stands on the other side, as A's words take one space before them and no
    piece of B has a space behind another sign. Chunks between cuts are tokenized once and kept."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = {ord(c): b for b, c in _byte_letters().items()}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            plain = all(ord(c) in back for c in entry)
            self.a_bytes[i] = bytes(back[ord(c)] for c in entry) if plain else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(" " in x.decode(errors="replace").lstrip(" ") for x in self.b_bytes):
            raise ValueError("a piece of the second tokenizer goes on behind a space")
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.uint32, len(x)) for x in (self.a_bytes, self.b_bytes))
        self._reset()

    def _reset(self) -> None:
        self.place: dict[bytes, int] = {}
        self.fine = np.zeros(1 << 16, bool)
        self.in_a, self.in_b = _Store(), _Store()

    def _learn(self, chunks: list[bytes]) -> None:
        """Chunks that may stand side by side go through the tokenizers together; others, and all where a token crosses two of
        them, one by one."""
        plain = [c for c in chunks if _stands(c)]
        rest = [c for c in chunks if not _stands(c)]
        for part, together in ((plain, TOGETHER), (rest, 1)):
            if part and not self._taken(part, together):
                self._taken(part, 1)

    def _taken(self, chunks: list[bytes], together: int) -> bool:
        texts = [b"".join(chunks[i : i + together]).decode() for i in range(0, len(chunks), together)]
        bounds = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        found = []
        for ids, table, sizes in (([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.a_bytes, self.a_sizes), (self.b.encode([t[1:] for t in texts], num_threads=1), self.b_bytes, self.b_sizes)):
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum()))
            tokens = [table[i] for i in flat.tolist()]
            if together > 1:
                ends = np.cumsum(sizes[flat], dtype=np.int64)
                stops = np.searchsorted(ends, bounds)
                if b"".join(tokens) != b"".join(chunks) or (ends[np.minimum(stops, len(ends) - 1)] != bounds).any():
                    return False
                counts, fine = np.diff(stops + 1, prepend=0), np.ones(len(chunks), bool)
            else:
                fine = _given_back(chunks, counts, tokens)
            found.append((flat, sizes[flat], counts, fine))
        n = len(self.place)
        while n + len(chunks) > len(self.fine):
            self.fine = np.concatenate([self.fine, np.zeros_like(self.fine)])
        self.fine[n : n + len(chunks)] = found[0][3] & found[1][3]
        for store, (flat, size, counts, _) in zip((self.in_a, self.in_b), found, strict=True):
            store.put(n, flat, size, counts)
        self.place.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        return True

    def chunks(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the chunks of texts that begin at ``starts`` begin, and what place each has in the stores."""
        if len(self.place) > CHUNKS:
            self._reset()
        here = np.zeros(len(data), bool)
        here[starts] = here[cuts(data)] = True
        begins = np.flatnonzero(here)
        offsets = np.append(begins, len(data)).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = column.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [c for c in distinct if c not in self.place]
        if new:
            self._learn(new)
        return begins, np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[np.asarray(coded.indices)]


def _stands(chunk: bytes) -> bool:
    """Whether a chunk begins and ends as a cut asks for, so that others may stand on both sides."""
    return len(chunk) > 1 and chunk[0] == 32 != chunk[1] and (32 < chunk[-1] < 127 or chunk[-1] >= 128 and 0xC3 <= chunk[-2] <= 0xDF)


def _given_back(chunks: list[bytes], counts: np.ndarray, tokens: list[bytes]) -> np.ndarray:
    """Whether the bytes of each chunk's tokens are the chunk's."""
    stops = np.cumsum(counts)
    whole, made = b"".join(chunks), b"".join(tokens)
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))])
    if whole == made and (ends[stops] == np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))).all():
        return np.ones(len(chunks), bool)
    return np.array([made[i:j] == c for c, i, j in zip(chunks, ends[stops - counts].tolist(), ends[stops].tolist(), strict=True)], bool)


def cuts(data: np.ndarray) -> np.ndarray:
    """Where a chunk may begin: at a space behind a visible ASCII sign or a letter of two bytes, and not before another space or
    the end."""
    if len(data) < 3:
        return np.empty(0, np.int64)
    sign = (data > 32) & (data < 127)
    two = np.zeros(len(data), bool)
    two[1:] = (data[1:] >= 128) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    at = np.flatnonzero(data[1:-1] == 32) + 1
    return at[(sign | two)[at - 1] & (data[at + 1] != 32)]


_LOADED: dict[tuple[str, str], Pair] = {}


def pair_of(a_path: str, b_path: str) -> Pair:
    """Both tokenizers and one cache for each worker process."""
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Pair(a_path, b_path)
    return _LOADED[a_path, b_path]


@dataclass
class Aligned:
    """What is known of one text so far: counts, and for each group its A and its B ids."""

    fine: bool = True
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    text: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    links: list[np.ndarray] = field(default_factory=list)
    groups: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    def add(self, a: np.ndarray, b: np.ndarray, a_stops: np.ndarray, b_stops: np.ndarray, written_out: str, keep: bool) -> None:
        """Appends groups: ids of both sides, and where each group's stop."""
        if self.n_groups:
            self.text.update(b";")
        self.text.update(written_out.encode())
        # What ends a group ends together: one link a group, as no token is empty.
        self.links.append(a[a_stops - 1].astype(np.uint64) << np.uint64(32) | b[b_stops - 1])
        if keep:
            self.groups.append((a, b, a_stops + self.n_a, b_stops + self.n_b))
        self.n_a += len(a)
        self.n_b += len(b)
        self.n_groups += len(a_stops)


class Writer:
    """Groups as text: the decimal ids of A, |, those of B; groups joined by a semicolon."""

    def __init__(self, n: int):
        self.words = [f"{i}{end}" for i in range(n) for end in ",|;"]

    def write(self, a: np.ndarray, b: np.ndarray, a_stops: np.ndarray, b_stops: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The words of all groups in order, and for each group where its words stop."""
        a_of, b_of = np.diff(a_stops, prepend=0), np.diff(b_stops, prepend=0)
        ends = a_stops + b_stops
        out = np.empty(len(a) + len(b), np.int64)
        # A group's A ids come behind all ids of the groups before it, its B ids behind its own A ids as well.
        in_a = np.arange(len(a)) + np.repeat(b_stops - b_of, a_of)
        in_b = np.arange(len(b)) + np.repeat(a_stops, b_of)
        out[in_a], out[in_b] = a.astype(np.int64) * 3, b.astype(np.int64) * 3
        out[in_a[a_stops - 1]] += 1
        out[in_b[b_stops - 1]] += 2
        return list(map(self.words.__getitem__, out.tolist())), ends


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Slices of texts with a space before each: (bytes, where texts begin, which texts). A long text comes in parts, which
    begin where a chunk may."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = np.asarray(pc.binary_length(column))
    at = 0
    while at < len(column):
        if sizes[at] > SLICE:
            data = np.frombuffer(b" " + column[at].as_py().encode(), np.uint8)
            first = 0
            while first < len(data):
                stop = first + SLICE
                while stop < len(data) and not len(found := cuts(data[stop - 2 : stop + SLICE])):
                    stop += SLICE - 2
                stop = stop - 2 + int(found[0]) if stop < len(data) else len(data)
                yield data[first:stop], np.zeros(1, np.int64), [at]
                first = stop
            at += 1
            continue
        stop, total = at + 1, sizes[at]
        while stop < len(column) and total + sizes[stop] <= SLICE:
            total += sizes[stop]
            stop += 1
        part = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column.slice(at, stop - at), pa.scalar(" ", pa.large_string()))
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        yield np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], list(range(at, stop))
        at = stop


def align_texts(column: pa.Array, pair: Pair, writer: Writer, keep: bool = False) -> list[Aligned]:
    """Both tokenizers' ids of each whole text in groups. A text whose tokens do not give its bytes back is not ``fine``."""
    out = [Aligned() for _ in range(len(column))]
    empty = np.asarray(pc.fill_null(pc.binary_length(column), 0)) == 0
    for data, starts, which in _texts(column):
        begins, places = pair.chunks(data, starts)
        of = np.searchsorted(starts, begins, "right") - 1
        bad = np.zeros(len(which), bool)
        bad[of[~pair.fine[places]]] = True
        for k in np.flatnonzero(bad | empty[which]):
            out[which[k]].fine = False
        good = np.array([out[t].fine for t in which])
        used = good[of]
        of, places = of[used], places[used]
        if not len(of):
            continue
        a, a_sizes, a_chunks = pair.in_a.of(places)
        b, b_sizes, b_chunks = pair.in_b.of(places)
        i, j = common_ends(np.cumsum(a_sizes, dtype=np.int64), np.cumsum(b_sizes, dtype=np.int64))
        a_stops, b_stops = i + 1, j + 1
        words, ends = writer.write(a, b, a_stops, b_stops)
        # A text ends with its last chunk, and there a group ends.
        last = np.flatnonzero(np.diff(of, append=-1))
        first_a = first_b = first_g = first_w = 0
        for k, stop_a, stop_b in zip(of[last], a_chunks[last], b_chunks[last], strict=True):
            stop_g = int(np.searchsorted(a_stops, stop_a)) + 1
            stop_w = int(ends[stop_g - 1])
            text = "".join(words[first_w:stop_w])[:-1]
            out[which[k]].add(a[first_a:stop_a], b[first_b:stop_b], a_stops[first_g:stop_g] - first_a, b_stops[first_g:stop_g] - first_b, text, keep)
            first_a, first_b, first_g, first_w = int(stop_a), int(stop_b), stop_g, stop_w
    return out


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
GROUPS = ["a_ids", "b_ids", "a_stops", "b_stops"]


def _aligned(a_path: str, b_path: str, keep: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_path, b_path)
        writer = Writer(max(len(pair.a_bytes), len(pair.b_bytes)))
        for whole in batches:
            for batch in _pieces(whole):
                found = align_texts(batch.column("text"), pair, writer, keep)
                none = Aligned(fine=False)
                found = [x if x.fine and x.n_groups else none for x in found]
                columns = {"doc_id": batch.column("doc_id")}
                columns |= {c: pa.array([getattr(x, "n_groups" if c == "n_links" else c) for x in found], pa.int64()) for c in COUNTS}
                columns["groups_sha256"] = pa.array([x.text.hexdigest() if x.n_groups else "" for x in found])
                columns["links"] = pa.array([np.concatenate(x.links or [np.empty(0, np.uint64)]).tobytes() for x in found], pa.binary())
                if keep:
                    none = np.empty(0, np.int64)
                    for k, c in enumerate(GROUPS):
                        columns[c] = pa.array([np.concatenate([g[k] for g in x.groups] or [none]).astype(np.int64) for x in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about a slice's bytes: what comes out is several times as large as what goes in."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64))
    at = 0
    while at < len(batch):
        done = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, done + SLICE, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, with_groups: bool = False) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links and, with
    ``with_groups``, a_ids, b_ids, a_stops and b_stops (ids of both, and for each group where its ids stop in each).

    A is a byte-level tokenizer file, which reads a space and the text; B a piece model, which adds the space itself. Control
    tokens' strings inside texts are plain text. Where tokens of both end after the same byte, a group ends. links holds the two
    ids that end there, 8 bytes a link: the second id's four low bytes, then the first's (little-endian).

    Texts that are null or empty, or that the tokens of either do not give back byte by byte, have no tokens: zeros, and ''
    as digest. doc_id is passed on, null or repeated as it may be; other columns are not read; an empty table gives no rows.
    Texts of any length are aligned whole, in parts that begin where a chunk may.
    """
    import public_tokenizers

    ship(docs.sparkSession)
    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
    more = "".join(f", {c} array<long>" for c in GROUPS) if with_groups else ""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_aligned(a_path, b_path, with_groups), kinds + more)


def _links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All links of a batch, and which row each is of."""
    column = batch.column("links")
    flat = np.frombuffer(b"".join(x.as_py() for x in column), np.uint64)
    return flat, np.repeat(np.arange(len(column)), np.asarray(pc.binary_length(column)) // 8)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs that a task reads; a bounded number of them is held."""
    pairs, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64)), pa.array(counts)], ["pair", "n"])

    for batch in batches:
        flat, n = np.unique(_links(batch)[0], return_counts=True)
        both, at = np.unique(np.concatenate([pairs, flat]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
        pairs = both
        if len(pairs) > COMMON:
            yield given()
            pairs, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    yield given()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) of all links: how often each pair of ids (a * 2**32 + b) ends together, and whether no other has its
    second id more often."""
    parts = aligned.select("links").mapInArrow(_pair_counts, "pair long, n long")
    totals = written(parts.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    highest = totals.groupBy((F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))).alias("b")).agg(F.max("n").alias("most"))
    both = totals.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))).join(highest, "b")
    return both.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(pairs: np.ndarray, n: np.ndarray, best: np.ndarray) -> Callable:
    """Sums over a row's links of what is known of their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, row = _links(batch)
            at = np.minimum(np.searchsorted(pairs, flat), max(0, len(pairs) - 1))
            known = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
            row, at = row[known], at[known]
            # Whole numbers, added as such.
            sums = np.zeros((2, len(batch)), np.int64)
            np.add.at(sums[0], row, best[at].astype(np.int64))
            np.add.at(sums[1], row, n[at])
            kept = [c for c in batch.schema.names if c != "links"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(sums[0]), pa.array(sums[1])], [*kept, "n_best", "count_sum"])

    return run


def _rare(pairs: np.ndarray) -> Callable:
    """(row, pair, times) of the links whose pair is not among the given ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, row = _links(batch)
            at = np.minimum(np.searchsorted(pairs, flat), max(0, len(pairs) - 1))
            odd = pairs[at] != flat if len(pairs) else np.ones(len(flat), bool)
            both = np.rec.fromarrays([row[odd], flat[odd]], names="row,pair")
            found, times = np.unique(both, return_counts=True)
            rows = np.asarray(batch.column("row"))[found["row"]]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(found["pair"].view(np.int64)), pa.array(times)], ["row", "pair", "times"])

    return run


def scored_alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, common: int = COMMON) -> DataFrame:
    """``align`` without links, and of each row n_best (links whose pair is its second id's most frequent one in the corpus, ties
    included) and count_sum (the sum of its links' corpus-wide counts).

    Texts are tokenized once; their links are kept in the shared folder, counted by task and added up. The ``common`` pairs
    that come most often are looked up inside tasks; links of the others, few by their nature, are joined with their counts.
    """
    spark = docs.sparkSession
    # Small row groups: links are large, and a writer holds a group of them.
    path = fresh(spark, "aligned")
    align(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()).write.option("parquet.block.size", 8 << 20).parquet(path)
    aligned = spark.read.parquet(path)
    counts = written(pair_counts(aligned), "counts")
    # At most ``common`` rows.
    top = counts.orderBy(F.desc("n"), "pair").limit(common).toArrow()
    top = top.set_column(0, "pair", pa.array(top.column("pair").to_numpy().view(np.uint64))).sort_by("pair")
    pairs = top.column("pair").to_numpy()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name != "links") + ", n_best long, count_sum long"
    out = aligned.mapInArrow(_looked_up(pairs, top.column("n").to_numpy(), top.column("best").to_numpy(zero_copy_only=False)), kinds)
    if counts.count() > len(pairs):
        links = aligned.select("row", "links").mapInArrow(_rare(pairs), "row long, pair long, times long")
        rest = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more"))
        out = out.join(rest, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0)))
    return out.select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers' ids of every document in groups, with the corpus-wide counts of the pairs that end together."""
    return scored_alignment(table(spark, sf_dir, "documents"))
