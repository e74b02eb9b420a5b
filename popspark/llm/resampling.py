"""Importance resampling to a target's distribution: hashed n-gram counts of both corpora, weights, and a Gumbel top-k draw."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import LongType, StructType

from popspark.llm.common import named, table
from popspark.shared import written
from popspark.shipping import ship

#: What each byte of a UTF-8 text becomes: A-Z in lower case, other ASCII but a-z and 0-9 a space, the rest as it is.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Bytes of a text whose words are in memory at once.
SLICE = 1 << 20
#: Rows that one task ranks, about.
ROWS = 500_000


def word_slices(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text, in order, a slice at a time; a word is never cut."""
    data = (text or "").encode().translate(TABLE)
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + SLICE) if at + SLICE < len(data) else len(data)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


def features(text: str | None, most: int) -> tuple[int, Counter[int]]:
    """How many words a text has, and how often each feature's checksum comes.

    The checksum of a run goes on from that of the run without its last word, so no run is ever put together. Words that a
    slice's first runs need are carried over from the slice before.
    """
    found: Counter[int] = Counter()
    total, kept = 0, []
    for words in word_slices(text):
        total += len(words)
        if most == 1:
            for word, n in Counter(words).items():
                found[crc32(word)] += n
            continue
        words = kept + words
        seeds = list(map(crc32, words))
        spaced = [b" " + w for w in words]
        for size in range(1, most + 1):
            if size > 1:
                seeds = list(map(crc32, spaced[size - 1 :], seeds))
            found.update(seeds[max(0, len(kept) - size + 1) :])
        kept = words[max(0, len(words) - most + 1) :]
    return total, found


def _arrays(found: Counter[int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each feature, and its count."""
    return np.fromiter(found.keys(), np.int64, len(found)) % buckets, np.fromiter(found.values(), np.int64, len(found))


def _counted(most: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, *_arrays(features(text.as_py(), most)[1], buckets))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, most: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket: a task sends a row for each bucket at most, and the driver gets
    one for each."""
    parts = texts.select("text").mapInArrow(_counted(most, buckets), "bucket long, n long")
    rows = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm by which the target prefers each bucket, one added to each count, rounded down."""
    s, t, buckets = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weighed(gain: np.ndarray, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts, weights = [], [], []
            for text in batch.column("text"):
                n, found = features(text.as_py(), most)
                place, times = _arrays(found, len(gain))
                words.append(n)
                counts.append(int(times.sum()))
                weights.append(int(gain[place] @ times))
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(x, pa.int64()) for x in (words, counts, weights)],
                [*kept, "n_words", "n_features", "weight"],
            )

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from a digest of seed and doc_id (a null one counts as empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _ranked(scored: DataFrame, percent: int, rows: int) -> DataFrame:
    """(row, rank) of the drawn rows: dealt into ranges of the order, numbered within each, behind the rows of those before it."""
    n = scored.count()
    drawn = percent * n // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranges = scored.repartitionByRange(max(1, -(-n // rows)), *order).select("*", F.spark_partition_id().alias("part"))
    dealt = written(ranges, "ranges")
    # One row for each range, so as many as there are documents by ``rows``.
    before, offsets = 0, []
    for part, size in sorted(map(tuple, dealt.groupBy("part").count().collect())):
        if before < drawn:
            offsets.append((part, before))
        before += size
    starts = F.broadcast(scored.sparkSession.createDataFrame(offsets, "part int, before long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.join(starts, "part").select("row", (F.col("before") + place).cast("long").alias("rank")).where(F.col("rank") <= drawn)


def importance_scores(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, min_words: int = 20, with_rows: bool = False, rows: int = ROWS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for each row of docs and, with ``with_rows``, its own columns as the
    struct ``document``; target needs a column ``text``.

    Features are all runs of 1 to ``most`` words. The weight of a row adds up what its features' buckets gain in the target's
    distribution over that of docs, both counted in full; the score adds Gumbel noise, so that the highest scores are a
    sample without replacement in proportion to the weights' exponentials. Of the N rows with at least ``min_words`` words,
    floor(percent * N / 100) are drawn and ranked from 1, ties to the smaller doc_id; the others' rank is null.

    Null and empty texts have no features and weight 0. A null doc_id counts as an empty one for the noise and comes last among
    ties. Rows that repeat a doc_id are scored and drawn each for itself. Texts of any length are counted whole, slice by
    slice. An empty docs gives no rows; an empty target makes all buckets equal there.

    Two passes over the texts, no shuffle of them. What the driver holds is a number for each bucket, and a row for each
    range of ``rows`` rows, in which ranks are given.
    """
    ship(docs.sparkSession)
    gain = gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))
    kept = F.struct(*named(docs.columns)).alias("document") if with_rows else None
    base = docs.select("doc_id", "text", *([kept] if with_rows else []))
    kinds = StructType([f for f in base.schema if f.name != "text"])
    for c in ("n_words", "n_features", "weight"):
        kinds.add(c, LongType())
    weighed = base.mapInArrow(_weighed(gain, most), kinds)
    scored = written(weighed.select("*", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), F.monotonically_increasing_id().alias("row")), "scored")
    ranks = _ranked(scored.where(F.col("n_words") >= min_words).select("row", "doc_id", "score"), percent, rows)
    return scored.join(ranks, "row", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank", *(["document"] if with_rows else []))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the distribution of the benchmark's words."""
    found = importance_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: Checksums by a table of 256 entries, over the distinct words alone.
SQL = r"""
with recursive crc_table(i, c, step) as (
  select range::bigint, range::bigint, 0 from range(256)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, step + 1 from crc_table where step < 8
), entries as (select list(c order by i) as t from crc_table where step = 8
), words as (
  select 0 as kind, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from documents
  union all
  select 1, null, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark
), counted as (select kind, doc_id, word, count(*) as n from words group by all
), vocabulary as (select distinct word, hex(encode(word)) as digits from counted
), buckets as (
  select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(digits), 2), lambda k: ('0x' || substr(digits, k, 2))::bigint)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 as bucket
  from vocabulary, entries
), sums as (
  select bucket, sum(n) filter (kind = 0)::double as s, sum(n) filter (kind = 1)::double as t from counted join buckets using (word) group by bucket
), gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((select coalesce(sum(s), 0) from sums) + 10000) / ((coalesce(s, 0) + 1) * ((select coalesce(sum(t), 0) from sums) + 10000))))::bigint as gain from sums
), weights as (
  select doc_id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from counted join buckets using (word) join gains using (bucket) where kind = 0 group by doc_id
), scored as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from documents left join weights using (doc_id)
), ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_features >= 20
)
select s.doc_id, s.n_features, s.weight, s.score, r.rank
from scored s left join ranked r on s.doc_id = r.doc_id and r.rank <= 10 * r.n // 100
"""
