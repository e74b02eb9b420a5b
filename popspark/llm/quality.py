"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from popspark.llm.common import named, table
from popspark.llm.words import mix, windows, word_hashes
from popspark.shipping import ship

#: Indicators are hashed into so many bits; the last place is that of the bias.
BITS = 17
SIZE = 1 << BITS
SLICE = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _places(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


class Indicators:
    """The n-grams that a text holds: of bytes (3), of words (1 and 2), and of "again", a word equal to the one before."""

    def __init__(self) -> None:
        self.seen = np.zeros(SIZE, bool)

    def of(self, text: memoryview | bytes, words: np.ndarray) -> np.ndarray:
        """The places of the indicators, in order."""
        seen, raw = self.seen, np.frombuffer(text, np.uint8)
        for at in range(0, max(len(raw) - 2, 0), SLICE):
            b = _LOWER[raw[at : at + SLICE + 2]].astype(np.uint32)
            grams = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
            seen[grams >> np.uint32(32 - BITS)] = True
        seen[_places(words ^ np.uint64(1))] = True
        seen[_places(windows(words, 2, 3))] = True
        again = words[1:] == words[:-1]
        for n in (1, 2, 3, 4):
            if len(again) >= n:
                code = sum(again[i : len(again) - n + 1 + i].astype(np.uint64) << np.uint64(i) for i in range(n))
                seen[_places(np.unique(code) + np.uint64(1000 * n))] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        return found


def _rows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    found = Indicators()
    texts = batch.column("text")
    for text, words in zip(texts, word_hashes(texts, lower=True), strict=True):
        yield found.of(text.as_buffer() if text.is_valid else b"", words)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Indicators as a bit map, so that a row's size has a bound whatever its text."""
    for batch in batches:
        bits = []
        for places in _rows(batch):
            row = np.zeros(SIZE, bool)
            row[places] = True
            bits.append(np.packbits(row).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pick", "doc_id", "quality")), pa.array(bits, pa.binary())], ["pick", "doc_id", "quality", "bits"])


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + offset))), margin = sum(weight) / sqrt(sum(square)) + bias over a text's indicators."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, places: np.ndarray) -> float:
        norm = float(self.square[places].sum())
        return float(self.weight[places].sum()) / norm**0.5 + self.bias if norm else self.bias

    def score(self, places: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(places) + self.offset, -30, 30))))


def ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The log of how much likelier each indicator is under label 1 than under label 0, each count one higher than it is."""
    counts = np.ones((2, SIZE))
    for places, y in zip(rows, labels, strict=True):
        counts[int(y), places] += 1
    counts /= counts.sum(1, keepdims=True)
    return np.log(counts[1] / counts[0])


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, c: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: the weights and the bias, which is a feature that is always 1."""
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(y))
    square = np.array([v @ v + 1 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(y)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), c)
            if step := (new - alpha[i]) * y[i]:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-4 * c:
            break
    return w, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, by Newton's method with slightly smoothed labels."""
    n1 = labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
    x, beta = np.stack([margins, np.ones_like(margins)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p))
        beta += step
        if abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 15, seed: int = 0) -> Model:
    """Three rows of four train the weights, the fourth sets the curve; with one label only, every score is that label's."""
    if len(set(labels.tolist())) < 2:
        p = float(labels.mean()) * 0.98 + 0.01 if len(labels) else 0.5
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 1.0, float(np.log(p / (1 - p))))
    held = np.arange(len(labels)) % 4 == 3
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held = np.zeros(len(labels), bool)
    train = np.flatnonzero(~held)
    r = ratios([rows[i] for i in train], labels[train])
    values = [r[rows[i]] for i in train]
    values = [v / max(np.linalg.norm(v), 1e-12) for v in values]
    w, bias = descend([rows[i] for i in train], values, labels[train] * 2.0 - 1, c, epochs, seed)
    model = Model(w * r, r * r, bias, 1.0, 0.0)
    curve = np.flatnonzero(held) if held.any() else train
    model.slope, model.offset = calibrate(np.array([model.margin(rows[i]) for i in curve]), labels[curve])
    return model


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def trained(docs: DataFrame, labels: DataFrame, fit_rows: int) -> Model:
    """A model from at most ``fit_rows`` labelled documents outside the held-out fifth: those with the least hash of doc_id."""
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    pick = F.xxhash64("doc_id")
    sample = known.where(remainder(F.col("doc_id")) != 0).select("doc_id", "quality", pick.alias("pick")).orderBy("pick", "doc_id").limit(fit_rows)
    # The sample has at most fit_rows rows of three numbers, so it can be broadcast whatever the corpus.
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("pick", "doc_id", "quality", "text")
    found = found.groupBy("pick", "doc_id", "quality").agg(F.min("text").alias("text"))
    bits = found.mapInArrow(_featured, "pick long, doc_id long, quality int, bits binary")
    # The sample meets in one task, whose memory its bound bounds; the driver gets the weights alone, 1 MB.
    got = bits.repartition(1).mapInArrow(_fitted(fit_rows), "weight binary, square binary, bias double, slope double, offset double").first()
    return Model(np.frombuffer(got["weight"], np.float32), np.frombuffer(got["square"], np.float32), got["bias"], got["slope"], got["offset"])


def _fitted(fit_rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = []
        for batch in batches:
            for pick, doc_id, bits, y in zip(*(batch.column(c).to_pylist() for c in ("pick", "doc_id", "bits", "quality")), strict=True):
                order.append((pick, doc_id, np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))).astype(np.int32), y))
        order = sorted(order, key=lambda x: x[:2])[:fit_rows]
        m = fit([x[2] for x in order], np.array([x[3] for x in order], np.int64))
        raw = [pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (m.weight, m.square)]
        numbers = [pa.array([float(x)]) for x in (m.bias, m.slope, m.offset)]
        yield pa.RecordBatch.from_arrays([*raw, *numbers], ["weight", "square", "bias", "slope", "offset"])

    return run


def _scored(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(places) for places in _rows(batch)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = 4000, threshold: float = 0.3) -> DataFrame:
    """docs with columns score (0 to 1; higher: label 1 likelier) and predicted (1 if score >= threshold, else 0).

    Only the text makes the score. An n-gram counts as there or not there, scaled by its class log-count ratio, and each
    text's vector is brought to length 1; null and empty texts have the bias alone. Labels other than 0 and 1 and those of
    the held-out fifth are not learned from; where a doc_id has both labels, 0 counts, and where
    it has several texts, the least one. Texts of any length are read whole, a slice at a time. Without labels every score is 0.5,
    with one label only all lean to it. An empty table gives no rows; other columns stay, but for score and predicted.

    ``fit_rows`` bounds the labelled sample, and each of its rows takes 16 KB, so the task that fits has a bound; the
    weights have a fixed size. Scoring is one pass without a shuffle.
    """
    ship(docs.sparkSession)
    model = trained(docs, labels, fit_rows)
    docs = docs.select(*named([c for c in docs.columns if c.lower() not in ("score", "predicted")]))
    # Names of any kind come back after the pass, which knows the text alone.
    plain = docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])
    fields = StructType([*plain.schema.fields, StructField("score", DoubleType())])
    return plain.mapInArrow(_scored(model), fields).toDF(*docs.columns, "score").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it is held out from learning, its score, and what that predicts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
