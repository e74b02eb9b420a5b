"""From raw documents to packed sequences: each stage reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm.common import table
from popspark.llm.line_dedup import line_dedup
from popspark.llm.mixing import mix
from popspark.llm.near_dedup import near_dedup
from popspark.llm.packing import retrieval_pack
from popspark.llm.quality import quality_scores
from popspark.shared import fresh

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, does not reject. Null and empty texts have the score that
    the bias alone gives; rows that repeat a doc_id are judged each by its text; texts of any length are read whole; an empty
    table gives no rows. Columns other than those of documents end here."""
    return quality_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others keep; n_chars follows the text. A null text becomes an empty one; rows without
    doc_id keep all lines; rows that repeat one are one document. Texts of any length are split whole; an empty table gives no
    rows."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more. Rows without words or
    without doc_id all stay; of rows that repeat a doc_id, one does."""
    return near_dedup(docs, ngram=5, num=80, den=100).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, in target weights and one epoch; a document that its leaf's prefix reaches stays whole. Null
    sources and languages are leaves of their own, shown as ''; documents without words give no tokens and go. Rows that repeat a
    doc_id are taken each for itself, ties going by tokens; texts of any length are counted whole; an empty table gives no
    rows."""
    return mix(docs, per_mille=800, epochs=1).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document in its sequence, with its token ids. Null and empty texts are a piece of the end id
    alone; rows that repeat a doc_id are packed each for itself; a long text fills several sequences; ties among neighbours go
    to the earlier piece; an empty table gives no rows."""
    return retrieval_pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each gives is written to the shared folder and read again. Two folders take turns, so
    that no more than the last two stages' tables are kept."""
    where = fresh(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{where}/{'ab'[k % 2]}"
            docs.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
    return docs
