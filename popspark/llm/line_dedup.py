"""Line dedup: lines that many documents share stay in one document only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm.common import SPACE, ascii_lower, hash128, named, table


def line_keys(lines: Column) -> Column:
    """The lines without white space at their ends and with A-Z lower-cased."""
    return F.transform(F.transform(lines, lambda x: F.btrim(x, F.lit(SPACE))), ascii_lower)


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with columns text (rewritten), n_lines, n_dropped; other columns stay as they are, whatever their names.

    A text is split at line feeds; null counts as empty, which is one empty line. Keys of at least ``min_chars`` code
    points that occur in at least ``min_docs`` documents lose their lines except in the largest doc_id that holds them,
    where all of them stay. Rows that repeat a doc_id are one document, and each of them keeps or loses its lines by that
    rule. Rows without doc_id count for no line and keep all of theirs. A document whose lines all go keeps an empty text.
    Texts of any length are read whole; the lines of one text are together in one row. An empty table gives no rows.

    Keys travel as 128-bit hashes, once a document: a shuffle by key and document makes them distinct, whatever a line's
    share of the documents, and partial counts go on to the keys. Only the keys above the threshold meet the lines again,
    in a join whose hot keys Spark can split. (That is why it joins by half of the hash: the counts, dealt by the whole
    hash, then get an exchange of their own.)
    """
    clean = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    # Only names of this function's own beside the row that holds the columns.
    rows = docs.select(F.struct(*named(clean)).alias("row"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("body"))
    # With the text's hash, rows that repeat an id stay apart.
    rows = rows.withColumn("version", F.xxhash64("body"))
    lines = F.split("body", "\n", -1)

    def keyed(key: Column, i: Column) -> Column:
        a, b = hash128(key)
        return F.when(F.length(key) >= min_chars, F.struct(a.alias("a"), b.alias("b"), i.cast("int").alias("pos")))

    all_keys = rows.where("id is not null").select("id", "version", F.transform(line_keys(lines), keyed).alias("k"))
    keys = all_keys.select("id", "version", F.explode(F.filter("k", lambda x: x.isNotNull())).alias("k"))
    once = keys.select("id", "k.a", "k.b").distinct()
    shared = once.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).select("a", F.col("b").alias("other"), "keeper")
    drops = (
        keys.select("id", "version", "k.a", "k.b", "k.pos")
        .join(shared, "a")
        .where(F.col("b").bitwiseXOR(F.col("other")) == 0)
        .where(F.col("id") < F.col("keeper"))
        .groupBy("id", "version")
        .agg(F.collect_set("pos").alias("gone"))
    )
    # The text is split in a projection of its own: a lambda that holds the split would split anew for every line.
    parts = rows.join(drops, ["id", "version"], "left").select("row", "body", lines.alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(places, lambda i: F.col("lines")[i]), "\n")
    new = F.struct(
        F.when(F.size("gone") > 0, kept).otherwise(F.col("body")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
    )
    return parts.select("row", new.alias("new")).select("row.*", "new.*")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many lines it had, how many went, and the SHA-256 of what stays."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
with lines as (
  select doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents))
), shared as (
  select key, max(doc_id) as keeper from lines where length(key) >= 20
  group by key having count(distinct doc_id) >= 3
), marked as (
  select l.doc_id, l.pos, l.line, s.key is not null and l.doc_id < s.keeper as gone
  from lines l left join shared s on l.key = s.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
