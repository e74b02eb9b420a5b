"""Rules for variant lines: which are used, which blank their position, which are errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from popspark.operators.ordered import last_before

ALLELES = ("A", "C", "G", "T")
#: Letters of a reference that stand for several bases or none; they count as missing. Other letters are an error.
UNKNOWN = "NRYSWKMBDHVUX-."
#: Positions of a bin in which masks and variants meet.
BIN = 10_000


def code_of(base: Column) -> Column:
    """A, C, G, T to 0..3; anything else is missing."""
    out = F.lit(None).cast("int")
    for i, a in enumerate(ALLELES):
        out = F.when(F.upper(base) == a, i).otherwise(out)
    return out


def alternatives(alt: Column) -> Column:
    return F.split(alt, ",")


def allele_codes(ref: Column, alt: Column, n_alleles: int) -> Column:
    """The code of each allele that a genotype's digit can name. With four alleles, by base; with fewer, by place: the
    reference is 0 and the i-th alternative i. A dot is missing."""
    alts = alternatives(alt)
    if n_alleles == len(ALLELES):
        return F.concat(F.array(code_of(ref)), F.transform(alts, code_of))
    return F.concat(F.array(F.lit(0)), F.transform(alts, lambda a, i: F.when(a != ".", (i + 1).cast("int"))))


def first_of_duplicates(lines: DataFrame, strict: bool = True) -> DataFrame:
    """lines (chunk, pos, line_no) with ``duplicate``, true for all but the first line of a position.

    With ``strict``, a job that meets a duplicate fails.
    """
    order = Window.partitionBy("chunk", "pos").orderBy("line_no")
    marked = lines.withColumn("duplicate", F.row_number().over(order) > 1)
    if strict:
        marked = marked.withColumn("duplicate", F.when(F.col("duplicate"), F.raise_error(F.lit("two lines at one position")).cast("boolean")).otherwise(False))
    return marked


def binned(intervals: DataFrame, size: int = BIN) -> DataFrame:
    """Half-open intervals (start, end), once for each bin that they touch."""
    last = F.expr(f"(end - 1) div {size}")
    return intervals.where(F.col("start") < F.col("end")).withColumn("bin", F.explode(F.sequence(F.expr(f"start div {size}"), last)))


def unmasked(sites: DataFrame, mask: DataFrame, size: int = BIN) -> DataFrame:
    """sites (chunk, pos) outside all intervals of mask (chunk, start, end).

    Both sides are dealt by (chunk, bin), so the range test is an ordinary anti-join on equal keys; neither side has to
    be small.
    """
    regions = binned(mask, size).select(F.col("chunk").alias("_chunk"), F.col("bin").alias("_bin"), "start", "end")
    placed = sites.withColumn("bin", F.expr(f"pos div {size}"))
    hit = (F.col("chunk") == F.col("_chunk")) & (F.col("bin") == F.col("_bin")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))
    return placed.join(regions, hit, "left_anti").drop("bin")


def mask_faults(mask: DataFrame) -> DataFrame:
    """Rows of mask (chunk, line_no, start, end) that are empty, or start before the line before them ends."""
    placed = last_before(mask, ["chunk"], "line_no", [], "end", "previous_end")
    return placed.where((F.col("start") >= F.col("end")) | (F.col("start") < F.col("previous_end")))


def order_faults(sites: DataFrame) -> DataFrame:
    """Rows of sites (chunk, pos, line_no) whose position is not above that of the line before."""
    return last_before(sites, ["chunk"], "line_no", ["pos"], "pos", "previous_pos").where(F.col("pos") <= F.col("previous_pos"))


def with_status(lines: DataFrame, n_alleles: int, filter_pass: str) -> DataFrame:
    """lines (ref, alt, filter, format, masked, duplicate) with status, by the first rule that holds.

    masked and duplicate lines are left out; filter_failed and too_many_alleles blank their position; multi_base,
    bad_format and equal_alleles are errors in strict ingest; the rest is usable.
    """
    codes = allele_codes(F.col("ref"), F.col("alt"), n_alleles)
    status = (
        F.when(F.col("masked"), "masked")
        .when(F.col("duplicate"), "duplicate")
        .when(~F.col("filter").eqNullSafe(filter_pass), "filter_failed")
        .when(F.size(alternatives(F.col("alt"))) > n_alleles - 1, "too_many_alleles")
        .when((F.length("ref") != 1) | F.exists(alternatives(F.col("alt")), lambda a: F.length(a) != 1), "multi_base")
        .when(F.size(F.array_distinct(codes)) != F.size(codes), "equal_alleles")
        .when(~F.col("format").eqNullSafe("GT"), "bad_format")
        .otherwise("usable")
    )
    return lines.withColumn("status", status)


def stands(base: Column, ref: Column, left_out: Column) -> Column:
    """True for a line whose position and REF are fine; an error that says what is wrong for others.

    base: the reference's letter at the line's position, empty or null outside of it. Lines that are left out need a position
    inside the reference only.
    """
    letter = F.upper(ref)
    known = "".join(ALLELES) + UNKNOWN
    alike = lambda c: F.translate(F.upper(c), UNKNOWN, "N" * len(UNKNOWN))
    error = lambda text: F.raise_error(F.concat(F.lit(text), letter)).cast("boolean")
    return (
        F.when(F.coalesce(base == "", F.lit(True)), F.raise_error(F.lit("a position is outside the reference")).cast("boolean"))
        .when(left_out, True)
        .when(F.length(ref) != 1, error("REF has several bases: "))
        .when(F.translate(letter, known, "") != "", error("REF is no base: "))
        .when(alike(base) != alike(ref), error("REF is not the reference's base: "))
        .otherwise(True)
    )


def reference_faults(lines: DataFrame, reference: DataFrame) -> DataFrame:
    """Lines (chunk, pos, ref) whose reference base is not the one at their place; reference: (chunk, block, start, bases)."""
    blocks = reference.select(F.col("chunk").alias("_chunk"), F.col("start").alias("_start"), (F.col("start") + F.length("bases")).alias("_end"), "bases", F.col("block").alias("_block"), F.length("bases").alias("_size"))
    size = F.lit(BIN)
    joined = lines.join(blocks, (F.col("chunk") == F.col("_chunk")) & (F.floor(F.col("pos") / size) == F.col("_block")))
    base = F.substring("bases", (F.col("pos") - F.col("_start") + 1).cast("int"), F.lit(1))
    return joined.withColumn("base", base).where(F.upper("ref") != F.upper("base")).drop("_chunk", "_start", "_end", "bases", "_block", "_size")
