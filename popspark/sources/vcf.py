"""Variant files to sites: scan, decode, filter, mask and fold, all with built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.operators import sites as S
from popspark.operators import variants as V
from popspark.operators.ordered import numbered
from popspark.sources.layout import Layout
from popspark.sources.models import Params, uniform
from popspark.shared import written
from popspark.sources.text import chunked_lines, read_mask, read_reference, sequence_pieces

FIXED = 9


@dataclass(frozen=True)
class Ingested:
    """sites (chunk, pos, alleles): segregating; blocks (chunk, block, start, codes): the reference, a character for each
    locus, which is an allele's digit, a dot where it is missing, or a star where it segregates; lines, with status."""

    sites: DataFrame
    blocks: DataFrame
    lines: DataFrame

    @property
    def reference(self) -> DataFrame:
        """(chunk, pos, allele): every locus that does not segregate, null where missing."""
        loci = self.blocks.select("chunk", "start", F.posexplode(F.split("codes", "")).alias("i", "code")).where("code <> '' and code <> '*'")
        return loci.select("chunk", (F.col("start") + F.col("i")).alias("pos"), F.when(F.col("code") != ".", F.col("code").cast("int")).alias("allele"))

    @property
    def lengths(self) -> DataFrame:
        """(chunk, n_loci)."""
        return self.blocks.groupBy("chunk").agg(F.max(F.col("start") + F.length("codes")).alias("n_loci"))


HEADER = ((3, "REF"), (4, "ALT"), (6, "FILTER"), (8, "FORMAT"))


def _checked(ok: Column, value: Column, message: str, kind: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast(kind))


def read_lines(spark: SparkSession, paths: list[str], offset: int = 0) -> DataFrame:
    """(chunk, line_no, chrom, pos, ref, alt, filter, format, gts); pos counts from 0 after the offset. A row whose width is not
    its header's is an error, and so are a position below 0 and a header without REF, ALT, FILTER and FORMAT in their columns."""
    lines = chunked_lines(spark, paths)
    cells = F.split(F.trim("value"), r"\s+")
    fine = F.lit(True)
    for i, name in HEADER:
        fine = fine & F.get(cells, F.lit(i)).eqNullSafe(F.lit(name))
    # A header for each contig.
    widths = lines.where(F.col("value").startswith("#CHROM")).select("chunk", _checked(fine, F.size(cells), "a header has REF, ALT, FILTER and FORMAT elsewhere", "int").alias("width")).groupBy("chunk").agg(F.max("width").alias("width"))
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select("chunk", "line_no", cells.alias("c")).join(F.broadcast(widths), "chunk", "left")
    c = _checked(F.size("c").eqNullSafe(F.col("width")), F.col("c"), "a row is not as wide as its header", "array<string>")
    rows = rows.select("chunk", "line_no", c.alias("c"))
    pos = F.col("c")[1].cast("long") - 1 - offset
    return rows.select(
        "chunk", "line_no", F.col("c")[0].alias("chrom"), _checked(pos >= 0, pos, "a position is outside the reference", "long").alias("pos"), F.col("c")[3].alias("ref"), F.col("c")[4].alias("alt"),
        F.col("c")[6].alias("filter"), F.col("c")[8].alias("format"), F.slice("c", FIXED + 1, F.size("c") - FIXED).alias("gts"),
    )


def haplotypes(gts: Column, phased_only: bool) -> Column:
    """The digits of all haplotypes in order: one character is a haploid, three are a diploid. A dot is missing.

    Unphased heterozygotes are an error with ``phased_only`` and missing without it.
    """

    def one(g: Column) -> Column:
        a, b = F.substring(g, 1, 1), F.substring(g, 3, 1)
        unphased = (F.substring(g, 2, 1) == "/") & (a != b)
        bad = F.raise_error(F.concat(F.lit("an unphased genotype: "), g)).cast("array<string>") if phased_only else F.array(F.lit("."), F.lit("."))
        wrong = F.raise_error(F.concat(F.lit("not a genotype: "), g)).cast("array<string>")
        return F.when(F.length(g) == 1, F.array(g)).when(F.length(g) != 3, wrong).when(unphased, bad).otherwise(F.array(a, b))

    return F.flatten(F.transform(gts, one))


def decoded_genotypes(lines: DataFrame, layout: Layout, phased_only: bool = True) -> DataFrame:
    """Usable lines as genotypes (chunk, pos, hap, allele) of the used haplotypes, which are numbered anew."""
    rows = lines.select("chunk", "pos", _used(lines, layout, phased_only).alias("alleles"))
    return rows.select("chunk", "pos", F.posexplode("alleles").alias("hap", "allele"))


def _used(lines: DataFrame, layout: Layout, phased_only: bool) -> Column:
    """The codes of the used haplotypes of usable lines, from gts."""
    digits = haplotypes(F.col("gts"), phased_only)
    counted = _checked(F.size(digits) == len(layout.multiplicity), digits, "the layout has another number of haplotypes", "array<string>")
    codes = V.allele_codes(F.col("ref"), F.col("alt"), layout.n_alleles)
    picked = F.transform(F.array(*map(F.lit, layout.used)), lambda h: counted[h])
    return F.transform(picked, lambda d: F.when(d != ".", F.get(codes, d.try_cast("int"))))


def overlaid(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """blocks (chunk, block, start, codes) with what edits (chunk, block, at, n, code) put in place: n times a character from
    a block's at-th on. Edits of one block do not overlap, and none begins before its block. Blocks and edits meet once, and each block is put together from
    the pieces between its edits."""
    edits = edits.withColumn("at", _checked(F.col("at") >= 0, F.col("at"), "an edit begins before its block", "long"))
    made = edits.groupBy("chunk", "block").agg(F.sort_array(F.collect_list(F.struct("at", "n", "code"))).alias("edits"))
    joined = blocks.join(made, ["chunk", "block"], "left")
    end = lambda i: F.when(i > 0, F.col("edits")[i - 1]["at"] + F.col("edits")[i - 1]["n"]).otherwise(F.lit(0))
    piece = lambda x, i: F.concat(F.substring("codes", (end(i) + 1).cast("int"), (x["at"] - end(i)).cast("int")), F.repeat(x["code"], x["n"].cast("int")))
    last = end(F.size("edits"))
    rest = F.substring("codes", (last + 1).cast("int"), (F.length("codes") - last).cast("int"))
    whole = F.concat(F.array_join(F.transform("edits", piece), ""), rest)
    return joined.select("chunk", "block", "start", F.when(F.col("edits").isNotNull(), whole).otherwise(F.col("codes")).alias("codes"))


def coded(bases: Column, n_alleles: int) -> Column:
    """A reference's letters as codes: with four alleles their digits, with fewer 0; unknown ones are a dot."""
    known = "".join(V.ALLELES)
    left = F.translate(bases, known + V.UNKNOWN, "")
    codes = F.translate(bases, known + V.UNKNOWN, ("0123" if n_alleles == len(known) else "0000") + "." * len(V.UNKNOWN))
    return F.when(left == "", codes).otherwise(F.raise_error(F.concat(F.lit("no base of a reference: "), left)).cast("string"))


def reference_of(spark: SparkSession, path: str) -> str:
    """The reference that a variant file's header names, next to the file if the name is relative."""
    line = chunked_lines(spark, [path]).where(F.col("value").startswith("##reference")).orderBy("line_no").select("value").first()
    parts = line["value"].strip().split("file://") if line else []
    if len(parts) != 2:
        raise ValueError("the variant file names no reference by file://")
    return parts[1] if parts[1].startswith("/") else f"{path.rsplit('/', 1)[0]}/{parts[1]}" if "/" in path else parts[1]


def ingest(
    spark: SparkSession, vcf: list[str], reference: list[str] | None, layout: Layout, filter_pass: str, mask: list[str] | None = None, offset: int = 0, phased_only: bool = True, strict_duplicates: bool = True, params: Params | None = None,
) -> Ingested:
    """Contigs (one file of each kind for each) as segregating sites and a reference.

    Lines that fail the filter or have too many alleles make their locus missing; masked ones are left out and their loci
    missing. A position outside the reference is an error on any line; so is, on any line that is neither masked nor a repeated
    one, whatever its filter says, a REF of several bases, one that is no letter of a reference, and one that is not the
    reference's base (letters for unknown bases are alike). On lines that pass the filter, multi-base or equal alleles, another
    FORMAT and a genotype count other than the layout's are errors. So are masks with regions that overlap or are out of
    order, segregating sites whose positions do not rise, and studies without any. With fewer than four alleles, the
    reference's bases become 0, and the mutation matrix, if given, has to be uniform. Without ``reference``, the variant
    files' headers name them.

    The reference and what is left of the lines are written once; checks and results read them there.
    Only the codes of the used haplotypes travel with a line, and a locus of the reference is a character in a block.
    """
    if params is not None and layout.n_alleles < len(V.ALLELES) and not uniform(params.matrix):
        raise ValueError("with fewer than four alleles, the mutation matrix has to be uniform")
    lines = read_lines(spark, vcf, offset)
    bases = written(read_reference(spark, reference or [reference_of(spark, v) for v in vcf], V.BIN), "reference")
    regions = read_mask(spark, mask) if mask else None
    if regions is not None:
        if V.mask_faults(regions).limit(1).count():
            raise ValueError("a mask's regions overlap, are empty or are out of order")
        where = lines.select("chunk", "line_no", "pos")
        inside = where.join(V.unmasked(where, regions).select("chunk", "line_no"), ["chunk", "line_no"], "left_anti").select("chunk", "line_no", F.lit(True).alias("hit"))
        lines = lines.join(inside, ["chunk", "line_no"], "left").withColumn("masked", F.coalesce("hit", F.lit(False))).drop("hit")
    else:
        lines = lines.withColumn("masked", F.lit(False))
    # Which lines repeat a position is found on three numbers of each; they are few, and the lines stay where they are.
    where = lines.select("chunk", "line_no", "pos")
    twice = where.groupBy("chunk", "pos").agg(F.count("*").alias("n"), F.min("line_no").alias("kept")).where("n > 1").drop("n")
    again = F.coalesce(F.col("line_no") != F.col("kept"), F.lit(False))
    if strict_duplicates:
        again = F.when(again, F.raise_error(F.lit("two lines at one position")).cast("boolean")).otherwise(again)
    lines = lines.join(twice, ["chunk", "pos"], "left").withColumn("duplicate", again).drop("kept")
    lines = V.with_status(lines, layout.n_alleles, filter_pass)
    fatal = F.col("status").isin("multi_base", "equal_alleles", "bad_format")
    lines = lines.withColumn("status", F.when(fatal, F.raise_error(F.concat(F.lit("line of kind "), "status")).cast("string")).otherwise(F.col("status")))

    block = F.expr(f"pos div {V.BIN}").alias("block")
    texts = bases.select("chunk", "block", F.col("start").alias("_start"), "bases")
    met = lines.withColumn("block", block).join(texts, ["chunk", "block"], "left")
    base = F.substring("bases", (F.col("pos") - F.col("_start") + 1).cast("int"), F.lit(1))
    met = met.where(V.stands(base, F.col("ref"), F.col("status").isin("masked", "duplicate")))
    # Kept, as the checks below and all results read it: codes of the used haplotypes only, and of the lines that count.
    codes = F.when(F.col("status") == "usable", _used(lines, layout, phased_only))
    kept = written(met.select("chunk", "line_no", "pos", "ref", "status", codes.alias("alleles")), "lines")
    segregating, still = S.folded(kept.where("status = 'usable'").select("chunk", "line_no", "pos", "alleles"), "line_no")
    if V.order_faults(segregating.select("chunk", "line_no", "pos")).limit(1).count():
        raise ValueError("segregating sites are not in order of their positions")
    if not segregating.limit(1).count():
        raise ValueError("no segregating site is left")

    at = F.expr(f"pos % {V.BIN}")
    edit = lambda df, code: df.select("chunk", block, at.alias("at"), F.lit(1).cast("long").alias("n"), code.alias("code"))
    edits = edit(segregating, F.lit("*")).unionByName(edit(still, F.coalesce(F.col("allele").cast("string"), F.lit(".")))).unionByName(edit(kept.where("status in ('filter_failed', 'too_many_alleles')"), F.lit(".")))
    if regions is not None:
        pieces = V.binned(regions, V.BIN)
        low, high = F.greatest(F.col("start"), F.col("bin") * V.BIN), F.least(F.col("end"), (F.col("bin") + 1) * V.BIN)
        edits = edits.unionByName(pieces.select("chunk", F.col("bin").alias("block"), (low - F.col("bin") * V.BIN).alias("at"), (high - low).alias("n"), F.lit(".").alias("code")))
    blocks = overlaid(bases.select("chunk", "block", "start", coded(F.col("bases"), layout.n_alleles).alias("codes")), edits)
    # A mask may go beyond the reference.
    size = bases.select("chunk", "block", F.length("bases").alias("size"))
    blocks = blocks.join(size, ["chunk", "block"]).select("chunk", "block", "start", F.substring("codes", F.lit(1), F.col("size")).alias("codes"))
    return Ingested(segregating.select("chunk", "pos", "alleles"), blocks, kept.drop("alleles"))


def from_sites(sites: DataFrame, layout: Layout) -> Ingested:
    """Sites (chunk, pos, alleles) of sequence files as a study of their own: sites that do not segregate give the reference,
    and loci without a site, of which the layout knows the number, show allele 0. A study without segregating sites is an
    error, as is one whose layout names fewer loci than a site has."""
    segregating, still = S.folded(written(sites, "sites"))
    if not segregating.limit(1).count():
        raise ValueError("no segregating site is left")
    ends = sites.groupBy("chunk").agg((F.max("pos") + 1).cast("long").alias("n_loci"))
    if layout.n_loci:
        n = F.lit(layout.n_loci).cast("long")
        ends = ends.withColumn("n_loci", _checked(F.col("n_loci") <= n, n, "a site is beyond the layout's number of loci", "long"))
    start = F.col("block") * V.BIN
    plain = ends.select("chunk", "n_loci", F.explode(F.expr(f"sequence(0, (n_loci - 1) div {V.BIN})")).alias("block"))
    plain = plain.select("chunk", "block", start.alias("start"), F.repeat(F.lit("0"), F.least(F.lit(V.BIN), F.col("n_loci") - start).cast("int")).alias("codes"))
    edit = lambda df, code: df.select("chunk", F.expr(f"pos div {V.BIN}").alias("block"), F.expr(f"pos % {V.BIN}").alias("at"), F.lit(1).cast("long").alias("n"), code.alias("code"))
    edits = edit(segregating, F.lit("*")).unionByName(edit(still, F.coalesce(F.col("allele").cast("string"), F.lit("."))))
    none = sites.limit(0).select("chunk", F.lit(0).cast("long").alias("line_no"), "pos", F.lit("").alias("ref"), F.lit("usable").alias("status"))
    return Ingested(segregating.select("chunk", "pos", "alleles"), overlaid(plain, edits), none)


def sequences(spark: SparkSession, paths: list[str], layout: Layout, alleles: list[str] | None = None) -> DataFrame:
    """Files of one sequence a line (all of one length) as sites (chunk, pos, alleles) of the used haplotypes.

    Letters become their place in ``alleles`` (A, C, G, T); others are missing. Lines are read in pieces, and letters travel as
    (pos, hap, allele) rows, so that no row holds a sequence.
    """
    letters = alleles or list(V.ALLELES)
    return S.site_table(_picked(sequence_pieces(spark, paths), layout, letters), len(layout.used))


def _picked(pieces: DataFrame, layout: Layout, letters: list[str]) -> DataFrame:
    """Pieces (chunk, row, col, piece) as (chunk, pos, hap, allele) of the used haplotypes."""
    places = F.create_map(*[F.lit(x) for i, h in enumerate(layout.used) for x in (h, i)])
    code = F.array_position(F.array(*map(F.lit, letters)), F.upper("letter")) - 1
    rows = pieces.where(places[F.col("row")].isNotNull()).select("chunk", "row", "col", F.posexplode(F.split("piece", "")).alias("i", "letter")).where("letter <> ''")
    return rows.select("chunk", (F.col("col") + F.col("i")).cast("long").alias("pos"), places[F.col("row")].alias("hap"), F.when(code >= 0, code.cast("int")).alias("allele"))


def line_counters(ingested: Ingested) -> DataFrame:
    """How many lines each contig has of each status; the counts add up to its lines."""
    return ingested.lines.groupBy("chunk", "status").agg(F.count("*").alias("n"))


SECTIONS = ("NUM LOCI", "REFERENCE", "SEGREGATING SITES", "HAPLOTYPES")


def compressed_sequences(spark: SparkSession, path: str, layout: Layout, alleles: list[str] | None = None) -> DataFrame:
    """A file of sections (NUM LOCI; REFERENCE, where x marks a segregating site, or SEGREGATING SITES, a list of positions;
    HAPLOTYPES, a line of letters at those sites for each) as sites (chunk, pos, alleles) of the used haplotypes."""
    from pyspark.sql import Window

    pieces = sequence_pieces(spark, [path])
    # A row for each line: its first letters, which are all of a section's name.
    first = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("col") < 40, F.struct("col", "piece")))), lambda x: x["piece"]), "")
    lines = pieces.groupBy("chunk", "row").agg(F.upper(F.trim(first)).alias("name"), F.max(F.col("col") + F.length("piece")).alias("end"))
    order = Window.partitionBy("chunk").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when((F.col("end") <= 40) & F.col("name").isin(*SECTIONS), F.col("name"))
    lines = lines.withColumn("title", title).withColumn("section", F.last("title", ignorenulls=True).over(order)).where("title is null")
    rank = F.row_number().over(Window.partitionBy("chunk", "section").orderBy("row")) - 1
    parts = pieces.join(lines.select("chunk", "row", "section", rank.alias("n")), ["chunk", "row"])
    marked = parts.where("section = 'REFERENCE'").select("chunk", "col", F.posexplode(F.split("piece", "")).alias("i", "c")).where("lower(c) = 'x'").select("chunk", (F.col("col") + F.col("i")).alias("pos"))
    # A list of positions has none of the letters that lines are cut behind, so it is one piece.
    named = parts.where("section = 'SEGREGATING SITES'").select("chunk", F.explode(F.split(F.trim("piece"), r"\s+")).alias("p")).select("chunk", F.col("p").cast("long").alias("pos"))
    places = numbered(marked.unionByName(named), ["chunk"], "pos", [], "place")
    return _at_sites(parts.where("section = 'HAPLOTYPES'").select("chunk", F.col("n").alias("row"), "col", "piece"), places, layout, alleles)


def _at_sites(pieces: DataFrame, places: DataFrame, layout: Layout, alleles: list[str] | None) -> DataFrame:
    """Haplotypes' letters at the sites that places (chunk, place, pos) names, as sites (chunk, pos, alleles)."""
    cells = _picked(pieces, layout, alleles or list(V.ALLELES)).withColumnRenamed("pos", "place")
    return S.site_table(cells.join(places, ["chunk", "place"]).select("chunk", "pos", "hap", "allele"), len(layout.used))


def old_compressed_sequences(spark: SparkSession, path: str, layout: Layout, alleles: list[str] | None = None) -> DataFrame:
    """A file whose first line lists the segregating sites, and whose others are the haplotypes' letters there, as sites
    (chunk, pos, alleles) of the used haplotypes; all other loci have allele 0."""
    pieces = sequence_pieces(spark, [path])
    # A list of positions has none of the letters that lines are cut behind, so it is one piece.
    places = pieces.where("row = 0").select("chunk", F.posexplode(F.split(F.trim("piece"), r"\s+")).alias("place", "p")).select("chunk", "place", F.col("p").cast("long").alias("pos"))
    return _at_sites(pieces.where("row > 0").select("chunk", (F.col("row") - 1).alias("row"), "col", "piece"), places, layout, alleles)
