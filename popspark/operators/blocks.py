"""Blocks of loci, the steps of the hidden Markov models, and how often pairs of haplotypes show each pair of alleles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popspark.operators.sites import complete


def with_step(df: DataFrame, loci: int) -> DataFrame:
    """df (pos) with step, the block of ``loci`` loci that its position is in."""
    if not 1 <= loci <= 32765:
        raise ValueError("a step has from 1 to 32765 loci")
    return df.withColumn("step", F.expr(f"pos div {loci}"))


def step_count(length: int, loci: int) -> int:
    return -(-length // loci)


def pair_counts(sites: DataFrame, loci: int) -> DataFrame:
    """(chunk, step, add, trunk, a, b, n): at how many complete loci haplotype add shows a while trunk shows b.

    Ordered pairs come out of the site's own array, so no join is needed; counts are partly summed before the one shuffle,
    whose rows number steps, not loci.
    """
    size = F.size("alleles") - 1
    haps = F.sequence(F.lit(0), size)
    pairs = F.flatten(F.transform(haps, lambda i: F.transform(F.filter(haps, lambda j: j != i), lambda j: F.struct(i.alias("add"), j.alias("trunk"), F.col("alleles")[i].alias("a"), F.col("alleles")[j].alias("b")))))
    rows = with_step(complete(sites), loci).select("chunk", "step", F.explode(pairs).alias("p"))
    return rows.groupBy("chunk", "step", F.col("p.add").alias("add"), F.col("p.trunk").alias("trunk"), F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))


def still_counts(reference: DataFrame, loci: int) -> DataFrame:
    """(chunk, step, allele, n): loci where all haplotypes show the reference's allele; missing ones are left out."""
    return with_step(reference.where("allele is not null"), loci).groupBy("chunk", "step", "allele").agg(F.count("*").alias("n"))


def still_in_blocks(blocks: DataFrame, loci: int, n_alleles: int) -> DataFrame:
    """(chunk, step, allele, n) of a coded reference (chunk, start, codes), a character for each locus: alleles are digits.

    A row for each step that a block touches, not for each locus.
    """
    rows = blocks.select("chunk", "start", "codes", F.explode(F.expr(f"sequence(start div {loci}, (start + length(codes) - 1) div {loci})")).alias("step"))
    low = F.greatest(F.col("start"), F.col("step") * loci)
    high = F.least(F.col("start") + F.length("codes"), (F.col("step") + 1) * loci)
    rows = rows.select("chunk", "step", F.substring("codes", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("piece"))
    counts = F.array(*[F.struct(F.lit(k).alias("allele"), (F.length("piece") - F.length(F.translate("piece", str(k), ""))).cast("long").alias("n")) for k in range(n_alleles)])
    flat = rows.select("chunk", "step", F.explode(counts).alias("c")).where("c.n > 0")
    return flat.groupBy("chunk", "step", F.col("c.allele").alias("allele")).agg(F.sum("c.n").alias("n"))


def all_counts(pairs: DataFrame, still: DataFrame, haps: list[int]) -> DataFrame:
    """Pair counts with the nonsegregating loci on the diagonal of every ordered pair: L rows a pair become steps a pair."""
    every = F.array(*[F.struct(F.lit(i).alias("add"), F.lit(j).alias("trunk")) for i in haps for j in haps if i != j])
    spread = still.select("chunk", "step", F.explode(every).alias("p"), "allele", "n").select("chunk", "step", "p.add", "p.trunk", F.col("allele").alias("a"), F.col("allele").alias("b"), "n")
    return pairs.unionByName(spread).groupBy("chunk", "step", "add", "trunk", "a", "b").agg(F.sum("n").alias("n"))


def jumps(gaps: DataFrame) -> DataFrame:
    """gaps (id, gap) as powers of two, the highest first: (id, place, jump)."""
    bits = F.filter(F.transform(F.sequence(F.lit(62), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)), lambda p: F.col("gap").bitwiseAND(p) != 0)
    return gaps.where("gap > 0").select("id", F.posexplode(bits).alias("place", "jump"))


def missing_runs(blocks: DataFrame, sites: DataFrame) -> DataFrame:
    """(chunk, start, n): runs of loci that tell nothing, in a coded reference (chunk, block, start, codes; a dot is missing) and
    one by one where a segregating site (chunk, pos, alleles) lacks an allele. A row for each run, none for each locus."""
    pieces = F.split("codes", r"(?<=\.)(?=[^.])|(?<=[^.])(?=\.)")
    # Where each piece begins: the lengths of those before it, added up within its block's own row.
    before = F.aggregate(pieces, F.array(F.lit(0)), lambda ends, p: F.concat(ends, F.array(F.element_at(ends, -1) + F.length(p))))
    rows = blocks.where(F.contains("codes", F.lit("."))).select("chunk", "start", F.explode(F.arrays_zip(pieces.alias("piece"), before.alias("at"))).alias("x"))
    dots = rows.where(F.startswith("x.piece", F.lit("."))).select("chunk", (F.col("start") + F.col("x.at")).cast("long").alias("start"), F.length("x.piece").cast("long").alias("n"))
    holes = sites.where(F.exists("alleles", lambda a: a.isNull())).select("chunk", F.col("pos").cast("long").alias("start"), F.lit(1).cast("long").alias("n"))
    return dots.unionByName(holes)
