"""Sites: one row for each position with an allele for each selected haplotype; null is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def site_table(genotypes: DataFrame, n_haps: int) -> DataFrame:
    """genotypes (chunk, pos, hap, allele) to sites (chunk, pos, alleles): one shuffle, an aggregate for each haplotype."""
    alleles = F.array(*[F.max(F.when(F.col("hap") == h, F.col("allele"))) for h in range(n_haps)])
    return genotypes.groupBy("chunk", "pos").agg(alleles.alias("alleles"))


def selected(genotypes: DataFrame, config: DataFrame) -> DataFrame:
    """Genotypes of the haplotypes that config (hap, multiplicity) uses; identical haplotypes stay apart."""
    used = config.where(F.exists("multiplicity", lambda m: m > 0)).select("hap")
    return genotypes.join(used, "hap", "left_semi")


def codes(alleles: Column) -> Column:
    """Alleles with missing as a code of its own, -1."""
    return F.transform(alleles, lambda x: F.coalesce(x, F.lit(-1)))


def classified(sites: DataFrame) -> DataFrame:
    """sites with segregating (more than one code, missing counted as one) and with_missing."""
    return sites.withColumn("segregating", F.size(F.array_distinct(codes(F.col("alleles")))) > 1).withColumn("with_missing", F.exists("alleles", lambda x: x.isNull()))


def complete(sites: DataFrame) -> DataFrame:
    """Sites where no used haplotype is missing: one that misses blanks the locus for all."""
    return sites.where(~F.exists("alleles", lambda x: x.isNull()))


def folded(sites: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(segregating sites, reference codes (chunk, pos, allele) that nonsegregating sites give; null if they are missing);
    the former with the columns to keep."""
    marked = classified(sites)
    still = marked.where(~F.col("segregating")).select("chunk", "pos", F.col("alleles")[0].alias("allele"))
    return marked.where("segregating").select("chunk", "pos", "alleles", *keep), still


def printed(sites: DataFrame, lengths: DataFrame, every: int | None = None, segregating: bool = True) -> DataFrame:
    """Loci (chunk, pos) where hidden states are printed: all segregating ones, and every ``every``-th of lengths (chunk, n_loci)."""
    out = sites.select("chunk", "pos") if segregating else sites.select("chunk", "pos").limit(0)
    if every:
        out = out.unionByName(lengths.select("chunk", F.explode(F.expr(f"sequence(cast(0 as bigint), cast(n_loci - 1 as bigint), cast({every} as bigint))")).alias("pos")))
    return out.distinct()


def counters(sites: DataFrame) -> DataFrame:
    """How many sites have each status, and how many of them lack an allele."""
    status = F.when(F.col("segregating"), "segregating").otherwise("nonsegregating")
    return classified(sites).groupBy("chunk", status.alias("status")).agg(F.count("*").alias("n"), F.count_if("with_missing").alias("n_missing"))
