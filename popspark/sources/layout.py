"""Sampling layouts: which haplotypes are used, and in which deme. They have a row for each haplotype of the study."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    n_loci: int | None
    n_alleles: int
    n_demes: int
    multiplicity: tuple[tuple[int, ...], ...]

    @property
    def used(self) -> list[int]:
        """The rows with a multiplicity in some deme."""
        return [i for i, row in enumerate(self.multiplicity) if any(row)]

    @property
    def members(self) -> list[tuple[int, int]]:
        """(haplotype, deme) of each member of the sample, haplotypes by their place among the used ones: one for each copy, in
        each deme."""
        return [(i, d) for i, h in enumerate(self.used) for d, m in enumerate(self.multiplicity[h]) for _ in range(m)]

    def table(self, spark: SparkSession) -> DataFrame:
        """(hap, multiplicity)."""
        return spark.createDataFrame([(i, list(row)) for i, row in enumerate(self.multiplicity)], "hap int, multiplicity array<int>")


def _lines(text: str) -> list[list[str]]:
    return [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]


def parse_layout(text: str) -> Layout:
    """A header of loci, alleles and demes, then a row of multiplicities for each haplotype."""
    head, *rows = _lines(text)
    if len(head) != 3:
        raise ValueError("the header has three numbers")
    loci, alleles, demes = map(int, head)
    counts = tuple(tuple(map(int, r)) for r in rows)
    if any(len(r) != demes or min(r) < 0 for r in counts):
        raise ValueError("a row has a multiplicity for each deme")
    return Layout(loci if loci < 2**31 - 1 else None, alleles, demes, counts)


def read_layout_table(spark: SparkSession, path: str) -> DataFrame:
    """(hap, multiplicity) of a layout file of any length, without passing it through the driver: the first line that is no
    comment is its header, and another row than one whole number for each deme is an error."""
    from popspark.operators.ordered import numbered
    from popspark.sources.text import chunked_lines, is_comment

    lines = chunked_lines(spark, [path]).where(~is_comment(F.col("value"))).select("line_no", F.split(F.trim("value"), r"\s+").alias("c"))
    head = lines.orderBy("line_no").first()
    if head is None or len(head["c"]) != 3:
        raise ValueError("the header has three numbers")
    demes = int(head["c"][2])
    counts = F.transform("c", lambda x: x.cast("int"))
    fine = (F.size("c") == demes) & F.forall(counts, lambda x: x >= 0)
    checked = F.when(F.coalesce(fine, F.lit(False)), counts).otherwise(F.raise_error(F.lit("a row has a multiplicity for each deme")).cast("array<int>"))
    rows = lines.where(F.col("line_no") > head["line_no"]).select("line_no", checked.alias("multiplicity"))
    return numbered(rows, [], "line_no", [], "hap").select("hap", "multiplicity")


def per_deme(counts: list[int], n_alleles: int = 2) -> Layout:
    """So many haplotypes in each deme, in order."""
    rows = [tuple(int(d == e) for e in range(len(counts))) for d, n in enumerate(counts) for _ in range(n)]
    return Layout(None, n_alleles, len(counts), tuple(rows))


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file from any store that Spark reads."""
    return spark.read.text(path, wholetext=True).first()["value"]
