"""A command line for a whole study: files in, a table of points and likelihoods out.

    python -m popspark.jobs.cli --vcf a.vcf --reference a.fa --layout a.config --params a.param --demography a.demo \
        --likelihood lol --start 0.2,0.5,0.5,1 --em-iterations 2 --m-iterations 10 --out results
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.jobs.inference import Model, csds_of, genetic, prepared_from_sites, random_starts
from popspark.operators import blocks, csd
from popspark.operators.likelihood import posteriors, with_posteriors
from popspark.operators.search import grid
from popspark.operators.sites import printed
from popspark.sources import text as T
from popspark.sources.layout import Layout, parse_layout, per_deme, read_text
from popspark.sources.models import Params, parse_demography, parse_params
from popspark.sources.vcf import Ingested, compressed_sequences, from_sites, ingest, old_compressed_sequences, sequences

PERMUTED = ("pac", "oldpac", "superpac")


def numbers(text: str) -> list[float]:
    return [float(x) for x in text.split(",")]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--vcf", help="a file for each contig, separated by commas")
    p.add_argument("--sequences", help="instead of --vcf: files of one sequence a line, one for each contig")
    p.add_argument("--compressed", help="instead of --vcf: a file of sections")
    p.add_argument("--old-compressed", help="instead of --vcf: a file whose first line lists the segregating sites")
    p.add_argument("--reference", help="a file for each contig; left out, the variant files name them")
    p.add_argument("--layout", help="which haplotypes are used in which deme")
    p.add_argument("--num-per-deme", type=lambda x: [int(n) for n in x.split(",")], help="instead of --layout: so many haplotypes in each deme, in order")
    p.add_argument("--n-alleles", type=int, default=2, help="with --num-per-deme")
    for name in ("params", "demography"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--rates")
    p.add_argument("--mask")
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--filter-pass", default="PASS")
    p.add_argument("--raw-matrix", action="store_true", help="rows of the mutation matrix have to add up to one")
    p.add_argument("--likelihood", default="pcl", help="lol, pcl, pclol, pac, oldpac, superpac or file")
    p.add_argument("--csd-list")
    p.add_argument("--permutations", help="a file of permutations")
    p.add_argument("--random-permutations", type=int)
    p.add_argument("--permutation-seed", type=int, default=0)
    p.add_argument("--csds-per-permutation", type=int)
    p.add_argument("--loci-per-step", type=int, help="1000, if left out; 1 where loci are skipped")
    p.add_argument("--skip-loci", action="store_true", help="steps of one locus, of which only segregating ones are visited")
    p.add_argument("--intervals", default="loguniform")
    p.add_argument("--interval-params", default="8,0.01,4", help="numbers with commas; for combined, name:numbers/name:numbers")
    p.add_argument("--interval-points", help="a file of boundaries, instead of the two above")
    p.add_argument("--trunk", default="migratingethan")
    p.add_argument("--cake", default="average")
    p.add_argument("--core", default="auto", help="how tables are made: auto, spectral, adaptive or steps")
    p.add_argument("--least-migration", type=float, default=0.005)
    p.add_argument("--bounds", help="low,high;low,high;...")
    p.add_argument("--start", type=numbers)
    p.add_argument("--starts", help="a file of start points")
    p.add_argument("--grid", type=int, help="points on each axis of the bounds")
    p.add_argument("--random-starts", type=int, help="points that are log-uniform in the bounds")
    p.add_argument("--generations", type=int, default=1)
    p.add_argument("--keep", type=int, default=1)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--scale-recombination", action="store_true", help="a coordinate more: the recombination rate's factor")
    p.add_argument("--estimate-theta", action="store_true", help="a last coordinate: the mutation rate")
    p.add_argument("--impute", action="store_true", help="sites that lack alleles count; likelihoods only")
    p.add_argument("--rate-map", help="a file for each contig: lines of start, end and the factor of the recombination rate there")
    p.add_argument("--theta-by-interval", type=numbers, help="a mutation rate for each hidden interval")
    p.add_argument("--objective", default="lineage", choices=("lineage", "transition", "marginal"))
    p.add_argument("--em-iterations", type=int, default=0)
    p.add_argument("--m-iterations", type=int, default=10)
    p.add_argument("--joint", action="store_true", help="all coordinates at once in an M-step")
    p.add_argument("--coordinate-order", type=lambda x: [int(i) for i in x.split(",")])
    p.add_argument("--m-spread", type=float, help="an M-step ends where its simplex is so flat")
    p.add_argument("--tolerance", type=float, help="least relative rise of the likelihood")
    p.add_argument("--parameter-tolerance", type=float, help="least relative change of a coordinate")
    p.add_argument("--unphased-as-missing", action="store_true")
    p.add_argument("--ignore-double-entries", action="store_true")
    p.add_argument("--decode", help="where to write posteriors at the best point")
    p.add_argument("--print-loci", type=int, help="decode every so many loci")
    p.add_argument("--print-snps", action="store_true", help="decode all segregating loci")
    p.add_argument("--text", help="results as lines, too")
    p.add_argument("--out", required=True)
    return p


def _csds(spark: SparkSession, a: argparse.Namespace, members: DataFrame, n: int) -> DataFrame:
    perms = lists = None
    if a.permutations:
        perms = csd.permutations(T.chunked_lines(spark, [a.permutations]).where(~T.is_comment(F.col("value"))), n)
    elif a.random_permutations:
        perms = csd.shuffled(members.select("hap"), a.random_permutations, a.permutation_seed)
    if a.csd_list:
        lists = T.chunked_lines(spark, [a.csd_list]).where(~T.is_comment(F.col("value")))
    return csds_of(a.likelihood, members.select("hap"), perms, a.csds_per_permutation, lists)


def _starts(spark: SparkSession, a: argparse.Namespace, limits: list[tuple[float, float]] | None, dimension: int) -> list[list[float]]:
    if a.starts:
        return [r["point"] for r in T.read_start_points(spark, a.starts, dimension).orderBy("particle_id").collect()]
    if a.grid:
        return [r["point"] for r in grid(spark, limits, a.grid).orderBy("particle_id").collect()]
    if a.random_starts:
        return random_starts(limits, a.random_starts, a.seed)
    return [a.start]


def _ingested(spark: SparkSession, a: argparse.Namespace, layout: Layout, params: Params) -> Ingested:
    files = lambda x: x.split(",") if x else None
    given = [x for x in ("vcf", "sequences", "compressed", "old_compressed") if getattr(a, x)]
    match given:
        case ["vcf"]:
            return ingest(spark, files(a.vcf), files(a.reference), layout, a.filter_pass, files(a.mask), a.offset, phased_only=not a.unphased_as_missing, strict_duplicates=not a.ignore_double_entries, params=params)
        case ["sequences"]:
            return from_sites(sequences(spark, files(a.sequences), layout), layout)
        case ["compressed"]:
            return from_sites(compressed_sequences(spark, a.compressed, layout), layout)
        case ["old_compressed"]:
            return from_sites(old_compressed_sequences(spark, a.old_compressed, layout), layout)
    raise ValueError("a study has variant files or one kind of sequence files")


def main(spark: SparkSession, argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if (a.layout is None) == (a.num_per_deme is None):
        raise ValueError("a study has a layout or numbers of haplotypes, not both")
    if a.skip_loci and a.loci_per_step not in (None, 1):
        raise ValueError("loci can be skipped where a step is one locus")
    a.loci_per_step = a.loci_per_step or (1 if a.skip_loci else 1000)
    layout: Layout = parse_layout(read_text(spark, a.layout)) if a.layout else per_deme(a.num_per_deme, a.n_alleles)
    params = parse_params(read_text(spark, a.params), renormalize=not a.raw_matrix)
    if a.theta_by_interval:
        if a.estimate_theta:
            raise ValueError("a mutation rate that is estimated is one for all intervals")
        params = replace(params, thetas=tuple(a.theta_by_interval))
    got = _ingested(spark, a, layout, params)
    limits = [tuple(numbers(x)) for x in a.bounds.split(";")] if a.bounds else None
    template = parse_demography(read_text(spark, a.demography), read_text(spark, a.rates) if a.rates else None)
    sample = layout.members
    intervals, interval_params = ("customfixed", T.read_points(spark, a.interval_points)) if a.interval_points else (a.intervals, a.interval_params)
    model = Model(
        template, params, {i: d for i, (_, d) in enumerate(sample)}, layout.n_demes, a.loci_per_step, intervals, interval_params, a.trunk, a.least_migration, limits,
        haps={i: h for i, (h, _) in enumerate(sample)}, scale_recombination=a.scale_recombination, estimate_theta=a.estimate_theta, objective=a.objective, cake=a.cake, core=a.core,
    )
    dimension = template.dimension + a.scale_recombination + a.estimate_theta
    members = spark.createDataFrame([(i,) for i in range(len(sample))], "hap int")
    lengths = got.lengths.select("chunk", F.expr(f"(n_loci + {a.loci_per_step} - 1) div {a.loci_per_step}").alias("n_steps"))
    # Where loci are skipped, those that do not segregate make no rows, but for runs that tell nothing.
    rest = {"skip": True, "missing": blocks.missing_runs(got.blocks, got.sites)} if a.skip_loci else {"still": blocks.still_in_blocks(got.blocks, a.loci_per_step, layout.n_alleles)}
    if a.impute:
        if a.skip_loci or a.decode or a.rate_map or a.em_iterations:
            raise ValueError("missing alleles are put in for likelihoods alone, with one rate and without skipping")
        rest["impute"] = True
    if a.rate_map:
        if a.skip_loci or a.decode:
            raise ValueError("a map of rates goes neither with skipped loci nor with decoding")
        rest["rates"] = T.read_rates(spark, a.rate_map.split(","))
    data = prepared_from_sites(got.sites, _csds(spark, a, members, len(sample)), model, layout.n_alleles, lengths=lengths, together=a.likelihood.lower() == "oldpac", **rest)
    starts = _starts(spark, a, limits, dimension)
    if any(p is None or len(p) != dimension for p in starts):
        raise ValueError(f"a start point has {dimension} coordinates")
    options = {"tolerance": a.tolerance, "change": a.parameter_tolerance, "coordinatewise": not a.joint, "order": a.coordinate_order, "spread": a.m_spread}
    rows = genetic(data, model, starts, a.generations, a.keep, a.seed, a.em_iterations, a.m_iterations, options)
    found = [(r["generation"], r["em_step"], r["particle_id"], float(r["loglik"]), r["ms"], r["point"]) for r in rows]
    results = spark.createDataFrame(found, "generation int, em_step int, particle_id int, loglik double, ms long, point array<double>")
    results.write.parquet(a.out)
    if a.text:
        T.write_results(results, a.text)
    if a.decode:
        best = max(rows, key=lambda r: r["loglik"])["point"]
        wanted = printed(got.sites, got.lengths, a.print_loci, a.print_snps) if a.print_loci or a.print_snps else None
        at = None
        if a.skip_loci:
            # Loci that are not asked for by name are all of them.
            at = (wanted or printed(got.sites, got.lengths, 1, False)).select("chunk", F.col("pos").alias("step"))
        posterior = posteriors(data.tensors, model.tables(best, data.keys), model.demes, model.n_demes, layout.n_alleles, at=at)
        if wanted is not None:
            posterior = with_posteriors(wanted, posterior, a.loci_per_step)
        posterior.write.parquet(a.decode)


if __name__ == "__main__":
    main(SparkSession.builder.appName("popspark").getOrCreate())
