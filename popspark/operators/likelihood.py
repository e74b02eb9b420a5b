"""Likelihoods of CSDs from pair counts, and how they combine."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from popspark.functions.logspace import log_sum_exp
from popspark.model.hmm import EVERY, MISSING, Cells, CodeCells, Tables, decoded, expected, loglik, logliks, rated, skipping, skipping_decoded, skipping_expected
from popspark.operators.blocks import with_step
from popspark.operators.sites import complete
from popspark.shipping import ship


#: The slot of a haplotype's own alleles, where the trunk is empty.
ALONE = -1


def absorption(haps: DataFrame) -> DataFrame:
    """haps (chunk, deme, hap, multiplicity) with log_fraction: ln of a haplotype's share of its deme."""
    size = haps.groupBy("chunk", "deme").agg(F.sum("multiplicity").alias("deme_size"))
    return haps.where("multiplicity > 0").join(size, ["chunk", "deme"]).withColumn("log_fraction", F.ln("multiplicity") - F.ln("deme_size"))


def independent_sites(counts: DataFrame, emission: list[list[float]]) -> DataFrame:
    """ln likelihood of each ordered pair under one hidden state: sum of n * ln emission[b][a] over pair counts."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in emission])
    return counts.groupBy("chunk", "add", "trunk").agg(F.sum(F.col("n") * F.ln(table[F.col("b")][F.col("a")])).alias("loglik"))


def chunk_likelihood(csds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """csds (by, chunk, perm, factor, loglik) to (by, chunk, loglik): weighted sums by permutation, then log-sum-exp over them.

    The logarithm of the number of permutations is not taken off.
    """
    keys = [*(by or []), "chunk"]
    perms = csds.groupBy(*keys, "perm").agg(F.sum(F.col("factor") * F.col("loglik")).alias("loglik"))
    return log_sum_exp(perms, keys, "loglik", "loglik")


def step_tensors(counts: DataFrame, csds: DataFrame, still: DataFrame | None = None, lengths: DataFrame | None = None, haps: dict[int, int] | None = None, missing: DataFrame | None = None) -> DataFrame:
    """One row for each CSD and chunk: (chunk, perm, csd, add, trunk, factor, n_steps, cells), cells being its pair counts, packed.

    counts: (chunk, step, add, trunk, a, b, n). A CSD takes the pairs of its own haplotype and its trunk's. still: (chunk,
    step, allele, n), loci at which all haplotypes show one allele; they go to each CSD once, not to each of its pairs.
    lengths: (chunk, n_steps); without it, a chunk ends with its last step that has a count. haps: which haplotype each
    member of the sample is, where some are copies of one or are in several demes; a copy's pair with its own haplotype
    agrees at all loci. A CSD with an empty trunk takes its own haplotype's alleles, in slot -1 with b = a. missing: (chunk,
    start, n), runs of steps that tell nothing where steps without counts are skipped, as a column of their own.
    """
    spark = counts.sparkSession
    if lengths is None:
        ends = counts.select("chunk", "step") if still is None else counts.select("chunk", "step").unionByName(still.select("chunk", "step"))
        lengths = ends.groupBy("chunk").agg((F.max("step") + 1).alias("n_steps"))
    lengths = lengths.select("chunk", F.col("n_steps").cast("int").alias("n_steps"))
    # One locus is seen in the pair with any one other haplotype.
    one = counts.groupBy("chunk", "add").agg(F.min("trunk").alias("trunk"))
    single = counts.join(one, ["chunk", "add", "trunk"]).groupBy("chunk", "step", "add", "a").agg(F.sum("n").alias("n"))
    named = csds.select("perm", "csd", "factor", "add", "trunk")
    hap = lambda c: F.col(c)
    if haps is not None:
        table = F.create_map(*[F.lit(x) for pair in sorted(haps.items()) for x in pair])
        hap = lambda c: table[F.col(c)]
        same = single.select("chunk", "step", "add", F.col("add").alias("trunk"), "a", F.col("a").alias("b"), "n")
        counts = counts.select("chunk", "step", "add", "trunk", "a", "b", "n").unionByName(same)
    keys = ["chunk", "perm", "csd", "add", "trunk", "factor"]
    cell = lambda slot, a, b: F.struct(F.col("step").cast("int").alias("step"), slot.cast("int").alias("slot"), a.cast("int").alias("a"), b.cast("int").alias("b"), F.col("n").cast("int").alias("n")).alias("cell")
    pairs = named.select("perm", "csd", "factor", "add", "trunk", F.posexplode("trunk").alias("slot", "other")).withColumn("_add", hap("add")).withColumn("_other", hap("other"))
    cells = counts.select("chunk", "step", F.col("add").alias("_add"), F.col("trunk").alias("_other"), "a", "b", "n")
    joined = pairs.join(cells, ["_add", "_other"]).select(*keys, cell(F.col("slot"), F.col("a"), F.col("b")))
    first = named.where(F.size("trunk") == 0).withColumn("_add", hap("add"))
    joined = joined.unionByName(first.join(single.select("chunk", "step", F.col("add").alias("_add"), "a", "n"), "_add").select(*keys, cell(F.lit(ALONE), F.col("a"), F.col("a"))))
    if still is not None:
        # Each chunk's still counts meet its CSDs; a row for each of their steps, however many haplotypes the trunk has.
        every = spark_product(named, lengths.select("chunk"))
        slot = F.when(F.size("trunk") == 0, ALONE).otherwise(EVERY)
        joined = joined.unionByName(every.join(still, "chunk").select(*keys, cell(slot, F.col("allele"), F.col("allele"))))
    return _with_missing(joined.groupBy(*keys).agg(F.collect_list("cell").alias("cells")).join(lengths, "chunk"), missing)


def code_tensors(sites: DataFrame, csds: DataFrame, loci: int, still: DataFrame | None = None, lengths: DataFrame | None = None, haps: dict[int, int] | None = None, missing: DataFrame | None = None, impute: bool = False) -> DataFrame:
    """As ``step_tensors``, from sites (chunk, pos, alleles): a row holds its own haplotypes' alleles, a character for each site,
    and the counts of pairs are made where they are read. Sites where a haplotype is missing are left out or, with ``impute``,
    kept, the missing allele being a dot.

    Each site makes a row for each haplotype, not for each pair of them; then a haplotype's alleles on a contig travel as one
    string to the CSDs that it is in. Columns: chunk, perm, csd, add, trunk, factor, n_steps, steps (of the sites), codes (a
    string for each member, the additional one first) and still (step, allele, n).
    """
    known = with_step(sites if impute else complete(sites), loci).select("chunk", "pos", F.col("step").cast("int").alias("step"), "alleles")
    if lengths is None:
        ends = known.select("chunk", "step") if still is None else known.select("chunk", "step").unionByName(still.select("chunk", "step"))
        lengths = ends.groupBy("chunk").agg((F.max("step") + 1).alias("n_steps"))
    lengths = lengths.select("chunk", F.col("n_steps").cast("int").alias("n_steps"))
    letters = known.select("chunk", "pos", F.posexplode("alleles").alias("hap", "code"))
    # Put together block by block first, so that no sort buffer holds a contig.
    in_order = lambda key, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: F.coalesce(x[value].cast("string"), F.lit("."))), "")
    pieces = letters.groupBy("chunk", "hap", F.expr("pos div 1000000").alias("block")).agg(in_order("pos", "code").alias("codes"))
    rows = pieces.groupBy("chunk", "hap").agg(in_order("block", "codes").alias("codes"))
    steps = known.groupBy("chunk").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    hap = lambda c: F.col(c)
    if haps is not None:
        table = F.create_map(*[F.lit(x) for pair in sorted(haps.items()) for x in pair])
        hap = lambda c: table[F.col(c)]
    # Lists of two kinds may use one number twice, so a CSD is told by its members, too.
    named = csds.select("perm", "csd", "factor", "add", "trunk", F.xxhash64("add", "trunk").alias("_who"))
    slots = named.select("perm", "csd", "_who", F.posexplode(F.concat(F.array("add"), "trunk")).alias("slot", "member")).withColumn("hap", hap("member"))
    met = slots.join(rows, "hap").groupBy("chunk", "perm", "csd", "_who").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "codes"))), lambda x: x["codes"]).alias("codes"))
    out = spark_product(named, lengths.select("chunk")).join(met, ["chunk", "perm", "csd", "_who"], "left").drop("_who").join(steps, "chunk", "left").join(lengths, "chunk")
    if still is not None:
        each = still.groupBy("chunk").agg(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("step", "allele", "n")])).alias("still"))
        out = out.join(each, "chunk", "left")
    return _with_missing(out, missing)


def _with_missing(out: DataFrame, missing: DataFrame | None) -> DataFrame:
    if missing is None:
        return out
    runs = missing.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("n").cast("int").alias("n")))).alias("missing"))
    return out.join(runs, "chunk", "left")


def spark_product(csds: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every CSD on every chunk. The chunks, a row for each contig, go to every task in one array."""
    all_chunks = chunks.agg(F.collect_list("chunk").alias("chunks"))
    return csds.join(F.broadcast(all_chunks)).withColumn("chunk", F.explode("chunks")).drop("chunks")


#: Rates of recombination within this of each other, relatively, are one.
ALIKE = 1e-4


def rate_runs(rates: DataFrame, loci: int) -> DataFrame:
    """(chunk, first, id): the runs of steps with one rate of recombination, from step 0 on, of a map (chunk, start, end, rate) of
    half-open ranges of loci that do not overlap; rates are factors, and loci outside of all ranges have 1. A step has the rate
    of its first locus. Rates that are alike share an id, whose rate is ``rate_of`` it."""
    checked = F.when(F.col("rate") > 0, F.col("rate")).otherwise(F.raise_error(F.lit("a rate of recombination is above 0")).cast("double"))
    first, last = (F.expr(f"({c} + {loci} - 1) div {loci}") for c in ("start", "end"))
    own = rates.select("chunk", first.alias("first"), last.alias("stop"), F.round(F.ln(checked) / ALIKE).cast("int").alias("id")).where("first < stop")
    order = Window.partitionBy("chunk").orderBy("first")
    own = own.withColumn("next", F.lead("first").over(order)).withColumn("before", F.lag("stop").over(order))
    gaps = own.where("before is null and first > 0").select("chunk", F.lit(0).cast("long").alias("first"), F.lit(0).alias("id"))
    behind = own.where("next is null or next > stop").select("chunk", F.col("stop").alias("first"), F.lit(0).alias("id"))
    return own.select("chunk", "first", "id").unionByName(gaps).unionByName(behind)


def rate_of(i: int) -> float:
    return float(np.exp(i * ALIKE))


def with_rates(tensors: DataFrame, runs: DataFrame) -> DataFrame:
    """tensors with ``rates``, the runs (chunk, first, id) of each row's contig; contigs without any have the rate 1."""
    each = runs.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct(F.col("first").cast("int").alias("first"), F.col("id").cast("int").alias("id")))).alias("rates"))
    one = F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("id")))
    return tensors.join(each, "chunk", "left").withColumn("rates", F.coalesce("rates", one))


#: How many of the trunk's haplotypes each deme has, the additional one's deme and, where there is a map of rates, a rate's id.
Key = tuple[tuple[int, ...], int] | tuple[tuple[int, ...], int, int]


def table_key(add: int, trunk: list[int], demes: dict[int, int], n_demes: int) -> Key:
    """CSDs whose trunks have as many haplotypes of each deme, and whose own haplotypes have one deme, share their tables."""
    counts = [0] * n_demes
    for h in trunk:
        counts[demes[h]] += 1
    return tuple(counts), demes[add]


def _cells(batch: pa.RecordBatch, i: int, n_steps: int, n_trunk: int, n_alleles: int) -> Cells:
    """The i-th row's pair counts, from cells or from codes."""
    if "codes" not in batch.schema.names:
        step, slot, a, b, n = (np.asarray(x) for x in batch.column("cells")[i].values.flatten())
        return Cells.of(step, slot, a, b, n, n_steps, n_trunk, n_alleles)
    steps, codes = batch.column("steps")[i], batch.column("codes")[i]
    own = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in codes.values]) - 48 if codes.is_valid else np.empty((n_trunk + 1, 0), np.uint8)
    at = np.asarray(steps.values, np.int64) if steps.is_valid else np.empty(0, np.int64)
    still = np.empty((0, 3), np.int64)
    if "still" in batch.schema.names and batch.column("still")[i].is_valid:
        still = np.stack([np.asarray(x, np.int64) for x in batch.column("still")[i].values.flatten()], 1)
    return CodeCells.at(at, own, still, n_steps, n_alleles)


def _alone(batch: pa.RecordBatch, i: int, n_alleles: int, stationary: np.ndarray | None) -> float:
    """ln of the stationary probability of a haplotype's alleles."""
    if stationary is None:
        raise ValueError("a CSD with an empty trunk needs the mutation matrix's stationary distribution")
    cells = _cells(batch, i, 0, 0, n_alleles)
    seen = np.bincount(cells.a, cells.n, n_alleles)
    if isinstance(cells, CodeCells):
        seen = seen + np.bincount(cells.own[cells.own != MISSING], minlength=n_alleles)
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.where(seen > 0, seen * np.log(np.asarray(stationary)), 0.0).sum())


STATS = ("initial", "stay", "move", "emit", "own")


def evaluated(tensors: DataFrame, tables: dict[int, dict[Key, Tables]], demes: dict[int, int], n_demes: int, n_alleles: int, with_stats: bool = False, stationary: dict[int, np.ndarray] | np.ndarray | None = None, skip: bool = False, groups: int = 1, tables_of: Callable[[int, Key], Tables] | None = None) -> DataFrame:
    """(particle_id, chunk, perm, csd, factor, loglik) of each CSD under the tables of each particle, and with ``with_stats``
    its key and expected counts, as flat arrays.

    One with an empty trunk has the ``stationary`` probability of its haplotype, and no hidden states to count. With
    ``skip``, steps without counts are one locus without differences each, or tell nothing where they are missing, and are
    jumped over; this needs the same emission of a pair of equal alleles whichever they are. Where tensors have rates
    (``with_rates``), the chain changes tables with them, and expected counts come by rate. Where alleles are missing,
    ``tables_of`` a particle and a kind of CSD is asked for what is put in for them; there are no expected counts then.
    A row holds one CSD's packed counts, so tasks are CSDs and chunks, and with ``groups`` each of so many parts of the
    particles is a task of its own; a row is unpacked once for all its particles, which go through the chain side by side.
    Tables are a few dense matrices for each kind of CSD.
    """
    ship(tensors.sparkSession)
    ids = sorted(tables)
    if groups > 1:
        tensors = tensors.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    has_missing, has_rates = "missing" in tensors.columns, "rates" in tensors.columns
    if skip and has_rates:
        raise ValueError("loci can be skipped where the rate of recombination is one")
    if tables_of is not None and (skip or has_rates or with_stats):
        raise ValueError("missing alleles are put in for likelihoods alone, with one rate and without skipping")
    names = ["particle_id", "chunk", "perm", "csd", "factor", "loglik"] + ["key", *STATS] * with_stats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            single = (batch.column(c).to_pylist() for c in ("chunk", "perm", "csd", "factor", "add", "trunk", "n_steps"))
            parts = batch.column("group").to_pylist() if groups > 1 else [0] * len(batch)
            for i, (chunk, perm, csd, factor, add, trunk, n_steps) in enumerate(zip(*single, strict=True)):
                key = table_key(add, trunk, demes, n_demes)
                particles = ids[parts[i] :: groups]
                keys = [repr(key)] * len(particles)
                found: list[tuple[np.ndarray, ...]] = [tuple(np.empty(0) for _ in STATS)] * len(particles)
                if not trunk:
                    values = [_alone(batch, i, n_alleles, stationary[p] if isinstance(stationary, dict) else stationary) for p in particles]
                elif has_rates:
                    cells, runs = _cells(batch, i, n_steps, len(trunk), n_alleles), np.stack([np.asarray(x, np.int64) for x in batch.column("rates")[i].values.flatten()], 1)
                    runs, keys, found, values, named = runs[runs[:, 0] < max(n_steps, 1)], [], [], [], []
                    for p in particles:
                        own = {r: tables[p][(*key, r)] for r in np.unique(runs[:, 1]).tolist()}
                        value, stats = rated(cells, own, runs, next(iter(own.values())).shares([demes[h] for h in trunk]), with_stats)
                        # A row for each rate; the likelihood goes with the first.
                        rows = sorted(stats.items()) if with_stats else [(0, None)]
                        named += [p] * len(rows)
                        keys += [repr((*key, r)) for r, _ in rows]
                        found += [x for _, x in rows]
                        values += [value] + [0.0] * (len(rows) - 1)
                    particles = named
                else:
                    cells = _cells(batch, i, n_steps, len(trunk), n_alleles)
                    own = [tables[p][key] for p in particles]
                    shares = [t.shares([demes[h] for h in trunk]) for t in own]
                    runs = {"missing": _runs(batch.column("missing")[i])} if skip and has_missing else {}
                    if tables_of is not None and isinstance(cells, CodeCells) and (cells.others == MISSING).any():
                        at = np.array([demes[h] for h in trunk])
                        filled = [cells.imputed(at, n_demes, partial(tables_of, p), stationary[p] if isinstance(stationary, dict) else stationary) for p in particles]
                        values = [loglik(*x) for x in zip(filled, own, shares, strict=True)]
                    elif with_stats:
                        both = [(skipping_expected(cells, *x, **runs) if skip else expected(cells, *x)) for x in zip(own, shares, strict=True)]
                        values, found = [x for x, _ in both], [x for _, x in both]
                    else:
                        values = [skipping(cells, *x, **runs) for x in zip(own, shares, strict=True)] if skip else logliks(cells, own, shares)
                n = len(particles)
                columns = [pa.array(particles, pa.int64()), *(pa.array([x] * n, k) for x, k in ((chunk, pa.int32()), (perm, pa.int32()), (csd, pa.int32()), (factor, pa.float64()))), pa.array(values, pa.float64())]
                if with_stats:
                    columns += [pa.array(keys)] + [pa.array([x[k].ravel() for x in found], pa.list_(pa.float64())) for k in range(len(STATS))]
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "particle_id long, chunk int, perm int, csd int, factor double, loglik double" + "".join(f", {x}" for x in ["key string", *(f"{s} array<double>" for s in STATS)] * with_stats)
    # Parts of the particles are dealt evenly, whatever partitions their rows are in.
    return (tensors.repartition(min(groups * max(len(ids), 1) * 4, 4096)) if groups > 1 else tensors).mapInArrow(run, kinds)


def _runs(missing: pa.Scalar) -> np.ndarray | None:
    return np.stack([np.asarray(x, np.int64) for x in missing.values.flatten()], 1) if missing.is_valid and len(missing.values) else None


def summed_stats(found: DataFrame, together: bool = False) -> DataFrame:
    """Expected counts by particle, key, kind and place, each CSD weighted by its factor and its permutation's share of the
    chunk, or of all chunks with ``together``."""
    keys = ["particle_id"] if together else ["particle_id", "chunk"]
    perms = found.groupBy(*keys, "perm").agg(F.sum(F.col("factor") * F.col("loglik")).alias("total"))
    chunks = log_sum_exp(perms, keys, "total", "whole")
    weights = perms.join(chunks, keys).select(*keys, "perm", F.exp(F.col("total") - F.col("whole")).alias("weight"))
    rows = found.where(F.size("initial") > 0).join(weights, [*keys, "perm"]).withColumn("w", F.col("factor") * F.col("weight"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("values")) for k in STATS]))
    flat = rows.select("particle_id", "key", "w", kinds.alias("x")).select("particle_id", "key", "w", "x.kind", F.posexplode("x.values").alias("place", "value"))
    return flat.groupBy("particle_id", "key", "kind", "place").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def across_contigs(csds: DataFrame) -> DataFrame:
    """The likelihood of each particle in which permutations are summed once over all contigs, instead of contig by contig."""
    perms = csds.groupBy("particle_id", "perm").agg(F.sum(F.col("factor") * F.col("loglik")).alias("total"))
    return log_sum_exp(perms, ["particle_id"], "total", "loglik")


def posteriors(tensors: DataFrame, tables: dict[Key, Tables], demes: dict[int, int], n_demes: int, n_alleles: int, every: int = 1, at: DataFrame | None = None) -> DataFrame:
    """(chunk, perm, csd, step, state, probability) at every ``every``-th step of each CSD with a trunk; others have no states.
    A contig's steps end where it does.

    With ``at`` (chunk, step), steps without counts are skipped as in ``evaluated``, and the states of the steps that it names
    are given: only they and the steps with counts are visited.
    """
    ship(tensors.sparkSession)
    if at is not None:
        return _skipped_posteriors(tensors, tables, demes, n_demes, n_alleles, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("chunk", "perm", "csd", "add", "trunk", "n_steps")), strict=True)
            for i, (chunk, perm, number, add, trunk, n_steps) in enumerate(rows):
                own = tables[table_key(add, trunk, demes, n_demes)]
                for low, p in decoded(_cells(batch, i, n_steps, len(trunk), n_alleles), own, own.shares([demes[h] for h in trunk])):
                    step = np.arange(low, low + len(p), dtype=np.int32)
                    yield _state_rows((chunk, perm, number), step[step % every == 0], p[step % every == 0])

    return tensors.where(F.size("trunk") > 0).mapInArrow(run, STATE_ROWS)


STATE_ROWS = "chunk int, perm int, csd int, step int, state int, probability double"


def _state_rows(of: tuple[int, int, int], step: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    same = [pa.array(np.full(p.size, x, np.int32)) for x in of]
    places = [pa.array(np.repeat(step, p.shape[1])), pa.array(np.tile(np.arange(p.shape[1], dtype=np.int32), len(p)))]
    return pa.RecordBatch.from_arrays([*same, *places, pa.array(p.ravel())], [x.split()[0] for x in STATE_ROWS.split(", ")])


def _skipped_posteriors(tensors: DataFrame, tables: dict[Key, Tables], demes: dict[int, int], n_demes: int, n_alleles: int, at: DataFrame) -> DataFrame:
    wanted = at.groupBy("chunk").agg(F.sort_array(F.collect_set(F.col("step").cast("int"))).alias("places"))
    has_missing = "missing" in tensors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            single = (batch.column(c).to_pylist() for c in ("chunk", "perm", "csd", "add", "trunk", "n_steps"))
            for i, (chunk, perm, number, add, trunk, n_steps) in enumerate(zip(*single, strict=True)):
                own = tables[table_key(add, trunk, demes, n_demes)]
                cells = _cells(batch, i, n_steps, len(trunk), n_alleles)
                runs = {"missing": _runs(batch.column("missing")[i])} if has_missing else {}
                for step, p in skipping_decoded(cells, own, own.shares([demes[h] for h in trunk]), np.asarray(batch.column("places")[i].values, np.int64), **runs):
                    yield _state_rows((chunk, perm, number), step.astype(np.int32), p)

    return tensors.where(F.size("trunk") > 0).join(wanted, "chunk").mapInArrow(run, STATE_ROWS)


def with_posteriors(sites: DataFrame, posterior: DataFrame, loci: int) -> DataFrame:
    """Loci to be printed (chunk, pos) with the posterior of the step that each is in."""
    return sites.select("chunk", "pos", F.expr(f"pos div {loci}").cast("int").alias("step")).join(posterior, ["chunk", "step"])
