"""The relational operators over the test tables, each with DuckDB SQL for the same rows.

The tables hold no genomes; a fixed projection of ``lineitem`` stands in for genotypes of four haplotypes on two contigs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.functions.logspace import log_add, log_sub, log_sum_exp
from popspark.operators import blocks, csd, intervals, likelihood, multisets, search, sites, variants

HAPS, LOCI = 4, 50
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk, pos, hap, allele): parts are positions, suppliers haplotypes, line numbers alleles."""
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 2).cast("int").alias("chunk"), F.col("l_partkey").alias("pos"), (F.col("l_suppkey") % HAPS).cast("int").alias("hap"), (F.col("l_linenumber") % 2).cast("int").alias("allele"))
    return rows.groupBy("chunk", "pos", "hap").agg(F.max("allele").alias("allele"))


G = f"""g as (select cast(l_partkey % 2 as int) as chunk, l_partkey as pos, cast(l_suppkey % {HAPS} as int) as hap,
  max(cast(l_linenumber % 2 as int)) as allele from lineitem group by 1, 2, 3)"""
GRID = f"""{G}, h as (select * from (values (0), (1), (2), (3)) t(hap)),
full_grid as (select p.chunk, p.pos, h.hap, g.allele from (select distinct chunk, pos from g) p cross join h left join g using (chunk, pos, hap)),
site as (select chunk, pos, count(distinct coalesce(allele, -1)) as n_codes, count(*) - count(allele) as n_missing, min(allele) as low from full_grid group by 1, 2)"""


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.site_table(genotypes(spark, sf_dir), HAPS)


@query(f"with {GRID} select chunk, pos, n_codes > 1 as segregating, n_missing > 0 as with_missing from site")
def site_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which positions segregate, missing counted as a code, and which lack an allele."""
    return sites.classified(_sites(spark, sf_dir)).drop("alleles")


@query(f"with {GRID} select chunk, case when n_codes > 1 then 'segregating' else 'nonsegregating' end as status, count(*) as n, count(*) filter (where n_missing > 0) as n_missing from site group by 1, 2")
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many positions of each kind there are."""
    return sites.counters(_sites(spark, sf_dir))


@query(f"with {GRID} select chunk, pos, low as allele from site where n_codes = 1")
def reference_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's code at positions that do not segregate."""
    return sites.folded(_sites(spark, sf_dir))[1]


@query(f"with {G} select chunk, pos, hap, allele from g where hap in (select cast(s_suppkey % {HAPS} as int) from supplier where s_nationkey % 3 = 0 and s_suppkey % {HAPS} <> 2)")
def haplotype_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotypes of the haplotypes that a sampling layout uses."""
    used = _table(spark, sf_dir, "supplier").where(f"s_nationkey % 3 = 0 and s_suppkey % {HAPS} <> 2")
    config = used.select((F.col("s_suppkey") % HAPS).cast("int").alias("hap")).distinct().withColumn("multiplicity", F.array(F.lit(1), F.lit(0)))
    return sites.selected(genotypes(spark, sf_dir), config).select("chunk", "pos", "hap", "allele")


@query(f"""with {G}, m as (select cast(p_size % 2 as int) as chunk, p_partkey as s, p_partkey + p_size % 7 as e from part)
select distinct g.chunk, g.pos from g where not exists (select 1 from m where m.chunk = g.chunk and g.pos >= m.s and g.pos < m.e)""")
def interval_mask_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions outside all regions of a mask."""
    part = _table(spark, sf_dir, "part")
    mask = part.select((F.col("p_size") % 2).cast("int").alias("chunk"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size") % 7).alias("end"))
    return variants.unmasked(genotypes(spark, sf_dir).select("chunk", "pos").distinct(), mask, size=100)


@query("""select chunk, line_no, s as start, e as end, coalesce(previous_end, -1) as previous_end from (
select cast(p_size % 2 as int) as chunk, p_partkey as line_no, p_partkey as s, p_partkey + p_size % 7 as e,
  lag(p_partkey + p_size % 7) over (partition by p_size % 2 order by p_partkey) as previous_end from part)
where s >= e or s < previous_end""")
def mask_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a mask that are empty or overlap the one before."""
    mask = _table(spark, sf_dir, "part").select((F.col("p_size") % 2).cast("int").alias("chunk"), F.col("p_partkey").alias("line_no"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size") % 7).alias("end"))
    return variants.mask_faults(mask).withColumn("previous_end", F.coalesce("previous_end", F.lit(-1)))


@query("""select chunk, line_no, pos, previous_pos from (select cast(l_linenumber % 2 as int) as chunk, l_orderkey * 10 + l_linenumber as line_no, l_partkey as pos,
  lag(l_partkey) over (partition by l_linenumber % 2 order by l_orderkey * 10 + l_linenumber, l_partkey) as previous_pos from lineitem) where pos <= previous_pos""")
def order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose position is not above that of the line before."""
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 2).cast("int").alias("chunk"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), F.col("l_partkey").alias("pos"))
    return variants.order_faults(rows)


@query("""select chunk, pos, line_no, duplicate from (select cast(l_partkey % 2 as int) as chunk, l_partkey as pos, l_orderkey * 10 + l_linenumber as line_no,
  row_number() over (partition by l_partkey order by l_orderkey * 10 + l_linenumber) > 1 as duplicate from lineitem)""")
def duplicate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant lines, all but a position's first marked."""
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 2).cast("int").alias("chunk"), F.col("l_partkey").alias("pos"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"))
    return variants.first_of_duplicates(rows, strict=False)


BASES = "array['A', 'C', 'G', 'T', 'N']"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant lines out of lineitem: bases by its keys, FILTER and FORMAT by its flags."""
    base = lambda e: F.element_at(F.array(*map(F.lit, "ACGTN")), (e % 5 + 1).cast("int"))
    alt = F.when(F.col("l_linenumber") == 7, F.concat(base(F.col("l_suppkey")), F.lit(","), base(F.col("l_suppkey") + 1))).when(F.col("l_linenumber") == 6, F.lit(".")).otherwise(base(F.col("l_suppkey") + F.col("l_linenumber")))
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey"), F.col("l_linenumber"), base(F.col("l_partkey")).alias("ref"), alt.alias("alt"),
        F.when(F.col("l_returnflag") == "R", "LOW").otherwise("PASS").alias("filter"), F.when(F.col("l_tax") > 0.07, "GT:DP").otherwise("GT").alias("format"),
        (F.col("l_quantity") > 48).alias("masked"), ((F.col("l_orderkey") % 97) == 0).alias("duplicate"),
    )


LINES = """lines as (select l_orderkey, l_linenumber, substr('ACGTN', cast(l_partkey % 5 as int) + 1, 1) as ref,
  case when l_linenumber = 7 then substr('ACGTN', cast(l_suppkey % 5 as int) + 1, 1) || ',' || substr('ACGTN', cast((l_suppkey + 1) % 5 as int) + 1, 1)
       when l_linenumber = 6 then '.' else substr('ACGTN', cast((l_suppkey + l_linenumber) % 5 as int) + 1, 1) end as alt,
  case when l_returnflag = 'R' then 'LOW' else 'PASS' end as filter, case when l_tax > 0.07 then 'GT:DP' else 'GT' end as format,
  l_quantity > 48 as masked, l_orderkey % 97 = 0 as duplicate from lineitem)"""


@query(f"""with {LINES} select l_orderkey, l_linenumber, case when ref = 'N' then -1 else strpos('ACGT', ref) - 1 end as ref_code,
  array_to_string(list_transform(string_split(alt, ','), lambda a: case when strpos('ACGT', a) = 0 or a = '' then -1 else strpos('ACGT', a) - 1 end), ',') as alt_codes from lines""")
def allele_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of a line's alleles; -1 is missing."""
    codes = F.transform(variants.allele_codes(F.col("ref"), F.col("alt"), 4), lambda x: F.coalesce(x, F.lit(-1)))
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", codes.alias("codes"))
    return rows.select("l_orderkey", "l_linenumber", F.col("codes")[0].alias("ref_code"), F.array_join(F.transform(F.expr("slice(codes, 2, size(codes) - 1)"), lambda x: x.cast("string")), ",").alias("alt_codes"))


@query(f"""with {LINES}, coded as (select *, list_transform(list_concat([ref], string_split(alt, ',')), lambda a: case when strpos('ACGT', a) = 0 then -1 else strpos('ACGT', a) - 1 end) as codes from lines)
select l_orderkey, l_linenumber, case when masked then 'masked' when duplicate then 'duplicate' when filter <> 'PASS' then 'filter_failed'
  when len(string_split(alt, ',')) > 3 then 'too_many_alleles' when length(ref) <> 1 then 'multi_base'
  when len(list_distinct(codes)) <> len(codes) then 'equal_alleles' when format <> 'GT' then 'bad_format' else 'usable' end as status from coded""")
def line_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By which rule a variant line is used, blanks its position, is left out or is an error."""
    return variants.with_status(_lines(spark, sf_dir), 4, "PASS").select("l_orderkey", "l_linenumber", "status")


PAIRS = f"""{GRID}, ok as (select chunk, pos from site where n_missing = 0), used as (select full_grid.* from full_grid join ok using (chunk, pos)),
pairs as (select x.chunk, x.pos // {LOCI} as step, x.hap as add, y.hap as trunk, x.allele as a, y.allele as b, count(*) as n
  from used x join used y on x.chunk = y.chunk and x.pos = y.pos and x.hap <> y.hap group by all)"""


@query(f"with {PAIRS} select * from pairs")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each ordered pair of haplotypes shows each pair of alleles in each block."""
    return blocks.pair_counts(_sites(spark, sf_dir), LOCI)


@query(f"with {GRID} select chunk, pos // {LOCI} as step, low as allele, count(*) as n from site where n_codes = 1 and low is not null group by all")
def block_nonseg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci of each block that show one allele throughout."""
    return blocks.still_counts(sites.folded(_sites(spark, sf_dir))[1], LOCI)


@query(f"""with {PAIRS}, seg as (select x.chunk, x.pos // {LOCI} as step, x.hap as add, y.hap as trunk, x.allele as a, y.allele as b
  from used x join used y on x.chunk = y.chunk and x.pos = y.pos and x.hap <> y.hap join site s on s.chunk = x.chunk and s.pos = x.pos where s.n_codes > 1),
still as (select chunk, pos // {LOCI} as step, low as allele from site where n_codes = 1 and low is not null),
every as (select x.hap as add, y.hap as trunk from h x join h y on x.hap <> y.hap)
select chunk, step, add, trunk, a, b, count(*) as n from (select * from seg union all select chunk, step, add, trunk, allele, allele from still cross join every) group by all""")
def block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair counts of segregating loci with the others added to every pair's diagonal."""
    segregating, still = sites.folded(_sites(spark, sf_dir))
    return blocks.all_counts(blocks.pair_counts(segregating, LOCI), blocks.still_counts(still, LOCI), list(range(HAPS)))


@query(f"with {GRID} select chunk, pos from site where n_missing > 0")
def missing_locus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci that one missing allele blanks for all."""
    rows = _sites(spark, sf_dir)
    return rows.select("chunk", "pos").join(sites.complete(rows).select("chunk", "pos"), ["chunk", "pos"], "left_anti")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are haplotypes, nations contigs."""
    return _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("chunk"), F.col("s_suppkey").alias("hap"), (F.col("s_suppkey") % 3 + 1).alias("multiplicity"))


def _text(trunk: str = "trunk") -> Column:
    return F.array_join(F.col(trunk).cast("array<string>"), " ").alias("trunk")


S = "s as (select s_nationkey as chunk, s_suppkey as hap, s_suppkey % 3 + 1 as m from supplier)"
LOL = """select x.chunk, x.hap as add, x.m as csds, string_agg((y.hap || ':' || (y.m - case when y.hap = x.hap then 1 else 0 end)), ' ' order by y.hap) as trunk,
  cast(sum(y.m - case when y.hap = x.hap then 1 else 0 end) as bigint) as trunk_size from s x join s y on x.chunk = y.chunk and y.m - case when y.hap = x.hap then 1 else 0 end > 0 group by 1, 2, 3"""


@query(f"with {S} {LOL}")
def csd_lol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each haplotype of a contig against all others and the other copies of itself, as often as it has copies."""
    return csd.left_out_by_group(_suppliers(spark, sf_dir), "chunk")


@query(f"with {S} select x.chunk, x.hap as add, cast(y.hap as varchar) as trunk, 1.0::double as factor from s x join s y on x.chunk = y.chunk and x.hap <> y.hap")
def csd_pcl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ordered pair of haplotypes of a contig."""
    pairs = csd.pairs_by_group(_suppliers(spark, sf_dir), "chunk", shown=F.col("hap").cast("string"))
    return pairs.select("chunk", "add", F.col("trunk")[0].alias("trunk"), "factor")


@query("""with n as (select count(*) as n from nation) select 'pcl' as kind, x.n_nationkey as add, cast(y.n_nationkey as varchar) as trunk, round(1.0::double / (n * (n - 1)), 12) as factor from nation x join nation y on x.n_nationkey <> y.n_nationkey cross join n
union all select 'lol', x.n_nationkey, string_agg(cast(y.n_nationkey as varchar), ' ' order by y.n_nationkey), round(1.0::double / max(n), 12) from nation x join nation y on x.n_nationkey <> y.n_nationkey cross join n group by x.n_nationkey""")
def csd_pclol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds for one sample, each with a weight of one in all."""
    haps = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("hap"))
    return csd.pairwise_and_leave_one_out(haps).select("kind", "add", _text(), F.round("factor", 12).alias("factor"))


def _perms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A permutation of each nation's suppliers."""
    place = F.md5(F.col("hap").cast("string").cast("binary"))
    return _suppliers(spark, sf_dir).groupBy(F.col("chunk").alias("perm")).agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "hap"))).alias("o")).select("perm", F.col("o.hap").alias("ord"))


PERMS = """p as (select s_nationkey as perm, s_suppkey as hap, cast(row_number() over (partition by s_nationkey order by md5(cast(s_suppkey as varchar)) desc) - 1 as integer) as rank,
  count(*) over (partition by s_nationkey) as n from supplier),
pac as (select x.perm, x.rank as csd, x.hap as add, coalesce((select string_agg(cast(y.hap as varchar), ' ' order by y.rank) from p y where y.perm = x.perm and y.rank < x.rank), '') as trunk, 1.0::double as factor, x.n from p x)"""


@query(f"with {PERMS} select perm, csd, add, trunk, factor from pac")
def csd_pac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The growing trunks of permutations, read from last to first."""
    return csd.permuted(_perms(spark, sf_dir)).select("perm", "csd", "add", _text(), "factor")


@query(f"with {PERMS} select perm, csd, add, trunk, factor from pac where n <= 3 or csd in (cast(trunc(1::float + 0::float * ((n - 2)::float / 2::float)) as integer), cast(trunc(1::float + 1::float * ((n - 2)::float / 2::float)) as integer), cast(trunc(1::float + 2::float * ((n - 2)::float / 2::float)) as integer))")
def csd_pac_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three trunk sizes of each permutation, spread evenly."""
    return csd.permuted(_perms(spark, sf_dir), wanted=3).select("perm", "csd", "add", _text(), "factor")


@query(f"with {PERMS} select 0 as perm, cast(dense_rank() over (order by perm, csd) as integer) as csd, add, trunk, factor from pac")
def csd_superpac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All permutations in one list."""
    return csd.one_list(_perms(spark, sf_dir)).select("perm", "csd", "add", _text(), "factor")


@query("""select o_custkey % 11 as k, round(max(x) + ln(sum(exp(x - m))), 6) as total from (
  select o_custkey, o_totalprice / 10000 as x, max(o_totalprice / 10000) over (partition by o_custkey % 11) as m from orders) group by 1""")
def log_sum_exp_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-sum-exp of each group."""
    rows = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 11).alias("k"), (F.col("o_totalprice") / 10000).alias("x"))
    return log_sum_exp(rows, ["k"], "x", "total").withColumn("total", F.round("total", 6))


@query("""select l_orderkey, l_linenumber, round(greatest(a, b) + ln(1 + exp(least(a, b) - greatest(a, b))), 6) as added,
  case when a = b then null else round(greatest(a, b) + ln(1 - exp(least(a, b) - greatest(a, b))), 6) end as less
from (select l_orderkey, l_linenumber, l_quantity / 10 as a, l_extendedprice / 10000 as b from lineitem)""")
def log_add_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and differences of two numbers in log space."""
    a, b = F.col("l_quantity") / 10, F.col("l_extendedprice") / 10000
    less = F.when(a != b, F.round(log_sub(F.greatest(a, b), F.least(a, b)), 6))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(log_add(a, b), 6).alias("added"), less.alias("less"))


@query("""select chunk, deme, hap, multiplicity, deme_size, round(ln(multiplicity) - ln(deme_size), 9) as log_fraction from (
  select c_nationkey as chunk, c_mktsegment as deme, c_custkey as hap, c_custkey % 4 as multiplicity, cast(sum(c_custkey % 4) over (partition by c_nationkey, c_mktsegment) as bigint) as deme_size from customer) where multiplicity > 0""")
def absorption_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each haplotype's share of its deme, in log space."""
    rows = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("chunk"), F.col("c_mktsegment").alias("deme"), F.col("c_custkey").alias("hap"), (F.col("c_custkey") % 4).alias("multiplicity"))
    return likelihood.absorption(rows).withColumn("log_fraction", F.round("log_fraction", 9))


@query("""with perms as (select o_custkey % 7 as chunk, o_orderkey % 5 as perm, sum((1 + o_orderkey % 3) * -o_totalprice / 1e6) as l from orders group by 1, 2), tops as (select chunk, max(l) as m from perms group by 1)
select chunk, round(m + ln(sum(exp(l - m))), 6) as loglik from perms join tops using (chunk) group by chunk, m""")
def chunk_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sums by permutation, log-sum-exp over permutations."""
    rows = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("chunk"), (F.col("o_orderkey") % 5).alias("perm"), (1 + F.col("o_orderkey") % 3).alias("factor"), (-F.col("o_totalprice") / 1e6).alias("loglik"))
    return likelihood.chunk_likelihood(rows).withColumn("loglik", F.round("loglik", 6))


@query(f"with {PAIRS} select chunk, add, trunk, round(sum(n * ln(case when a = b then 0.9 else 0.1 end)), 6) as loglik from pairs group by 1, 2, 3")
def block_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelihood of each ordered pair under one hidden state."""
    found = likelihood.independent_sites(blocks.pair_counts(_sites(spark, sf_dir), LOCI), [[0.9, 0.1], [0.1, 0.9]])
    return found.withColumn("loglik", F.round("loglik", 6))


def _particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders")
    point = F.array(F.col("o_totalprice") / 1000, (F.col("o_custkey") % 100).cast("double") + 1)
    return rows.select((F.col("o_custkey") % 13).alias("generation"), F.col("o_orderkey").alias("particle_id"), (-F.col("o_totalprice") / 100).alias("loglik"), point.alias("point"))


P = "p as (select o_custkey % 13 as generation, o_orderkey as particle_id, -o_totalprice / 100 as loglik, o_totalprice / 1000 as x0, (o_custkey % 100)::double + 1 as x1 from orders)"


@query(f"with {P} select generation, particle_id, round(loglik, 6) as loglik, cast(rank as integer) as rank from (select *, row_number() over (partition by generation order by loglik desc, particle_id) as rank from p) where rank <= 5")
def generation_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each generation's five best particles."""
    return search.keep_best(_particles(spark, sf_dir), 5).select("generation", "particle_id", F.round("loglik", 6).alias("loglik"), "rank")


@query(f"with {P} select generation, coordinate, round(stddev_pop(x), 6) as sd from (select generation, 0 as coordinate, x0 as x from p union all select generation, 1, x1 from p) group by 1, 2")
def generation_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each coordinate's standard deviation."""
    return search.spread(_particles(spark, sf_dir)).withColumn("sd", F.round("sd", 6))


@query(f"with {P}, s as (select generation, stddev_pop(x0) as a, stddev_pop(x1) as b from p group by 1) select generation, round(exp((ln(a) + ln(b)) / 2), 6) as mean_sd from s")
def generation_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geometric mean of a generation's standard deviations."""
    return search.geometric_mean(search.spread(_particles(spark, sf_dir))).withColumn("mean_sd", F.round("mean_sd", 6))


@query(f"with {P} select generation, particle_id, round(loglik, 6) as loglik, round(x0, 6) as x0, x1 from (select *, row_number() over (partition by generation order by loglik desc, particle_id) as r from p) where r = 1")
def mle_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each generation's best point."""
    return search.argmax(_particles(spark, sf_dir)).select("generation", "particle_id", F.round("loglik", 6).alias("loglik"), F.round(F.col("point")[0], 6).alias("x0"), F.col("point")[1].alias("x1"))


@query(f"with {P} select generation, particle_id from p where x0 between 10 and 200 and x1 between 5 and 60")
def bounds_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles inside bounds."""
    return search.in_bounds(_particles(spark, sf_dir), [(10, 200), (5, 60)]).select("generation", "particle_id")


POINTS = "one as (select distinct c_nationkey as model, (c_custkey % 40)::double / 8 as t from customer where c_custkey % 2 = 0), two as (select distinct c_nationkey as model, (c_custkey % 40)::double / 5 as t from customer where c_custkey % 2 = 1)"


def _points(spark: SparkSession, sf_dir: str, which: int, scale: int) -> DataFrame:
    return _table(spark, sf_dir, "customer").where(f"c_custkey % 2 = {which}").select(F.col("c_nationkey").alias("model"), ((F.col("c_custkey") % 40).cast("double") / scale).alias("t")).distinct()


@query(f"with {POINTS}, both_sets as (select * from one union select * from two) select model, cast(row_number() over (partition by model order by t) - 1 as integer) as idx, t as start, coalesce(lead(t) over (partition by model order by t), 'inf'::double) as end from both_sets")
def breakpoints_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common refinement of two sets of intervals."""
    return intervals.refined(_points(spark, sf_dir, 0, 8), _points(spark, sf_dir, 1, 5))


@query("""select e.event_id as id, e.event_type as k, (select c.value from events c where c.event_type = e.event_type and c.event_id % 2 = 0 and c.ts <= e.ts order by c.ts desc, c.event_id desc limit 1) as value from events e where e.event_id % 2 = 1""")
def asof_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the last change at or before each time."""
    rows = _table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("k"), "ts", "value")
    # Changes at one time: the last by id counts.
    changes = rows.where("event_id % 2 = 0").groupBy("k", F.col("ts").alias("t")).agg(F.max_by("value", "event_id").alias("value"))
    times = rows.where("event_id % 2 = 1").select("k", F.col("ts").alias("t"), F.col("event_id").alias("id"))
    return intervals.as_of(times, changes, "k", "value").select("id", "k", "value")


@query("select chunk, state, n_haps, cast(sum(n_haps) over (partition by chunk order by state) - n_haps as bigint) as offset from (select l_suppkey as chunk, l_partkey as state, count(*) as n_haps from lineitem group by 1, 2)")
def prefix_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the haplotypes of each state begin."""
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("chunk"), F.col("l_partkey").alias("state")).agg(F.count("*").alias("n_haps"))
    return intervals.state_offsets(rows)


@query("""with recursive r(id, place, gap) as (select o_orderkey, 0, cast(floor(o_totalprice) as bigint) from orders union all select id, place + 1, gap - cast(2 ** floor(log2(gap)) as bigint) from r where gap - cast(2 ** floor(log2(gap)) as bigint) > 0)
select id, place, cast(2 ** floor(log2(gap)) as bigint) as jump from r where gap > 0""")
def power_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between decoded loci as jumps by powers of two."""
    return blocks.jumps(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("long").alias("gap")))


@query("""select c_nationkey as deme, c_mktsegment as hap, cast(sum(m) as bigint) as multiplicity from (select c_nationkey, c_mktsegment, c_custkey % 3 as m from customer where c_custkey % 2 = 0 union all select c_nationkey, c_mktsegment, c_custkey % 5 from customer where c_custkey % 2 = 1) group by 1, 2""")
def multiset_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples of haplotypes added up, deme by deme."""
    rows = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("deme"), F.col("c_mktsegment").alias("hap"), "c_custkey")
    one = rows.where("c_custkey % 2 = 0").select("deme", "hap", (F.col("c_custkey") % 3).alias("m"))
    other = rows.where("c_custkey % 2 = 1").select("deme", "hap", (F.col("c_custkey") % 5).alias("m"))
    return multisets.combined(one.withColumnRenamed("m", "multiplicity"), other.withColumnRenamed("m", "multiplicity"))


TAKEN = """all_of as (select c_nationkey as deme, c_mktsegment as hap, cast(sum(1 + c_custkey % 3) - count(*) filter (c_custkey % 2 = 1 or c_custkey % 3 = 0) as bigint) as multiplicity from customer group by 1, 2)"""


def _taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("deme"), F.col("c_mktsegment").alias("hap"), "c_custkey")
    fewer = rows.where("c_custkey % 2 = 1 or c_custkey % 3 = 0").select("deme", "hap", F.lit(-1).cast("long").alias("multiplicity"))
    return multisets.adjusted(rows.select("deme", "hap", (1 + F.col("c_custkey") % 3).alias("multiplicity")), fewer)


@query(f"with {TAKEN} select * from all_of where multiplicity <> 0")
def multiset_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of haplotypes from which some are taken away."""
    return _taken(spark, sf_dir)


@query(f"with {TAKEN} select deme, count(*) as types, cast(sum(multiplicity) as bigint) as total from all_of where multiplicity > 0 group by 1")
def multiset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different haplotypes each deme has, and how many in all."""
    return multisets.deme_totals(_taken(spark, sf_dir))


@query(f"with {G} select chunk, cast(count(distinct pos // {LOCI}) as bigint) as used_steps, cast((max(pos) + 1 + {LOCI - 1}) // {LOCI} as bigint) as steps from g group by 1")
def step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks a contig has, and how many hold a site."""
    rows = blocks.with_step(genotypes(spark, sf_dir), LOCI)
    return rows.groupBy("chunk").agg(F.count_distinct("step").alias("used_steps"), F.expr(f"(max(pos) + {LOCI}) div {LOCI}").alias("steps"))


@query(f"with {GRID} select chunk, pos from site where n_codes > 1 union select cast(c as int), x * 100 from range(2) t(c) cross join (select distinct pos // 100 as x from g)")
def decode_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where hidden states are printed: every hundredth locus and all segregating ones."""
    segregating, _ = sites.folded(_sites(spark, sf_dir))
    every = genotypes(spark, sf_dir).select(F.expr("(pos div 100) * 100").alias("pos")).distinct()
    return segregating.select("chunk", "pos").unionByName(every.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk"), "pos")).distinct()
