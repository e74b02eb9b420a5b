"""Queries that evaluate hidden Markov models on counts from the test tables; SQL cannot express most of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.jobs.inference import Data, Model, csds_of, em, genetic, likelihoods, prepared, prepared_from_sites, random_starts
from popspark.jobs.table_queries import GRID, HAPS, LOCI, PAIRS, _sites, genotypes
from popspark.model.hmm import Tables
from popspark.operators import blocks, csd, likelihood, sites
from popspark.shared import fresh
from popspark.sources.models import parse_demography, parse_params

PARAMS = "0.01\n0.01\n0 1\n1 0\n"
#: One population whose size changes once.
ONE = "[0.2]\n{{0}}\n?0\nnull\n0\n{{0}}\n?1\nnull\n0\n"
#: Two populations with migration that were one.
TWO = "[?0]\n{{0},{1}}\n?1 ?2\nnull\n0 ?3\n?3 0\n{{0,1}}\n?4\nnull\n0\n"


def _haps(spark: SparkSession) -> DataFrame:
    return spark.range(HAPS).select(F.col("id").cast("int").alias("hap"))


def _data(spark: SparkSession, sf_dir: str, kind: str, demography: str, demes: dict[int, int]) -> tuple[Data, Model]:
    model = Model(parse_demography(demography), parse_params(PARAMS), demes, len(set(demes.values())), loci=LOCI, interval_params=[3, 0.1, 2])
    return prepared_from_sites(_sites(spark, sf_dir), csds_of(kind, _haps(spark)), model, 2), model


def _two_states() -> Tables:
    """Two hidden states with plain numbers, so that SQL can follow the chain."""
    import numpy as np

    return Tables(np.log([0.6, 0.4]), np.log([0.7, 0.8]), np.log([[0.2, 0.1], [0.1, 0.1]]), np.log([[[0.95, 0.05], [0.05, 0.95]], [[0.6, 0.4], [0.4, 0.6]]]), np.zeros(2, int))


def _two_state(tensors: DataFrame, members: int = HAPS, **options: object) -> DataFrame:
    return likelihood.evaluated(tensors, {0: {((1,), 0): _two_states()}}, dict.fromkeys(range(members), 0), 1, 2, **options)


def _pair_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.code_tensors(_sites(spark, sf_dir), csd.pairwise(_haps(spark)), LOCI)


def forward_two_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forward pass of two hidden states over each contig, for each ordered pair of haplotypes."""
    return _two_state(_pair_tensors(spark, sf_dir)).select("chunk", "csd", F.round("loglik", 5).alias("loglik"))


def forward_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As forward_two_state, with loci that do not segregate: each block's are sent to a CSD once and hold for all its pairs."""
    segregating, still = sites.folded(_sites(spark, sf_dir))
    tensors = likelihood.code_tensors(segregating, csd.pairwise(_haps(spark)), LOCI, blocks.still_counts(still, LOCI))
    return _two_state(tensors).select("chunk", "csd", F.round("loglik", 5).alias("loglik"))


#: The haplotype of each member of a sample in which the first one is there twice.
MEMBERS = {0: 0, 1: 0, 2: 1, 3: 2, 4: 3}


def forward_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As forward_two_state, for a sample with two copies of a haplotype, whose pair agrees at all loci."""
    members = spark.createDataFrame([(i,) for i in MEMBERS], "hap int")
    tensors = likelihood.step_tensors(blocks.pair_counts(_sites(spark, sf_dir), LOCI), csd.pairwise(members), haps=MEMBERS)
    return _two_state(tensors, len(MEMBERS)).select("chunk", "csd", F.round("loglik", 5).alias("loglik"))


def skipping_two_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forward pass locus by locus, in which runs of loci without differences are jumped over by powers of two."""
    segregating, _ = sites.folded(_sites(spark, sf_dir))
    lengths = genotypes(spark, sf_dir).groupBy("chunk").agg((F.max("pos") + 1).alias("n_steps"))
    tensors = likelihood.step_tensors(blocks.pair_counts(segregating, 1), csd.pairwise(_haps(spark)), lengths=lengths)
    return _two_state(tensors, skip=True).select("chunk", "csd", F.round("loglik", 4).alias("loglik"))


def _skipped_tensors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    segregating, _ = sites.folded(_sites(spark, sf_dir))
    lengths = genotypes(spark, sf_dir).groupBy("chunk").agg((F.max("pos") + 1).alias("n_steps"))
    return likelihood.step_tensors(blocks.pair_counts(segregating, 1), csd.pairwise(_haps(spark)), lengths=lengths), lengths


def expected_skipping_two_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As expected_two_state, locus by locus, for loci of which only the segregating ones are visited."""
    found = likelihood.summed_stats(_two_state(_skipped_tensors(spark, sf_dir)[0], with_stats=True, skip=True))
    return found.select("kind", "place", F.round("value", 4).alias("value"))


def posterior_skipping_two_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posterior probability of each state at every hundredth locus, where only these and the segregating ones are visited."""
    tensors, lengths = _skipped_tensors(spark, sf_dir)
    at = sites.printed(_sites(spark, sf_dir), lengths.withColumnRenamed("n_steps", "n_loci"), every=100, segregating=False)
    found = likelihood.posteriors(tensors, {((1,), 0): _two_states()}, dict.fromkeys(range(HAPS), 0), 1, 2, at=at.select("chunk", F.col("pos").alias("step")))
    return found.select("chunk", "csd", "step", "state", F.round("probability", 6).alias("probability"))


def expected_two_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected first states, transitions with and without recombination, and emissions, summed over all pairs and contigs."""
    found = likelihood.summed_stats(_two_state(_pair_tensors(spark, sf_dir), with_stats=True))
    return found.select("kind", "place", F.round("value", 4).alias("value"))


def posterior_two_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posterior probability of each state at each block."""
    found = likelihood.posteriors(_pair_tensors(spark, sf_dir), {((1,), 0): _two_states()}, dict.fromkeys(range(HAPS), 0), 1, 2)
    return found.select("chunk", "csd", "step", "state", F.round("probability", 6).alias("probability"))


PI = [0.7, 0.3]
#: Population sizes of closed_form_likelihoods.
SIZES = [0.4, 0.9, 1.7, 3.1]


def _permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two CSDs of six seeded permutations, the very first without a trunk."""
    csds = csd.permuted(csd.shuffled(_haps(spark), 6, 11), sizes=[0, 1])
    return _two_state(likelihood.step_tensors(blocks.pair_counts(_sites(spark, sf_dir), LOCI), csds), stationary=PI)


def pac_two_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of approximate conditionals: permutations are summed contig by contig."""
    return likelihood.chunk_likelihood(_permuted(spark, sf_dir)).select("chunk", F.round("loglik", 5).alias("loglik"))


def oldpac_two_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As pac_two_state, with permutations summed once over all contigs."""
    return likelihood.across_contigs(_permuted(spark, sf_dir)).select(F.round("loglik", 5).alias("loglik"))


def superpac_two_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As pac_two_state, with all permutations in one list, whose likelihoods multiply."""
    csds = csd.one_list(csd.shuffled(_haps(spark), 6, 11), sizes=[0, 1])
    found = _two_state(likelihood.step_tensors(blocks.pair_counts(_sites(spark, sf_dir), LOCI), csds), stationary=PI)
    return likelihood.chunk_likelihood(found).select("chunk", F.round("loglik", 5).alias("loglik"))


def _fixed_tables(particle: int, key: object) -> Tables:
    return _two_states()


def imputed_two_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each haplotype against the three others, with all sites that lack alleles: what is put in for one follows the alleles that
    the others of the trunk show there."""
    tensors = likelihood.code_tensors(_sites(spark, sf_dir), csd.leave_one_out(_haps(spark)), LOCI, impute=True)
    found = likelihood.evaluated(tensors, {0: {((HAPS - 1,), 0): _two_states()}}, dict.fromkeys(range(HAPS), 0), 1, 2, stationary=PI, tables_of=_fixed_tables)
    return found.select("chunk", "csd", F.round("loglik", 4).alias("loglik"))


def rated_two_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As forward_two_state, where recombination is twice as frequent in three of seven blocks: the chain changes its tables."""
    import numpy as np

    one = _two_states()
    other = Tables(one.initial, np.log([0.4, 0.5]), np.log([[0.4, 0.2], [0.2, 0.3]]), one.emit, one.deme)
    steps = genotypes(spark, sf_dir).select("chunk", F.expr(f"pos div {LOCI}").alias("step")).distinct()
    # Ranges of blocks whose number is 1, 2 or 3 modulo 7.
    rates = steps.where("step % 7 in (1, 2, 3)").select("chunk", (F.col("step") * LOCI).alias("start"), ((F.col("step") + 1) * LOCI).alias("end"), F.lit(2.0).alias("rate"))
    tensors = likelihood.with_rates(_pair_tensors(spark, sf_dir), likelihood.rate_runs(rates, LOCI))
    tables = {((1,), 0, 0): one, ((1,), 0, round(float(np.log(2.0)) / likelihood.ALIKE)): other}
    return likelihood.evaluated(tensors, {0: tables}, dict.fromkeys(range(HAPS), 0), 1, 2).select("chunk", "csd", F.round("loglik", 5).alias("loglik"))


def _all_sizes(spark: SparkSession, sf_dir: str, one_list: bool = False) -> DataFrame:
    """All CSDs of six seeded permutations, with trunks from none to all other haplotypes."""
    csds = (csd.one_list if one_list else csd.permuted)(csd.shuffled(_haps(spark), 6, 11))
    tensors = likelihood.code_tensors(_sites(spark, sf_dir), csds, LOCI)
    tables = {0: {((k,), 0): _two_states() for k in range(1, HAPS)}}
    return likelihood.evaluated(tensors, tables, dict.fromkeys(range(HAPS), 0), 1, 2, stationary=PI)


def pac_csds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelihood of each CSD of each permutation: hidden states are haplotypes of trunks of up to all others."""
    return _all_sizes(spark, sf_dir).select("chunk", "perm", "csd", F.round("loglik", 5).alias("loglik"))


def pac_trunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of approximate conditionals with whole trunks."""
    return likelihood.chunk_likelihood(_all_sizes(spark, sf_dir)).select("chunk", F.round("loglik", 5).alias("loglik"))


def oldpac_trunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As pac_trunks, with permutations summed once over all contigs."""
    return likelihood.across_contigs(_all_sizes(spark, sf_dir)).select(F.round("loglik", 5).alias("loglik"))


def superpac_trunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As pac_trunks, with all permutations in one list."""
    return likelihood.chunk_likelihood(_all_sizes(spark, sf_dir, one_list=True)).select("chunk", F.round("loglik", 5).alias("loglik"))


def seeded_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four seeded permutations of the suppliers."""
    haps = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("hap"))
    return csd.shuffled_rows(haps, 4, 5)


def _lse(x: str, y: str) -> str:
    return f"(greatest({x}, {y}) + ln(1 + exp(least({x}, {y}) - greatest({x}, {y}))))"


def _chain(pairs: str, still: tuple[str, str] = ("0", "0")) -> str:
    """Tables grid_steps, e (emissions), f and b (forward and backward) of the two states, from rows of pairs."""
    e = [f"coalesce(e.e{s}, {still[s]})" for s in (0, 1)]
    n = [f"coalesce(n.e{s}, {still[s]})" for s in (0, 1)]
    return f"""grid_steps as (select chunk, max(step) as last from {pairs} group by 1),
who as (select distinct chunk, add, trunk from {pairs}),
e as (select chunk, add, trunk, step, sum(n * ln(case when a = b then 0.95 else 0.05 end)) as e0, sum(n * ln(case when a = b then 0.6 else 0.4 end)) as e1 from {pairs} group by 1, 2, 3, 4),
f(chunk, add, trunk, step, f0, f1) as (
  select w.chunk, w.add, w.trunk, 0, ln(0.6) + {e[0]}, ln(0.4) + {e[1]} from who w left join e on e.chunk = w.chunk and e.add = w.add and e.trunk = w.trunk and e.step = 0
  union all
  select f.chunk, f.add, f.trunk, f.step + 1, {_lse("f.f0 + ln(0.9)", "f.f1 + ln(0.1)")} + {e[0]}, {_lse("f.f0 + ln(0.1)", "f.f1 + ln(0.9)")} + {e[1]}
  from f join grid_steps g on g.chunk = f.chunk and f.step < g.last left join e on e.chunk = f.chunk and e.add = f.add and e.trunk = f.trunk and e.step = f.step + 1),
b(chunk, add, trunk, step, b0, b1) as (
  select w.chunk, w.add, w.trunk, g.last, 0.0::double, 0.0::double from who w join grid_steps g using (chunk)
  union all
  select b.chunk, b.add, b.trunk, b.step - 1, {_lse(f"b.b0 + {n[0]} + ln(0.9)", f"b.b1 + {n[1]} + ln(0.1)")}, {_lse(f"b.b0 + {n[0]} + ln(0.1)", f"b.b1 + {n[1]} + ln(0.9)")}
  from b left join e n on n.chunk = b.chunk and n.add = b.add and n.trunk = b.trunk and n.step = b.step where b.step > 0),
ends as (select f.chunk, f.add, f.trunk, {_lse("f0", "f1")} as total from f join grid_steps g on g.chunk = f.chunk and g.last = f.step)"""


FORWARD_SQL = f"with recursive {PAIRS}, {_chain('pairs')} select chunk, add * 4 + trunk as csd, round(total, 5) as loglik from ends"
BLOCKS_SQL = f"""with recursive {PAIRS}, seg as (select x.chunk, x.pos // {LOCI} as step, x.hap as add, y.hap as trunk, x.allele as a, y.allele as b
  from used x join used y on x.chunk = y.chunk and x.pos = y.pos and x.hap <> y.hap join site s on s.chunk = x.chunk and s.pos = x.pos where s.n_codes > 1),
still as (select chunk, pos // {LOCI} as step, low as allele from site where n_codes = 1 and low is not null),
every as (select x.hap as add, y.hap as trunk from h x join h y on x.hap <> y.hap),
whole as (select chunk, step, add, trunk, a, b, count(*) as n from (select * from seg union all select chunk, step, add, trunk, allele, allele from still cross join every) group by all),
{_chain('whole')} select chunk, add * 4 + trunk as csd, round(total, 5) as loglik from ends"""
RATED_SQL = f"""with recursive {PAIRS}, grid_steps as (select chunk, max(step) as last from pairs group by 1), seen as (select distinct chunk, pos // {LOCI} as step from g),
who as (select distinct chunk, add, trunk from pairs),
e as (select chunk, add, trunk, step, sum(n * ln(case when a = b then 0.95 else 0.05 end)) as e0, sum(n * ln(case when a = b then 0.6 else 0.4 end)) as e1 from pairs group by 1, 2, 3, 4),
turns as (select v.chunk, v.step, case when v.step % 7 in (1, 2, 3) and s.step is not null then 0.2 else 0.1 end as p from (select chunk, unnest(range(last + 1)) as step from grid_steps) v left join seen s using (chunk, step)),
f(chunk, add, trunk, step, f0, f1) as (
  select w.chunk, w.add, w.trunk, 0, ln(0.6) + coalesce(e.e0, 0), ln(0.4) + coalesce(e.e1, 0) from who w left join e on e.chunk = w.chunk and e.add = w.add and e.trunk = w.trunk and e.step = 0
  union all
  select f.chunk, f.add, f.trunk, f.step + 1, {_lse("f.f0 + ln(1 - t.p)", "f.f1 + ln(t.p)")} + coalesce(e.e0, 0), {_lse("f.f0 + ln(t.p)", "f.f1 + ln(1 - t.p)")} + coalesce(e.e1, 0)
  from f join turns t on t.chunk = f.chunk and t.step = f.step + 1 left join e on e.chunk = f.chunk and e.add = f.add and e.trunk = f.trunk and e.step = f.step + 1)
select f.chunk, f.add * 4 + f.trunk as csd, round({_lse("f0", "f1")}, 5) as loglik from f join grid_steps g on g.chunk = f.chunk and g.last = f.step"""
MEMBERS_SQL = f"""with recursive {PAIRS}, m as (select * from (values (0, 0), (1, 0), (2, 1), (3, 2), (4, 3)) t(member, hap)),
both_pairs as (select * from pairs union all select chunk, pos // {LOCI} as step, hap, hap, allele, allele, count(*) from used group by all),
whole as (select p.chunk, p.step, x.member as add, y.member as trunk, p.a, p.b, p.n from m x join m y on x.member <> y.member join both_pairs p on p.add = x.hap and p.trunk = y.hap),
{_chain('whole')} select chunk, add * 5 + trunk as csd, round(total, 5) as loglik from ends"""
SEG = f"""{PAIRS}, seg as (select x.chunk, x.pos as step, x.hap as add, y.hap as trunk, x.allele as a, y.allele as b, 1 as n
  from used x join used y on x.chunk = y.chunk and x.pos = y.pos and x.hap <> y.hap join site s on s.chunk = x.chunk and s.pos = x.pos where s.n_codes > 1),
{_chain('seg', ('ln(0.95)', 'ln(0.6)')).replace("select chunk, max(step) as last from seg group by 1", "select chunk, max(pos) as last from g group by 1")}"""
SKIPPING_SQL = f"with recursive {SEG} select chunk, add * 4 + trunk as csd, round(total, 4) as loglik from ends"


def _posteriors(where: str = "") -> str:
    return f"""select f.chunk, f.add * 4 + f.trunk as csd, f.step, s as state, round(exp(case when s = 0 then f0 + b0 else f1 + b1 end - total), 6) as probability
from f join b using (chunk, add, trunk, step) join ends using (chunk, add, trunk) cross join (values (0), (1)) t(s) {where}"""


def _expected(pairs: str, still: tuple[str, str] = ("0", "0"), quiet: str = "0") -> str:
    """Expected counts from the tables of a chain; quiet: the loci at which both show 0 in a step without counts."""
    return f"""p as (select f.*, b0, b1, total from f join b using (chunk, add, trunk, step) join ends using (chunk, add, trunk)),
s as (select * from (values (0), (1)) t(s)), d as (select * from (values (0), (1)) t(d)),
steps as (select p.chunk, s.s, d.d, case when s.s = 0 then p.f0 else p.f1 end - p.total as x,
   case when d.d = 0 then q.b0 + coalesce(e.e0, {still[0]}) else q.b1 + coalesce(e.e1, {still[1]}) end as y
   from p join b q on q.chunk = p.chunk and q.add = p.add and q.trunk = p.trunk and q.step = p.step + 1
   left join e on e.chunk = q.chunk and e.add = q.add and e.trunk = q.trunk and e.step = q.step cross join s cross join d),
moves as (select s, d, sum(exp(x + y + ln(case when s = 0 and d = 0 then 0.2 else 0.1 end))) as v from steps group by 1, 2)
select kind, cast(place as integer) as place, round(v, 4) as value from (
select 'initial' as kind, s as place, sum(exp(case when s = 0 then f0 + b0 else f1 + b1 end - total)) as v from p cross join s where step = 0 group by 1, 2
union all select 'stay', s, sum(exp(x + y + ln(case when s = 0 then 0.7 else 0.8 end))) from steps where s = d group by 1, 2
union all select 'move', s * 2 + d, v from moves
union all select 'own', s, v from moves where s = d
union all select 'emit', s * 4 + o.b * 2 + o.a, sum((coalesce(n, 0) + case when e.e0 is null and o.a = 0 and o.b = 0 then {quiet} else 0 end) * exp(case when s = 0 then f0 + b0 else f1 + b1 end - total))
  from p cross join s cross join (select x.d as a, y.d as b from d x cross join d y) o
  left join e using (chunk, add, trunk, step) left join {pairs} w using (chunk, add, trunk, step, a, b) group by 1, 2)"""


POSTERIOR_SQL = f"with recursive {PAIRS}, {_chain('pairs')} {_posteriors()}"
POSTERIOR_SKIPPING_SQL = f"with recursive {SEG} {_posteriors('where f.step % 100 = 0')}"
EXPECTED_SQL = f"with recursive {PAIRS}, {_chain('pairs')}, {_expected('pairs')}"
EXPECTED_SKIPPING_SQL = f"with recursive {SEG}, {_expected('seg', ('ln(0.95)', 'ln(0.6)'), '1')}"
PERMUTED_SQL = f"""with recursive {PAIRS}, {_chain('pairs')},
perms as (select p as perm, hap, cast(row_number() over (partition by p order by md5('11:' || p || ':' || hap) desc) - 1 as integer) as rank from range(6) r(p) cross join h),
first_ones as (select p.perm, p.hap as add, x.chunk, sum(x.n * ln(case when x.a = 0 then {PI[0]} else {PI[1]} end)) as l from perms p
  join pairs x on x.add = p.hap and x.trunk = (select min(hap) from h where hap <> p.hap) where p.rank = 0 group by 1, 2, 3),
each_perm as (select perm, chunk, sum(l) as l from (select perm, chunk, l from first_ones union all
  select y.perm, e.chunk, e.total from perms y join perms x on x.perm = y.perm and x.rank = 0 join ends e on e.add = y.hap and e.trunk = x.hap where y.rank = 1) group by 1, 2)"""


CLOSED_SQL = f"""with {PAIRS}, size as (select * from (values {', '.join(f'({i}, {x}::double)' for i, x in enumerate(SIZES))}) t(particle_id, s)),
core as (select unnest(['spectral', 'adaptive']) as core)
select cast(particle_id as bigint) as particle_id, chunk, round(sum(n * ln(case when a = b then (1 / s) / (1 / s + 0.01) else 1 - (1 / s) / (1 / s + 0.01) end)), 4) as loglik, core
from pairs cross join size cross join core group by particle_id, chunk, core"""
ONE_DEME_SQL = """with m as (select c_custkey, 0.2::double + (c_custkey % 50)::double / 20 as size, (1 + c_custkey % 9)::double as n, 0.01::double + (c_custkey % 7)::double / 50 as rho,
  0.01::double + (c_custkey % 11)::double / 40 as early, 0.02::double + (c_custkey % 5)::double / 30 as late from customer),
i as (select * from (values (0, 0.0::double, 0.25::double), (1, 0.25, 0.5), (2, 0.5, 1.0), (3, 1.0, 2.0), (4, 2.0, 1e9)) t(i, a, b)),
x as (select *, n / size as r, case when i < 2 then early else late end as theta, early * least(a, 0.5) + late * greatest(a - 0.5, 0) as gone from m cross join i),
y as (select *, exp(-r * a) - exp(-r * b) as mass, r / (r + rho) * (exp(-(r + rho) * a) - exp(-(r + rho) * b)) as together,
  exp(-gone) * r / (r + theta) * (exp(-r * a) - exp(-r * b - theta * (b - a))) as still from x)
select c_custkey, cast(i as integer) as interval, round(mass, 8) as initial, round(together / mass, 8) as stay, round(1 - still / mass, 8) as changed from y"""


TRUNKS_SQL = f"""with recursive {PAIRS}, {_chain('pairs')},
perms as (select p as perm, hap, cast(row_number() over (partition by p order by md5('11:' || p || ':' || hap) desc) - 1 as integer) as rank from range(6) r(p) cross join h),
slots as (select x.perm, x.rank as csd, x.hap as add, y.hap as trunk, y.rank as slot from perms x join perms y on x.perm = y.perm and y.rank < x.rank),
every as (select chunk, unnest(range(last + 1)) as step, last from grid_steps),
es as (select s.perm, s.csd, v.chunk, v.step, v.last, list(coalesce(e.e0, 0) order by s.slot) as x0, list(coalesce(e.e1, 0) order by s.slot) as x1
  from slots s cross join every v left join e on e.chunk = v.chunk and e.step = v.step and e.add = s.add and e.trunk = s.trunk group by 1, 2, 3, 4, 5),
c(perm, csd, chunk, step, f0, f1) as (
  select perm, csd, chunk, step, list_transform(x0, lambda x: x + ln(0.6) - ln(csd)), list_transform(x1, lambda x: x + ln(0.4) - ln(csd)) from es where step = 0
  union all
  select perm, csd, chunk, step, list_transform(range(1, csd + 1), lambda i: x0[i] + a0 + ln(1 + exp(f0[i] + ln(0.7) - a0))), list_transform(range(1, csd + 1), lambda i: x1[i] + a1 + ln(1 + exp(f1[i] + ln(0.8) - a1)))
  from (select *, m + ln(s0 * 0.2 + s1 * 0.1) - ln(csd) as a0, m + ln(s0 * 0.1 + s1 * 0.1) - ln(csd) as a1 from (
    select *, list_sum(list_transform(f0, lambda x: exp(x - m))) as s0, list_sum(list_transform(f1, lambda x: exp(x - m))) as s1 from (
      select c.perm, c.csd, c.chunk, es.step, c.f0, c.f1, es.x0, es.x1, greatest(list_max(c.f0), list_max(c.f1)) as m
      from c join es on es.perm = c.perm and es.csd = c.csd and es.chunk = c.chunk and es.step = c.step + 1)))),
last_ones as (select c.perm, c.csd, c.chunk, list_concat(f0, f1) as f from c join grid_steps g on g.chunk = c.chunk and g.last = c.step),
csds as (select perm, csd, chunk, list_max(f) + ln(list_sum(list_transform(f, lambda x: exp(x - list_max(f))))) as l from last_ones union all
  select p.perm, 0, x.chunk, sum(x.n * ln(case when x.a = 0 then {PI[0]} else {PI[1]} end)) from perms p
  join pairs x on x.add = p.hap and x.trunk = (select min(hap) from h where hap <> p.hap) where p.rank = 0 group by 1, 3),
each_perm as (select perm, chunk, sum(l) as l from csds group by 1, 2)"""


#: Shares of alleles: by the first state's law and emissions, of those that the others show.
IMPUTED_SQL = f"""with recursive {GRID}, trunks as (select x.hap as csd, y.hap as slot from h x join h y on x.hap <> y.hap),
cells as (select t.csd, t.slot, x.chunk, x.pos, x.allele as a, y.allele as b from trunks t join full_grid x on x.hap = t.csd join full_grid y on y.hap = t.slot and y.chunk = x.chunk and y.pos = x.pos where x.allele is not null),
shown as (select csd, chunk, pos, avg(b) as ones from cells group by all),
filled as (select c.*, case when s.ones is null then {PI[1]} else 0.6 * (s.ones * 0.95 + (1 - s.ones) * 0.05) + 0.4 * (s.ones * 0.6 + (1 - s.ones) * 0.4) end as p from cells c join shown s using (csd, chunk, pos)),
both_states as (select csd, slot, chunk, pos // {LOCI} as step,
  case when b is not null then case when a = b then 0.95 else 0.05 end else case when a = 1 then p * 0.95 + (1 - p) * 0.05 else p * 0.05 + (1 - p) * 0.95 end end as q0,
  case when b is not null then case when a = b then 0.6 else 0.4 end else case when a = 1 then p * 0.6 + (1 - p) * 0.4 else p * 0.4 + (1 - p) * 0.6 end end as q1 from filled),
e as (select csd, slot, chunk, step, sum(ln(q0)) as e0, sum(ln(q1)) as e1 from both_states group by all),
grid_steps as (select chunk, max(pos) // {LOCI} as last from full_grid group by 1),
every as (select chunk, unnest(range(last + 1)) as step from grid_steps),
es as (select t.csd, v.chunk, v.step, list(coalesce(e.e0, 0) order by t.slot) as x0, list(coalesce(e.e1, 0) order by t.slot) as x1
  from trunks t cross join every v left join e on e.csd = t.csd and e.slot = t.slot and e.chunk = v.chunk and e.step = v.step group by 1, 2, 3),
c(csd, chunk, step, f0, f1) as (
  select csd, chunk, step, list_transform(x0, lambda x: x + ln(0.6) - ln(3)), list_transform(x1, lambda x: x + ln(0.4) - ln(3)) from es where step = 0
  union all
  select csd, chunk, step, list_transform(range(1, 4), lambda i: x0[i] + a0 + ln(1 + exp(f0[i] + ln(0.7) - a0))), list_transform(range(1, 4), lambda i: x1[i] + a1 + ln(1 + exp(f1[i] + ln(0.8) - a1)))
  from (select *, m + ln(s0 * 0.2 + s1 * 0.1) - ln(3) as a0, m + ln(s0 * 0.1 + s1 * 0.1) - ln(3) as a1 from (
    select *, list_sum(list_transform(f0, lambda x: exp(x - m))) as s0, list_sum(list_transform(f1, lambda x: exp(x - m))) as s1 from (
      select c.csd, c.chunk, es.step, c.f0, c.f1, es.x0, es.x1, greatest(list_max(c.f0), list_max(c.f1)) as m from c join es on es.csd = c.csd and es.chunk = c.chunk and es.step = c.step + 1)))),
last_ones as (select c.csd, c.chunk, list_concat(f0, f1) as f from c join grid_steps g on g.chunk = c.chunk and g.last = c.step)
select chunk, csd, round(list_max(f) + ln(list_sum(list_transform(f, lambda x: exp(x - list_max(f))))), 4) as loglik from last_ones"""


def csd_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelihood of each leave-one-out CSD under two populations with migration."""
    data, model = _data(spark, sf_dir, "lol", TWO, {0: 0, 1: 0, 2: 1, 3: 1})
    found = model.tables([0.3, 1.0, 0.8, 0.5, 1.2], data.keys)
    return likelihood.evaluated(data.tensors, {0: found}, model.demes, model.n_demes, 2).drop("particle_id")


def expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected transitions and emissions of all pairwise CSDs, summed."""
    data, model = _data(spark, sf_dir, "pcl", ONE, dict.fromkeys(range(HAPS), 0))
    found = model.tables([1.0, 1.0], data.keys)
    return likelihood.summed_stats(likelihood.evaluated(data.tensors, {0: found}, model.demes, model.n_demes, 2, with_stats=True)).drop("particle_id")


def grid_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite likelihoods of a grid of population sizes."""
    from popspark.operators.search import grid

    data, model = _data(spark, sf_dir, "pcl", ONE, dict.fromkeys(range(HAPS), 0))
    points = grid(spark, [(0.25, 4.0), (0.25, 4.0)], 2)
    found = likelihoods(data, model, {r["particle_id"]: r["point"] for r in points.collect()})
    return points.join(found, "particle_id")


def closed_form_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise composite likelihoods of four sizes of one population with one hidden interval, each by both cores: no hidden
    state tells pairs apart, so all that counts is how often alleles differ."""
    from popspark.jobs.inference import made_tables

    out = None
    for core in ("spectral", "adaptive"):
        model = Model(parse_demography("[0.2]\n{{0}}\n?0\nnull\n0\n{{0}}\n?0\nnull\n0\n"), parse_params(PARAMS), dict.fromkeys(range(HAPS), 0), 1, loci=LOCI, interval_type="single", style="simple", core=core)
        data = prepared(blocks.pair_counts(_sites(spark, sf_dir), LOCI), csds_of("pcl", _haps(spark)), model, 2)
        found = made_tables(spark, model, {i: [s] for i, s in enumerate(SIZES)}, data.keys)
        rows = likelihood.evaluated(data.tensors, found, model.demes, 1, 2).groupBy("particle_id", "chunk").agg(F.round(F.sum("loglik"), 4).alias("loglik"))
        rows = rows.withColumn("core", F.lit(core))
        out = rows if out is None else out.unionByName(rows)
    return out


def one_deme_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of each customer's own model by closed forms: one population, of a size, with a trunk, a recombination rate and two
    mutation rates that are the customer's; a row for each hidden interval."""
    import numpy as np
    import pyarrow as pa

    from popspark.model.cores import made
    from popspark.shipping import ship
    from popspark.sources.models import Epoch, Params

    ship(spark)
    bounds = [0.0, 0.25, 0.5, 1.0, 2.0, float("inf")]

    def run(batches):
        for batch in batches:
            rows = []
            for key, size, n, rho, early, late in zip(*(batch.column(c).to_pylist() for c in ("k", "size", "n", "rho", "early", "late")), strict=True):
                epochs = (Epoch(0.0, 0.7, (frozenset({0}),), (size,), ((0.0,),), None, (0.0,)), Epoch(0.7, float("inf"), (frozenset({0}),), (size,), ((0.0,),), None, (0.0,)))
                params = Params(early, rho, np.array([[0.0, 1.0], [1.0, 0.0]]), (early, early, late, late, late))
                t = made("spectral", epochs, bounds, np.array([n]), 0, params, 1, "simple")
                rows += [(key, i, round(float(np.exp(t.initial[i])), 8), round(float(np.exp(t.stay[i])), 8), round(float(np.exp(t.emit[i, 0, 1])), 8)) for i in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["k", "interval", "initial", "stay", "changed"])

    c = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(c.alias("k"), (0.2 + (c % 50) / 20).alias("size"), (1 + c % 9).cast("int").alias("n"), (0.01 + (c % 7) / 50).alias("rho"), (0.01 + (c % 11) / 40).alias("early"), (0.02 + (c % 5) / 30).alias("late"))
    return rows.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, "k long, interval int, initial double, stay double, changed double").withColumnRenamed("k", "c_custkey")


def em_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of expectation-maximization of population sizes."""
    data, model = _data(spark, sf_dir, "pcl", ONE, dict.fromkeys(range(HAPS), 0))
    path = em(data, model, [1.0, 1.0], iterations=2, m_iterations=6)
    return spark.createDataFrame([(r["em_step"], r["loglik"], r["point"]) for r in path], "em_step int, loglik double, point array<double>")


def genetic_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations of three particles, each of which goes through expectation-maximization."""
    data, model = _data(spark, sf_dir, "lol", ONE, dict.fromkeys(range(HAPS), 0))
    model.limits = [(0.2, 5.0), (0.2, 5.0)]
    rows = genetic(data, model, random_starts(model.limits, 3, 1), 2, 1, 1, em_iterations=1, m_iterations=4)
    return spark.createDataFrame([(r["generation"], r["em_step"], r["particle_id"], r["loglik"], r["point"]) for r in rows], "generation int, em_step int, particle_id int, loglik double, point array<double>")


def posterior_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posterior probability of each hidden state at every block of each leave-one-out CSD."""
    data, model = _data(spark, sf_dir, "lol", TWO, {0: 0, 1: 0, 2: 1, 3: 1})
    found = model.tables([0.3, 1.0, 0.8, 0.5, 1.2], data.keys)
    return likelihood.posteriors(data.tensors, found, model.demes, model.n_demes, 2)


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair counts of contigs that arrive as files of a stream."""
    from popspark.jobs.table_queries import genotypes
    from popspark.streaming.contigs import count_arrivals

    where = fresh(spark, "stream")
    rows = genotypes(spark, sf_dir)
    # A folder for each contig, as a sequencing run would leave them.
    rows.repartition("chunk").write.parquet(f"{where}/in")
    count_arrivals(spark, f"{where}/in", rows.schema, HAPS, LOCI, f"{where}/out", f"{where}/state").awaitTermination()
    return spark.read.parquet(f"{where}/out").drop("batch")


def contigs_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutations summed once over all contigs."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit(0).alias("particle_id"), (F.col("o_orderkey") % 5).alias("perm"), (1 + F.col("o_orderkey") % 3).alias("factor"), (-F.col("o_totalprice") / 1e7).alias("loglik"))
    return likelihood.across_contigs(rows).select(F.round("loglik", 6).alias("loglik"))


QUERIES = {
    f.__name__: f
    for f in (
        forward_two_state, forward_blocks, forward_members, skipping_two_state, expected_skipping_two_state, posterior_skipping_two_state, expected_two_state, posterior_two_state, pac_two_state, oldpac_two_state, superpac_two_state,
        imputed_two_state, rated_two_state, pac_csds, pac_trunks, oldpac_trunks, superpac_trunks, seeded_permutations, csd_likelihoods, expected_counts, grid_likelihoods, closed_form_likelihoods, one_deme_tables, em_path, genetic_path, posterior_decoding, streamed_counts, contigs_together,
    )
}
SQL = {
    "forward_two_state": FORWARD_SQL,
    "forward_blocks": BLOCKS_SQL,
    "forward_members": MEMBERS_SQL,
    "skipping_two_state": SKIPPING_SQL,
    "expected_skipping_two_state": EXPECTED_SKIPPING_SQL,
    "posterior_skipping_two_state": POSTERIOR_SKIPPING_SQL,
    "expected_two_state": EXPECTED_SQL,
    "posterior_two_state": POSTERIOR_SQL,
    "pac_two_state": f"{PERMUTED_SQL} select chunk, round(max(m) + ln(sum(exp(l - m))), 5) as loglik from (select chunk, l, max(l) over (partition by chunk) as m from each_perm) group by 1",
    "oldpac_two_state": f"{PERMUTED_SQL} select round(max(m) + ln(sum(exp(l - m))), 5) as loglik from (select l, max(l) over () as m from (select perm, sum(l) as l from each_perm group by 1))",
    "superpac_two_state": f"{PERMUTED_SQL} select chunk, round(sum(l), 5) as loglik from each_perm group by 1",
    "imputed_two_state": IMPUTED_SQL,
    "rated_two_state": RATED_SQL,
    "pac_csds": f"{TRUNKS_SQL} select chunk, perm, csd, round(l, 5) as loglik from csds",
    "pac_trunks": f"{TRUNKS_SQL} select chunk, round(max(m) + ln(sum(exp(l - m))), 5) as loglik from (select chunk, l, max(l) over (partition by chunk) as m from each_perm) group by 1",
    "oldpac_trunks": f"{TRUNKS_SQL} select round(max(m) + ln(sum(exp(l - m))), 5) as loglik from (select l, max(l) over () as m from (select perm, sum(l) as l from each_perm group by 1))",
    "superpac_trunks": f"{TRUNKS_SQL} select chunk, round(sum(l), 5) as loglik from each_perm group by 1",
    "closed_form_likelihoods": CLOSED_SQL,
    "one_deme_tables": ONE_DEME_SQL,
    "seeded_permutations": "select p as perm, cast(row_number() over (partition by p order by md5('5:' || p || ':' || s_suppkey)) - 1 as integer) as place, s_suppkey as hap from supplier cross join (values (0), (1), (2), (3)) r(p)",
    "streamed_counts": f"with {PAIRS} select * from pairs",
    "contigs_together": "with p as (select o_orderkey % 5 as perm, sum((1 + o_orderkey % 3) * -o_totalprice / 1e7) as l from orders group by 1) select round(max(m) + ln(sum(exp(l - m))), 6) as loglik from (select l, max(l) over () as m from p)",
}
