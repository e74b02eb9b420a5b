"""Files that Spark writes from the test tables and reads again: variants, references, masks, sequences, lists and results.

Parts are loci (a part's key is its position, from 0 on), suppliers' parity is the contig, orders deal out haplotypes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.operators import blocks, csd, sites, variants
from popspark.operators.ordered import sum_before
from popspark.shared import fresh
from popspark.sources import text as T
from popspark.sources import vcf as V
from popspark.sources.layout import parse_layout, read_layout_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Haplotypes of the study; the third one is not used.
LAYOUT = parse_layout("0 2 1\n1\n1\n0\n1\n")
LOCI = 50


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(shift: int = 0) -> str:
    return f"substr('ACGT', cast((p_partkey * 7 + {shift}) % 4 as int) + 1, 1)"


REF = f"case when p_size % 25 = 7 then 'N' else {_base()} end"
ALT = f"case when p_size % 10 = 3 then {_base(1)} || ',' || {_base(2)} else {_base(1)} end"
FILTER = "case when p_size % 10 = 4 then 'LOW' else 'PASS' end"


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk, pos, again, line): a variant line for each part and contig with orders; some once more, with another genotype."""
    haps = F.expr("cast(l_orderkey % 4 as int)")
    allele = lambda h: F.coalesce(F.max(F.when(haps == h, F.col("l_linenumber") % 2)).cast("string"), F.lit(".")).alias(f"h{h}")
    seen = _table(spark, sf_dir, "lineitem").groupBy(F.expr("cast(l_suppkey % 2 as int)").alias("chunk"), F.col("l_partkey").alias("p_partkey")).agg(*[allele(h) for h in range(4)])
    rows = seen.join(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    rows = rows.withColumn("again", F.explode(F.expr("if(p_size % 10 = 5, array(0, 1), array(0))")))
    gts = F.when(F.col("again") == 1, F.lit("1|1\t1|1")).otherwise(F.concat("h0", F.lit("|"), "h1", F.lit("\t"), "h2", F.lit("|"), "h3"))
    cells = F.concat_ws("\t", F.lit("1"), (F.col("p_partkey") + 1).cast("string"), F.lit("."), F.expr(REF), F.expr(ALT), F.lit("50"), F.expr(FILTER), F.lit("."), F.lit("GT"), gts)
    return rows.select("chunk", F.col("p_partkey").alias("pos"), "again", cells.alias("value"))


HEAD = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB"


def _vcf(spark: SparkSession, sf_dir: str, where: str) -> list[str]:
    """Variant files of the two contigs, whose header names the reference."""
    rows = _variants(spark, sf_dir)
    paths = []
    for chunk in (0, 1):
        head = spark.createDataFrame([(-2, 0, "##reference=file://ref.fa"), (-1, 0, HEAD)], "pos long, again int, value string")
        T.write_lines(rows.where(F.col("chunk") == chunk).select("pos", "again", "value").unionByName(head), f"{where}/{chunk}.vcf", "pos", "again")
        paths.append(f"{where}/{chunk}.vcf")
    return paths


def _fasta(spark: SparkSession, sf_dir: str, where: str) -> str:
    base = _table(spark, sf_dir, "part").select(F.expr("p_partkey div 60").alias("line"), "p_partkey", F.expr(f"if(p_partkey % 2 = 0, lower({REF}), {REF})").alias("base"))
    lines = base.groupBy("line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "base"))), lambda x: x["base"]), "").alias("value"))
    T.write_lines(lines.unionByName(spark.createDataFrame([(-1, ">contig")], "line long, value string")), f"{where}/ref.fa", "line")
    return f"{where}/ref.fa"


def _bed(spark: SparkSession, sf_dir: str, where: str) -> str:
    """Regions of up to three loci that begin at some of the small parts."""
    rows = _table(spark, sf_dir, "part").where("p_partkey % 4 = 1 and p_size < 10").select("p_partkey", F.concat_ws("\t", F.lit("1"), F.col("p_partkey").cast("string"), (F.col("p_partkey") + 1 + F.col("p_size") % 3).cast("string")).alias("value"))
    T.write_lines(rows, f"{where}/mask.bed", "p_partkey")
    return f"{where}/mask.bed"


def _study(spark: SparkSession, sf_dir: str) -> V.Ingested:
    """The whole study; the reference is the one that the variant files name."""
    where = fresh(spark, "study")
    _fasta(spark, sf_dir, where)
    bed = _bed(spark, sf_dir, where)
    return V.ingest(spark, _vcf(spark, sf_dir, where), None, LAYOUT, "PASS", [bed, bed], strict_duplicates=False)


LINES = f"""seen as (select cast(l_suppkey % 2 as int) as chunk, l_partkey as p_partkey, {", ".join(f"coalesce(cast(max(case when l_orderkey % 4 = {h} then l_linenumber % 2 end) as varchar), '.') as h{h}" for h in range(4))} from lineitem group by 1, 2),
first_lines as (select s.*, p.p_size, 0 as again from seen s join part p using (p_partkey)),
lines as (select chunk, p_partkey, p_size, 0 as again, h0, h1, h2, h3 from first_lines union all select chunk, p_partkey, p_size, 1, '1', '1', '1', '1' from first_lines where p_size % 10 = 5),
regions as (select p_partkey as low, p_partkey + 1 + p_size % 3 as high from part where p_partkey % 4 = 1 and p_size < 10),
judged as (select l.*, p_partkey as pos, case when exists (select 1 from regions r where l.p_partkey >= r.low and l.p_partkey < r.high) then 'masked'
  when again = 1 then 'duplicate' when p_size % 10 = 4 then 'filter_failed' when p_size % 10 = 3 then 'too_many_alleles' else 'usable' end as status from lines l),
decoded as (select chunk, pos, h0, h1, h3, h0 = h1 and h1 = h3 as still from judged where status = 'usable'),
loci as (select c as chunk, p_partkey as pos, p_size, {REF} as base from part cross join (values (0), (1)) t(c)),
ref as (select l.chunk, l.pos, case when exists (select 1 from regions r where l.pos >= r.low and l.pos < r.high) then null
  when d.still then case when d.h0 = '.' then null else cast(d.h0 as int) end
  when exists (select 1 from judged j where j.chunk = l.chunk and j.pos = l.pos and j.status in ('filter_failed', 'too_many_alleles')) then null
  when l.base = 'N' then null else 0 end as allele
  from loci l left join decoded d on d.chunk = l.chunk and d.pos = l.pos where d.still is null or d.still)"""


@query(f"with {LINES} select chunk, p_partkey as pos, {REF} as ref, {ALT} as alt, {FILTER} as filter, 'GT' as format, h0 || '|' || h1 || ' ' || h2 || '|' || h3 as gts from lines")
def vcf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant lines as a file gives them."""
    rows = V.read_lines(spark, _vcf(spark, sf_dir, fresh(spark, "vcf")))
    return rows.select("chunk", "pos", "ref", "alt", "filter", "format", F.array_join("gts", " ").alias("gts"))


@query(f"""with {LINES}, g as (select chunk, pos, unnest([0, 1, 2]) as hap, unnest([h0, h1, h3]) as code from judged where status in ('usable', 'masked') and again = 0 and p_size % 10 not in (3, 4))
select chunk, pos, hap, case when code <> '.' then cast(code as int) end as allele from g""")
def vcf_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotypes of the used haplotypes at lines that pass, decoded from the file; a position's first line counts."""
    rows = V.read_lines(spark, _vcf(spark, sf_dir, fresh(spark, "vcf")))
    rows = variants.with_status(variants.first_of_duplicates(rows, strict=False).withColumn("masked", F.lit(False)), 2, "PASS").where("status = 'usable'")
    return V.decoded_genotypes(rows, LAYOUT)


@query(f"with {LINES} select chunk, status, count(*) as n from judged group by 1, 2")
def ingest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each contig are used, left out, or blank their locus."""
    return V.line_counters(_study(spark, sf_dir))


def _cells(alleles: str = "alleles") -> Column:
    return F.array_join(F.transform(alleles, lambda x: F.coalesce(x.cast("string"), F.lit("."))), " ").alias("alleles")


@query(f"with {LINES} select chunk, pos, h0 || ' ' || h1 || ' ' || h3 as alleles from decoded where not still")
def ingest_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segregating sites of a whole ingest: reference, mask, filter and duplicates taken into account."""
    return _study(spark, sf_dir).sites.select("chunk", "pos", _cells())


@query(f"with {LINES} select chunk, pos - 3 as pos, h0 || ' ' || h1 || ' ' || h3 as alleles from decoded where not still and pos >= 3")
def ingest_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ingest_sites, where positions count from three loci further on: the reference lacks the first three, and files name
    lines by the longer one's places."""
    where = fresh(spark, "study")
    rows = _variants(spark, sf_dir).where("pos >= 3")
    paths = []
    for chunk in (0, 1):
        head = spark.createDataFrame([(-1, 0, HEAD)], "pos long, again int, value string")
        T.write_lines(rows.where(F.col("chunk") == chunk).select("pos", "again", "value").unionByName(head), f"{where}/{chunk}.vcf", "pos", "again")
        paths.append(f"{where}/{chunk}.vcf")
    bases = _table(spark, sf_dir, "part").where("p_partkey >= 3").select("p_partkey", F.expr(REF).alias("value"))
    T.write_lines(bases, f"{where}/short.fa", "p_partkey")
    # A mask counts as the reference does.
    regions = _table(spark, sf_dir, "part").where("p_partkey % 4 = 1 and p_size < 10 and p_partkey >= 3").select("p_partkey", F.concat_ws("\t", F.lit("1"), (F.col("p_partkey") - 3).cast("string"), (F.col("p_partkey") - 2 + F.col("p_size") % 3).cast("string")).alias("value"))
    before = _table(spark, sf_dir, "part").where("p_partkey = 1 and p_size < 10 and p_size % 3 = 2").select("p_partkey", F.lit("1\t0\t1").alias("value"))
    T.write_lines(before.unionByName(regions), f"{where}/mask.bed", "p_partkey")
    study = V.ingest(spark, paths, [f"{where}/short.fa"] * 2, LAYOUT, "PASS", [f"{where}/mask.bed"] * 2, offset=3, strict_duplicates=False)
    return study.sites.select("chunk", "pos", _cells())


@query(f"with {LINES} select chunk, pos, allele from ref")
def ingest_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference of a whole ingest, locus by locus: missing where it is masked, blanked or unknown."""
    return _study(spark, sf_dir).reference


@query(f"with {LINES} select chunk, pos // {LOCI} as step, allele, count(*) as n from ref where allele is not null group by all")
def ingest_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci of each block that show one allele, counted on the blocks of the reference."""
    return blocks.still_in_blocks(_study(spark, sf_dir).blocks, LOCI, 2)


@query(f"with {LINES} select chunk, count(*) as n_loci, cast((count(*) + {LOCI} - 1) // {LOCI} as bigint) as n_steps from loci group by 1")
def ingest_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many loci and blocks each contig has."""
    return _study(spark, sf_dir).lengths.select("chunk", "n_loci", F.expr(f"(n_loci + {LOCI} - 1) div {LOCI}").alias("n_steps"))


@query(f"with {LINES}, every as (select chunk, pos from loci where pos % 100 = 0) select chunk, pos from decoded where not still union select chunk, pos from every")
def ingest_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci at which hidden states are printed: every hundredth and all segregating ones."""
    study = _study(spark, sf_dir)
    return sites.printed(study.sites, study.lengths, 100)


@query(f"select p_partkey as pos, {REF} as base from part")
def fasta_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference's bases in upper case, from a file of many lines, read in blocks."""
    rows = T.read_reference(spark, [_fasta(spark, sf_dir, fresh(spark, "fasta"))], 1000)
    return rows.select("start", F.posexplode(F.split("bases", "")).alias("i", "base")).where("base <> ''").select((F.col("start") + F.col("i")).alias("pos"), "base")


@query("select p_partkey as start, p_partkey + 1 + p_size % 3 as end from part where p_partkey % 4 = 1 and p_size < 10")
def bed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a mask file."""
    return T.read_mask(spark, [_bed(spark, sf_dir, fresh(spark, "bed"))]).select("start", "end")


def _letters(h: int) -> str:
    return f"case when p_size % 20 = {h} then 'N' else substr('ACGT', cast((p_partkey + (p_size % 3 // 2) * {h}) % 4 as int) + 1, 1) end"


def _sequence(spark: SparkSession, sf_dir: str, h: int, where: str = "true") -> DataFrame:
    rows = _table(spark, sf_dir, "part").where(where).select("p_partkey", F.expr(_letters(h).replace("//", "div")).alias("letter"))
    # A line of the format is a whole sequence.
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "letter"))), lambda x: x["letter"]), "").alias("value")).select(F.lit(h).alias("h"), "value")


FULL = parse_layout("0 4 1\n1\n0\n1\n1\n")
CODES = ", ".join(f"case when {_letters(h)} = 'N' then '.' else cast(strpos('ACGT', {_letters(h)}) - 1 as varchar) end" for h in (0, 2, 3))


def _sequences(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    out = _sequence(spark, sf_dir, 0, where)
    for h in (1, 2, 3):
        out = out.unionByName(_sequence(spark, sf_dir, h, where))
    return out


@query(f"select p_partkey as pos, concat_ws(' ', {CODES}) as alleles from part")
def sequence_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of a file with a sequence a line, of which one is not used."""
    path = f"{fresh(spark, 'sequences')}/s"
    every = None
    for h in range(4):
        own = _table(spark, sf_dir, "part").select((F.lit(h << 41) + F.col("p_partkey")).alias("place"), F.expr(_letters(h).replace("//", "div")).alias("letter"))
        every = own if every is None else every.unionByName(own)
    # Each line has its end; a comment ends with the letter that ends the file.
    every = every.unionByName(spark.createDataFrame([(((h + 1) << 41) - 1, "\n") for h in range(4)] + [(4 << 41, "#"), ((4 << 41) + 1, "A")], "place long, letter string"))
    # Written as it is read: what lies between two letters A is a row, so that none holds a line.
    marked = sum_before(every.withColumn("mark", (F.col("letter") == "A").cast("long")), [], "place", [], "mark", "k", rows=50_000)
    between = F.filter(F.sort_array(F.collect_list(F.struct("place", "letter"))), lambda x: x["letter"] != "A")
    pieces = marked.groupBy("k").agg(F.array_join(F.transform(between, lambda x: x["letter"]), "").alias("value"))
    T.write_lines(pieces, path, "k", mark="A")
    return V.sequences(spark, [path], FULL).select("pos", _cells())


def _section(spark: SparkSession, place: int, value: str) -> DataFrame:
    return spark.createDataFrame([(place, value)], "h int, value string")


@query(f"select p_partkey as pos, concat_ws(' ', {CODES}) as alleles from part where p_size % 2 = 1")
def compressed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of a file of sections, whose reference marks the segregating ones."""
    path = f"{fresh(spark, 'compressed')}/c"
    marks = _table(spark, sf_dir, "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", F.expr("if(p_size % 2 = 1, 'x', 'A')").alias("c")))), lambda x: x["c"]), "").alias("value")).select(F.lit(-2).alias("h"), "value")
    lines = _section(spark, -3, "REFERENCE").unionByName(marks).unionByName(_section(spark, -1, "HAPLOTYPES")).unionByName(_sequences(spark, sf_dir, "p_size % 2 = 1"))
    T.write_lines(lines, path, "h")
    return V.compressed_sequences(spark, path, FULL).select("pos", _cells())


@query(f"select p_partkey as pos, concat_ws(' ', {CODES}) as alleles from part where p_size % 2 = 1")
def old_compressed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of a file whose first line lists the segregating ones."""
    path = f"{fresh(spark, 'compressed')}/o"
    places = _table(spark, sf_dir, "part").where("p_size % 2 = 1").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p_partkey")), lambda x: x.cast("string")), " ").alias("value")).select(F.lit(-1).alias("h"), "value")
    T.write_lines(places.unionByName(_sequences(spark, sf_dir, "p_size % 2 = 1")), path, "h")
    return V.old_compressed_sequences(spark, path, FULL).select("pos", _cells())


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout file with a haplotype for each supplier, in up to two of three demes."""
    path = f"{fresh(spark, 'layout')}/l"
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws(" ", *[F.expr(f"cast(if(s_nationkey % 3 = {d} or s_suppkey % 5 = {d}, s_suppkey % 3, 0) as string)") for d in range(3)]).alias("value"))
    T.write_lines(rows.unionByName(spark.createDataFrame([(-1, "1000 2 3")], "s_suppkey long, value string")), path, "s_suppkey")
    return read_layout_table(spark, path)


@query("""with r as (select row_number() over (order by s_suppkey) - 1 as haplotype, s_suppkey, s_nationkey from supplier), d as (select unnest(range(3)) as deme),
m as (select haplotype, deme, s_suppkey % 3 as m from r cross join d where (s_nationkey % 3 = deme or s_suppkey % 5 = deme) and s_suppkey % 3 > 0),
c as (select haplotype, deme, unnest(range(m)) as copy from m)
select cast(row_number() over (order by haplotype, deme, copy) - 1 as integer) as hap, cast(haplotype as integer) as haplotype, cast(deme as integer) as deme from c""")
def layout_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of a sample whose haplotypes are there several times and in several demes."""
    return csd.members(_layout(spark, sf_dir))


@query("select cast(row_number() over (order by c_custkey) - 1 as integer) as particle_id, c_acctbal as x0, (c_custkey % 100)::double / 4 as x1 from customer")
def start_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start points of a search, from a file."""
    path = f"{fresh(spark, 'start')}/s"
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", F.col("c_acctbal").cast("string"), ((F.col("c_custkey") % 100).cast("double") / 4).cast("string")).alias("value"))
    T.write_lines(rows, path, "c_custkey")
    return T.read_start_points(spark, path, 2).select("particle_id", F.col("point")[0].alias("x0"), F.col("point")[1].alias("x1"))


@query("select cast(row_number() over (order by o_orderkey) - 1 as integer) as csd, cast(o_orderkey % 7 as integer) as add, case when o_orderkey % 4 = 0 then '' else (7 + o_orderkey % 5) || ' ' || (12 + o_orderkey % 3) end as trunk, 1.0::double as factor from orders")
def csd_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of CSDs from a file: an additional haplotype and its trunk, which may be empty."""
    path = f"{fresh(spark, 'csds')}/l"
    line = F.expr("concat(o_orderkey % 7, if(o_orderkey % 4 = 0, '', concat(' ', 7 + o_orderkey % 5, ' ', 12 + o_orderkey % 3)))")
    T.write_lines(_table(spark, sf_dir, "orders").select("o_orderkey", line.alias("value")), path, "o_orderkey")
    return csd.listed(T.chunked_lines(spark, [path])).select("csd", "add", F.array_join(F.transform("trunk", lambda x: x.cast("string")), " ").alias("trunk"), "factor")


@query("select cast(dense_rank() over (order by s_suppkey) - 1 as integer) as perm, cast(i as integer) as place, cast((i * (1 + s_suppkey % 4) + s_suppkey) % 5 as integer) as hap from supplier cross join range(5) t(i)")
def permutation_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutations of five haplotypes from a file."""
    path = f"{fresh(spark, 'perms')}/p"
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ((i * (1 + F.col("s_suppkey") % 4) + F.col("s_suppkey")) % 5).cast("string")), " ")
    T.write_lines(_table(spark, sf_dir, "supplier").select("s_suppkey", line.alias("value")), path, "s_suppkey")
    return csd.permutations(T.chunked_lines(spark, [path]), 5).select("perm", F.posexplode("ord").alias("place", "hap"))


@query("select '[' || (c_custkey % 3) || '_' || (c_custkey % 7) || '_' || c_custkey || ']' as label, c_acctbal as loglik, cast(c_custkey * 3 as bigint) as ms, c_acctbal / 2 as x0, c_custkey::double as x1 from customer")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a search as tab-separated lines, read again."""
    path = f"{fresh(spark, 'results')}/r"
    rows = _table(spark, sf_dir, "customer").select((F.col("c_custkey") % 3).cast("int").alias("generation"), (F.col("c_custkey") % 7).cast("int").alias("em_step"), F.col("c_custkey").cast("int").alias("particle_id"), F.col("c_acctbal").alias("loglik"), (F.col("c_custkey") * 3).alias("ms"), F.array(F.col("c_acctbal") / 2, F.col("c_custkey").cast("double")).alias("point"))
    T.write_results(rows, path)
    c = F.split("value", "\t")
    return spark.read.text(path).select(c[4].alias("label"), c[0].cast("double").alias("loglik"), c[1].cast("long").alias("ms"), c[2].cast("double").alias("x0"), c[3].cast("double").alias("x1"))
