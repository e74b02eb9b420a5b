"""Mixing sources to target weights: budgets go down a tree of domains, languages and sources, then seeded epochs fill them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from popspark.llm.common import SPACE, WORD, named, table
from popspark.shared import cut

LEVELS = ("domain", "lang", "source")
#: Documents of a leaf that one range of the seeded order holds, about.
RANGE = 2000


def domain_of(source: Column) -> Column:
    """The domain of a source: four domains, dealt by the source's number; sources without one are in d0."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.coalesce(F.when(number != "", number.cast("long") % 4), F.lit(0)).cast("string"))


@dataclass(frozen=True)
class Weights:
    """A node's share among its siblings, in thousandths; names that are not listed have ``other``. A node of weight 0 gives
    nothing, and neither does what is below it. ``domain_of`` maps a source to its domain."""

    domain: Mapping[str, int] = field(default_factory=dict)
    lang: Mapping[str, int] = field(default_factory=dict)
    source: Mapping[str, int] = field(default_factory=dict)
    other: int = 100
    domain_of: Callable[[Column], Column] = domain_of

    def __post_init__(self) -> None:
        if min([self.other, *self.domain.values(), *self.lang.values(), *self.source.values()]) < 0:
            raise ValueError("a weight is negative")


WEIGHTS = Weights({"d0": 400, "d1": 300, "d2": 200, "d3": 100}, {"en": 600, "de": 150, "fr": 150, "es": 100})


def _weight(name: Column, weights: Mapping[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, w in weights.items():
        out = F.when(name == k, w).otherwise(out)
    return out.cast("long")


def _fill(nodes: DataFrame, parent: list[str], budget: str) -> DataFrame:
    """nodes (capacity, weight, their parent's budget) with what each gets, column ``granted``.

    Water fills siblings in proportion to weight; those that cannot hold their share get their capacity, and the others
    share the rest. Ordered by capacity a weight, the full ones come first: one is full if it holds less than its share of
    what those before it leave. Shares are rounded down.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), "name")
    everyone = Window.partitionBy(*parent)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumn("_left", F.col(budget) - before).withColumn("_after", after)
    nodes = nodes.withColumn("_full", F.col("capacity") * F.col("_after") <= F.col("_left") * F.col("weight"))
    # The first that is not full sets the level for itself and all after it.
    place = F.row_number().over(order)
    nodes = nodes.withColumn("_place", place).withColumn("_first", F.min(F.when(~F.col("_full"), F.col("_place"))).over(everyone))
    level_left = F.max(F.when(F.col("_place") == F.col("_first"), F.col("_left"))).over(everyone)
    level_weight = F.max(F.when(F.col("_place") == F.col("_first"), F.col("_after"))).over(everyone)
    nodes = nodes.withColumn("_a", level_left).withColumn("_b", level_weight)
    share = F.expr("(_a * weight) div _b")
    return nodes.withColumn("granted", F.when(F.coalesce(F.col("_place") < F.col("_first"), F.lit(True)), F.col("capacity")).otherwise(share)).drop("_left", "_after", "_full", "_place", "_first", "_a", "_b")


def budgets(leaves: DataFrame, per_mille: int, epochs: int, weights: Weights = WEIGHTS) -> DataFrame:
    """leaves (domain, lang, source, tokens, docs) with target, the tokens that each is to give.

    The root has per_mille thousandths of all tokens. A node can give what its leaves hold, times epochs. What a node cannot
    give goes to its siblings; only what none of them can give has already been taken by their parent's siblings, as each
    node is granted no more than its subtree holds. So shortages go to siblings before ancestors.
    """
    of = {c: _weight(F.col(c), getattr(weights, c), weights.other) for c in LEVELS}
    held = F.col("tokens") * epochs
    # Where a weight is 0 there is nothing to give, so what it weighs does not matter.
    open_ = (of["domain"] > 0) & (of["lang"] > 0) & (of["source"] > 0)
    of = {c: F.greatest(w, F.lit(1).cast("long")) for c, w in of.items()}
    leaves = leaves.withColumn("held", held).withColumn("capacity", F.when(open_, held).otherwise(F.lit(0).cast("long")))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.sum("held").alias("held"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("held").alias("held"))
    root = F.expr(f"(sum(held) over () * {per_mille}) div {1000 * epochs}")
    top = domains.select("domain", F.col("domain").alias("name"), "capacity", of["domain"].alias("weight"), root.alias("budget"), F.lit(0).alias("root"))
    top = _fill(top, ["root"], "budget").select("domain", F.col("granted").alias("budget"))
    middle = langs.join(top, "domain").withColumn("name", F.col("lang")).withColumn("weight", of["lang"])
    middle = _fill(middle, ["domain"], "budget").select("domain", "lang", F.col("granted").alias("budget"))
    low = leaves.join(middle, ["domain", "lang"]).withColumn("name", F.col("source")).withColumn("weight", of["source"])
    return _fill(low, ["domain", "lang"], "budget").select("domain", "lang", "source", "tokens", "docs", F.col("granted").alias("target"))


def mix(docs: DataFrame, per_mille: int = 500, epochs: int = 2, seed: int = 17, with_rows: bool = True, weights: Weights = WEIGHTS) -> DataFrame:
    """A row for each document and epoch that the mixture takes: docs' columns, domain, epoch, tokens (words of its text),
    taken (how many of them, from its start) and leaf_start (the tokens that its leaf gives before it).

    A leaf is a domain, a language and a source; nulls are names of their own (shown as ''). In each epoch a leaf's documents
    stand in the order of a seeded digest of epoch and doc_id; the epochs follow one another, and the leaf gives the
    prefix of its target's length, so that its last document is cut. Documents without words (null or empty texts) give
    nothing and are left out. Ties, as of rows that repeat a doc_id, go by tokens; equal rows are interchangeable. Columns of
    docs that have the names of added ones are replaced; texts of any length are counted whole; without ``with_rows``, only doc_id and the added columns come,
    and the texts are not shuffled. An empty table gives no rows.

    A leaf's order is dealt into ranges of about RANGE documents by the digest's value, summed range by range, so that a
    source with a third of all documents is no task of its own. The budgets are made from one row for each leaf.
    """
    added = {"domain", "epoch", "tokens", "taken", "leaf_start", "lang", "source"}
    clean = [c for c in docs.columns if c.lower() not in added]
    name = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    leaf_of = [name("lang"), name("source"), weights.domain_of(F.col("source")).alias("domain"), F.xxhash64("text").alias("_mix_text")]
    wordy = F.length(F.btrim("text", F.lit(SPACE))) > 0
    # Rows without doc_id are told apart by their texts, so that they are no one group, however many they are.
    apart = F.when(F.col("doc_id").isNull(), F.col("_mix_text")).alias("_mix_apart")
    # Words are counted once; after that only a few numbers for each document are read.
    count = F.regexp_count("text", F.lit(WORD)).cast("long").alias("tokens")
    known = cut(docs.where(wordy).select("doc_id", *leaf_of, count).select("*", apart))
    same = Window.partitionBy("doc_id", "_mix_apart").orderBy(*LEVELS, "_mix_text")
    numbered = known.withColumn("_mix_n", F.row_number().over(same)) if with_rows else known.withColumn("_mix_n", F.lit(1))
    leaves = known.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    goals = budgets(leaves, per_mille, epochs, weights).select(*LEVELS, F.col("tokens").alias("leaf_tokens"), F.greatest(F.lit(1).cast("long"), F.expr(f"docs div {RANGE}")).alias("ranges"), "target")
    # A key of its own beside the leaf's names: dealt by the names alone, the ranges below would stay where their leaf is.
    digest_of_leaf = F.xxhash64(*LEVELS)
    lives = numbered.select(*LEVELS, "doc_id", "_mix_apart", "tokens", "_mix_n", digest_of_leaf.alias("_mix_leaf"))
    lives = lives.join(goals.withColumn("_mix_leaf", digest_of_leaf), ["_mix_leaf", *LEVELS]).drop("_mix_leaf").where("target > 0")
    turns = lives.withColumn("epoch", F.explode(F.expr(f"sequence(0, cast(least({epochs - 1}, (target - 1) div leaf_tokens) as int))")))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    turns = turns.withColumn("order", digest).withColumn("range", F.expr("(cast(conv(substring(`order`, 1, 8), 16, 10) as bigint) * ranges) div 4294967296"))
    leaf = [*LEVELS, "epoch"]
    sums = turns.groupBy(*leaf, "range").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each range: as many as there are documents by RANGE.
    starts = sums.withColumn("before", before).select(*leaf, "range", "before")
    inside = Window.partitionBy(*leaf, "range").orderBy("order", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(starts, [*leaf, "range"])
    placed = placed.withColumn("leaf_start", F.col("epoch") * F.col("leaf_tokens") + F.col("before") + F.col("within")).where("leaf_start < target")
    taken = placed.withColumn("taken", F.least("tokens", F.col("target") - F.col("leaf_start"))).select(*LEVELS, "doc_id", "_mix_apart", "tokens", "epoch", "taken", "leaf_start", "_mix_n")
    if not with_rows:
        return taken.drop("_mix_n", "_mix_apart")
    # One shuffle of the texts, by doc_id alone; rows that repeat it are told apart by their number.
    rows = docs.where(wordy).select(*named(clean), *leaf_of).select("*", apart).withColumn("_mix_m", F.row_number().over(same))
    picks = taken.select(F.col("doc_id").alias("_mix_id"), F.col("_mix_apart").alias("_mix_other"), "_mix_n", "tokens", "epoch", "taken", "leaf_start")
    met = F.col("doc_id").eqNullSafe(F.col("_mix_id")) & F.col("_mix_apart").eqNullSafe(F.col("_mix_other")) & (F.col("_mix_m") - F.col("_mix_n") == 0)
    return rows.join(picks, met).drop("_mix_n", "_mix_m", "_mix_id", "_mix_text", "_mix_apart", "_mix_other")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens in target weights, two epochs at most: which documents, in which epoch, and how much of each."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), with_rows=False).select("doc_id", "domain", "lang", "source", "epoch", "tokens", "taken", "leaf_start")


def _cases(column: str, weights: Mapping[str, int]) -> str:
    return f"cast(case {column} " + " ".join(f"when '{k}' then {w}" for k, w in weights.items()) + f" else {WEIGHTS.other} end as bigint)" if weights else f"cast({WEIGHTS.other} as bigint)"


def _filled(name: str, source: str, columns: str, parent: str, label: str, weights: Mapping[str, int]) -> str:
    """The common table expressions that grant budgets to the nodes of one level."""
    return f"""
{name}_a as (select *, {_cases(label, weights)} as weight from {source}),
{name}_b as (select *, budget - coalesce(sum(capacity) over (partition by {parent} order by capacity / weight, {label} rows between unbounded preceding and 1 preceding), 0) as spare,
   sum(weight) over (partition by {parent} order by capacity / weight, {label} rows between current row and unbounded following) as after_weight,
   row_number() over (partition by {parent} order by capacity / weight, {label}) as place from {name}_a),
{name}_c as (select *, min(case when not capacity * after_weight <= spare * weight then place end) over (partition by {parent}) as first_open from {name}_b),
{name}_d as (select *, max(case when place = first_open then spare end) over (partition by {parent}) as level_spare,
   max(case when place = first_open then after_weight end) over (partition by {parent}) as level_weight from {name}_c),
{name} as (select {columns}, cast(case when coalesce(place < first_open, true) then capacity else (level_spare * weight) // level_weight end as bigint) as granted from {name}_d)"""


SQL = rf"""
with known as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    'd' || coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) as bigint) % 4, 0) as domain,
    cast(len(regexp_extract_all(text, '{WORD}')) as bigint) as tokens
  from documents where text is not null
), leaves as (
  select domain, lang, source, cast(sum(tokens) as bigint) as tokens, cast(sum(tokens) * 2 as bigint) as capacity from known where tokens > 0 group by all
), lang_caps as (select domain, lang, cast(sum(capacity) as bigint) as capacity from leaves group by all),
domain_caps as (select domain, 0 as root, cast(sum(capacity) as bigint) as capacity, cast((sum(sum(capacity)) over () * 500) // 2000 as bigint) as budget from lang_caps group by domain),
{_filled("top", "domain_caps", "domain", "root", "domain", WEIGHTS.domain)},
lang_in as (select c.*, t.granted as budget from lang_caps c join top t using (domain)),
{_filled("middle", "lang_in", "domain, lang", "domain", "lang", WEIGHTS.lang)},
leaf_in as (select l.*, m.granted as budget from leaves l join middle m using (domain, lang)),
{_filled("low", "leaf_in", "domain, lang, source, tokens as leaf_tokens", "domain, lang", "source", WEIGHTS.source)},
turns as (
  select k.*, l.leaf_tokens, l.granted as target, e.epoch, md5('17:' || e.epoch || ':' || k.doc_id) as seeded
  from known k join low l using (domain, lang, source) cross join (values (0), (1)) e(epoch)
  where k.tokens > 0 and l.granted > 0 and e.epoch <= (l.granted - 1) // l.leaf_tokens
), placed as (
  select *, cast(epoch * leaf_tokens + coalesce(sum(tokens) over (partition by domain, lang, source, epoch order by seeded, tokens
    rows between unbounded preceding and 1 preceding), 0) as bigint) as leaf_start from turns
)
select doc_id, domain, lang, source, cast(epoch as integer) as epoch, tokens, least(tokens, target - leaf_start) as taken, leaf_start
from placed where leaf_start < target
"""
