"""Which conditional sampling distributions a composite likelihood is made of: (kind, perm, csd, add, trunk, factor)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from popspark.operators.ordered import numbered, sum_before

COLUMNS = ("kind", "perm", "csd", "add", "trunk", "factor")
#: CSDs of a piece that is dealt out as a whole, at most; haplotypes in a piece's trunks and in those of a task, about.
PIECE, HELD, TASK = 256, 2_000_000, 4_000_000
#: Haplotypes of a block of which all meet all of another.
BLOCK = 256


def _piece(n: Column) -> Column:
    """How many CSDs a piece has where trunks have up to n haplotypes: a task holds all rows of one piece at a time."""
    return F.greatest(F.least(F.lit(PIECE), (F.lit(HELD) / n).cast("int")), F.lit(1))


def _tasks(df: DataFrame, haps: Column) -> int:
    """How many tasks trunks need that hold so many haplotypes for each row of df."""
    return max(1, -(-(df.agg(F.sum(haps)).first()[0] or 0) // TASK))


def members(layout: DataFrame) -> DataFrame:
    """layout (hap, multiplicity, by deme) as the sample's members (hap, haplotype, deme): hap is a member's number, and a
    haplotype is there as often as its multiplicities say, in each of its demes; copies are members of their own."""
    demes = F.posexplode("multiplicity").alias("deme", "m")
    each = layout.select(F.col("hap").alias("haplotype"), demes).where("m > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m"))))
    return numbered(each, [], "haplotype", ["deme", "copy"], "hap").select("hap", "haplotype", "deme")


def leave_one_out(haps: DataFrame, factor: Column | None = None) -> DataFrame:
    """haps (hap): each member of the sample against all others; of copies of a haplotype, each one is left out in turn."""
    everyone = haps.agg(F.sort_array(F.collect_list("hap")).alias("all"))
    out = haps.crossJoin(F.broadcast(everyone)).select(F.col("hap").alias("add"), F.filter("all", lambda x: x != F.col("hap")).alias("trunk"), F.size("all").alias("n"))
    return out.select(F.lit("lol").alias("kind"), F.lit(0).alias("perm"), F.col("add").alias("csd"), "add", "trunk", (factor if factor is not None else F.lit(1.0)).alias("factor"))


def pairwise(haps: DataFrame, factor: Column | None = None) -> DataFrame:
    """Each ordered pair of different members."""
    everyone = haps.agg(F.sort_array(F.collect_list("hap")).alias("all"))
    out = haps.crossJoin(F.broadcast(everyone)).select(F.col("hap").alias("add"), F.explode(F.filter("all", lambda x: x != F.col("hap"))).alias("other"), F.size("all").alias("n"))
    number = F.col("add") * F.col("n") + F.col("other")
    return out.select(F.lit("pcl").alias("kind"), F.lit(0).alias("perm"), number.cast("int").alias("csd"), "add", F.array("other").alias("trunk"), (factor if factor is not None else F.lit(1.0)).alias("factor"))


def left_out_by_group(haps: DataFrame, group: str) -> DataFrame:
    """haps (group, hap, multiplicity): for each group, each haplotype against the others and the rest of its own copies:
    (group, add, csds, trunk, trunk_size). csds is how many equal ones there are, one for each copy; trunk is a text, the
    haplotypes with what is left of their multiplicities. Rows that repeat a haplotype and its multiplicity count one by one,
    on both sides.

    A group's text is written once; a trunk is what comes before its haplotype in it, the rest of that, and what comes after.
    """
    entry = lambda m: F.concat(F.lit(" "), F.col("hap").cast("string"), F.lit(":"), m.cast("string"))
    there = haps.where(F.col(group).isNotNull() & F.col("hap").isNotNull() & (F.col("multiplicity") > 0))
    each = there.groupBy(group, "hap").agg(F.sort_array(F.collect_list("multiplicity")).alias("ms"))
    text = F.array_join(F.transform("ms", entry), "").cast("binary").alias("text")
    rest = F.array_join(F.transform(F.filter("ms", lambda m: m > 1), lambda m: entry(m - 1)), "").cast("binary").alias("rest")
    each = each.select(group, "hap", "ms", text, rest, F.aggregate("ms", F.lit(0).cast("long"), lambda n, m: n + m).alias("n"))
    before = Window.partitionBy(group).orderBy("hap").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("start", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)).cast("int"))
    member = F.struct("hap", "ms", "rest", "start", (F.col("start") + F.octet_length("text")).alias("end"))
    whole = each.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("hap", "text"))).alias("texts"), F.sort_array(F.collect_list(member)).alias("members"), F.sum("n").alias("n"))
    whole = whole.select(group, F.array_join(F.col("texts.text").cast("array<string>"), "").cast("binary").alias("text"), "members", "n", _piece(F.size("members")).alias("_rows"))
    pieces = whole.withColumn("_start", F.explode(F.expr("sequence(0, size(members) - 1, _rows)")))
    pieces = pieces.select(group, "_start", "text", F.slice("members", F.col("_start") + 1, F.col("_rows")).alias("members"), "n")
    sizes = there.groupBy(group).agg(F.count("*").alias("n"))
    dealt = pieces.repartition(_tasks(sizes, F.col("n") * F.col("n")), group, "_start")
    rows = dealt.select(group, "text", "n", F.explode("members").alias("x")).select(group, "text", "n", "x", F.explode(F.array_distinct("x.ms")).alias("csds"))
    equal = F.size(F.filter("x.ms", lambda m: m == F.col("csds")))
    rows = rows.select(group, F.col("x.hap").alias("add"), "csds", "text", "x", equal.alias("equal"), (equal * (F.col("n") - F.size("x.ms"))).alias("trunk_size")).where("trunk_size > 0")
    trunk = F.expr("cast(substring(concat(substring(text, 1, x.start), x.rest, substring(text, x.end + 1)), 2) as string)")
    again = F.when(F.col("equal") == 1, trunk).otherwise(F.regexp_replace(trunk, F.lit("[^ ]+"), F.concat(F.lit("$0"), F.repeat(F.lit(" $0"), F.col("equal") - 1))))
    return rows.select(group, "add", "csds", again.alias("trunk"), "trunk_size")


def pairwise_and_leave_one_out(haps: DataFrame) -> DataFrame:
    """Both, each kind with a total weight of one."""
    n = F.col("n")
    return pairwise(haps, 1.0 / (n * (n - 1))).unionByName(leave_one_out(haps, 1.0 / n))


def pairs_by_group(haps: DataFrame, group: str, factor: Column | None = None, shown: Column | None = None) -> DataFrame:
    """haps (group, hap, a number): each ordered pair of different haplotypes of one group: (group, add, trunk, factor). ``shown``,
    a column of haps that tells haplotypes apart, stands for them in the trunks.

    Blocks of haplotypes meet one by one, so all cores share the pairs of a group, and a row holds two blocks.
    """
    haps = haps.where(F.col(group).isNotNull() & F.col("hap").isNotNull()).select(group, "hap", (shown if shown is not None else F.col("hap")).alias("shown"))
    sizes = haps.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_n"))
    placed = numbered(haps, [group], "hap", [], "_place").withColumn("_block", F.expr(f"_place div {BLOCK}"))
    block = placed.groupBy(group, "_block").agg(F.sort_array(F.collect_list(F.struct("hap", "shown"))).alias("_haps"))
    block = block.join(sizes, F.col(group) == F.col("_group")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.expr(f"cast((_n - 1) div {BLOCK} as int)"))))
    tasks = _tasks(sizes, F.col("_n") * F.col("_n"))
    adds = block.select(group, F.col("_block").alias("_i"), F.col("_other").cast("long").alias("_j"), F.col("_haps").alias("_adds")).repartition(tasks, group, "_i", "_j")
    others = block.select(group, F.col("_other").cast("long").alias("_i"), F.col("_block").alias("_j"), F.col("_haps.shown").alias("_others")).repartition(tasks, group, "_i", "_j")
    met = adds.join(others.hint("merge"), [group, "_i", "_j"]).select(group, F.explode("_adds").alias("_add"), "_others").select(group, "_add", F.explode("_others").alias("other"))
    return met.where(F.col("_add.shown") != F.col("other")).select(group, F.col("_add.hap").alias("add"), F.array("other").alias("trunk"), (factor if factor is not None else F.lit(1.0)).alias("factor"))


def _turned(perms: DataFrame, sizes: list[int] | None, wanted: int | None) -> DataFrame:
    """perms with ord from the last to the first, and the ranks, by which the CSDs that are kept are known."""
    n = F.size("ord")
    ranks = F.sequence(F.lit(0), n - 1)
    if sizes is not None:
        ranks = F.filter(ranks, lambda r: r.isin(sizes))
    if wanted == 1:
        ranks = F.filter(ranks, lambda r: r == n - 1)
    elif wanted == 2:
        ranks = F.filter(ranks, lambda r: (r == n - 1) | (r == 1) | (n <= 2))
    elif wanted is not None:
        step = (n - 2).cast("float") / F.lit(wanted - 1).cast("float")
        even = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: (F.lit(1).cast("float") + i.cast("float") * step.cast("float")).cast("int"))
        ranks = F.filter(ranks, lambda r: (n <= wanted) | F.array_contains(even, r))
    return perms.select("perm", F.reverse("ord").alias("ord"), ranks.alias("ranks"))


def _grown(placed: DataFrame, perm: Column, number: Column) -> DataFrame:
    """placed (ord, rank) as CSDs: the haplotype of that rank against all before it."""
    trunk = F.slice("ord", 1, F.col("rank"))
    return placed.select(F.lit("pac").alias("kind"), perm.alias("perm"), number.alias("csd"), F.col("ord")[F.col("rank")].alias("add"), trunk.alias("trunk"), F.lit(1.0).alias("factor"))


def permuted(perms: DataFrame, sizes: list[int] | None = None, wanted: int | None = None) -> DataFrame:
    """perms (perm, ord, an array of haplotypes): read from the last to the first, each against those already placed.

    ``sizes`` keeps the CSDs with these trunk sizes only; ``wanted`` keeps so many sizes of each permutation, spread evenly:
    the largest; it and 1; or from 1 to the largest.
    """
    placed = _turned(perms, sizes, wanted).select("perm", "ord", F.explode("ranks").alias("rank"))
    return _grown(placed, F.col("perm"), F.col("rank"))


def shuffled(haps: DataFrame, n: int, seed: int) -> DataFrame:
    """n seeded permutations (perm, ord) of haps (hap): each in the order of a digest of the seed, its number and the hap."""
    each = haps.select("hap", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("perm"))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("perm").cast("string"), F.col("hap").cast("string")).cast("binary"))
    return each.groupBy("perm").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "hap"))).alias("o")).select("perm", F.col("o.hap").alias("ord"))


def shuffled_rows(haps: DataFrame, n: int, seed: int) -> DataFrame:
    """The permutations of ``shuffled`` as rows (perm, place, hap), for more haps than one row should hold."""
    each = haps.select("hap", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("perm"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("perm").cast("string"), F.col("hap").cast("string")).cast("binary"))
    each = each.withColumn("_digest", digest).withColumn("_share", F.conv(F.substring("_digest", 1, 12), 16, 10).cast("long"))
    return numbered(each, ["perm"], "_share", ["_digest", "hap"], "place").select("perm", "place", "hap")


def permutations(lines: DataFrame, n: int) -> DataFrame:
    """lines (line_no, value) of numbers as permutations (perm, ord) of 0 to n - 1; any other line is an error."""
    numbers = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("int"))
    fine = F.array_sort(numbers) == F.sequence(F.lit(0), F.lit(n - 1))
    checked = F.when(F.coalesce(fine, F.lit(False)), numbers).otherwise(F.raise_error(F.lit("a line is no permutation of the sample")).cast("array<int>"))
    return numbered(lines.select("line_no", checked.alias("ord")), [], "line_no", [], "perm").select("perm", "ord")


def one_list(perms: DataFrame, sizes: list[int] | None = None, wanted: int | None = None) -> DataFrame:
    """The CSDs of ``permuted`` as one list over all permutations, whose likelihoods multiply.

    What is numbered, joined and dealt out are permutations and pieces of them; trunks grow in the tasks that give them out.
    """
    turned = _turned(perms, sizes, wanted).where(F.size("ranks") > 0)
    before = sum_before(turned.select("perm", F.size("ranks").alias("n")), [], "perm", [], "n", "_before")
    placed = turned.join(before.select(F.col("perm").alias("_perm"), "_before"), F.col("perm") == F.col("_perm"))
    n = F.size("ranks")
    placed = placed.withColumn("_rows", _piece(F.size("ord")))
    pieces = placed.withColumn("_start", F.explode(F.expr("sequence(0, size(ranks) - 1, _rows)")))
    part = F.slice("ranks", F.col("_start") + 1, F.col("_rows"))
    pieces = pieces.select("perm", "_start", "_before", part.alias("ranks"), F.slice("ord", 1, F.element_at(part, -1) + 1).alias("ord"))
    dealt = pieces.repartition(_tasks(turned, n.cast("long") * F.size("ord")), "perm", "_start")
    each = dealt.select("ord", "_start", "_before", F.posexplode("ranks").alias("_place", "rank"))
    # From 1 on, as all numbers of this list.
    return _grown(each, F.lit(0), (F.col("_before") + F.col("_start") + F.col("_place") + 1).cast("int"))


def listed(lines: DataFrame) -> DataFrame:
    """lines (line_no, value): an additional haplotype and its trunk, by index; repeated or negative ones are an error."""
    numbers = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("int"))
    rows = lines.select("line_no", numbers.alias("n"))
    fine = (F.size(F.array_distinct("n")) == F.size("n")) & ~F.exists("n", lambda x: x.isNull() | (x < 0))
    checked = F.when(fine, F.col("n")).otherwise(F.raise_error(F.lit("a CSD line names a haplotype twice or not at all")).cast("array<int>"))
    named = numbered(rows.select("line_no", checked.alias("n")), [], "line_no", [], "csd")
    return named.select(F.lit("file").alias("kind"), F.lit(0).alias("perm"), "csd", "n").select("kind", "perm", "csd", F.col("n")[0].alias("add"), F.expr("slice(n, 2, size(n) - 1)").alias("trunk"), F.lit(1.0).alias("factor"))
