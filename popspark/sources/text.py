"""Line sources: each read is a DataFrame with the line's number in its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from popspark.operators.ordered import numbered


def chunked_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(chunk, line_no, value) of one file, or one folder of part files in order of name, for each chunk, in the order of paths.

    Line numbers rise along a file but have gaps: a line's is the offset of the piece of the file that it is read in, plus
    its place among the lines of that task, which has fewer lines than bytes; so no file goes through one task.
    """
    parts = []
    for chunk, path in enumerate(paths):
        lines = spark.read.text(path)
        names = sorted(f.rsplit("/", 1)[-1] for f in lines.inputFiles())
        row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        lines = lines.select("value", F.col("_metadata.file_name").alias("name"), (F.col("_metadata.file_block_start") + row).alias("at"))
        if len(names) > 1:
            # A row for each file.
            order = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, file long")
            lines = lines.join(F.broadcast(order), "name").withColumn("at", F.shiftleft("file", 44) + F.col("at"))
        parts.append(lines.select(F.lit(chunk).alias("chunk"), F.col("at").alias("line_no"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def letter_pieces(spark: SparkSession, paths: list[str], mark: str = "A") -> DataFrame:
    """(chunk, line, col, piece) of files whose lines are sequences: a line's letters in pieces, each with the number of its
    line in the chunk (from 0 on, all lines counted) and the column that it begins at.

    A line may be as long as a contig, so files are not cut at line ends, but behind every ``mark``, one of the sequences'
    letters: a record is what lies between two of them. Where each record stands comes from the lengths of those before it, summed over a
    split of the file and over splits; so neither a row nor a task holds a line.
    """
    parts = []
    for chunk, path in enumerate(paths):
        raw = spark.read.option("lineSep", mark).text(path)
        names = sorted(f.rsplit("/", 1)[-1] for f in raw.inputFiles())
        # A row for each file.
        order = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, file long")
        row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row")
        raw = raw.select("value", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("bytes"), row)
        parts.append(raw.join(F.broadcast(order), "name").drop("name").withColumn("chunk", F.lit(chunk)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    split = ["chunk", "file", "start"]
    inside = Window.partitionBy(*split).orderBy("row")
    sums = out.groupBy(*split).agg(F.sum(F.octet_length("value") + 1).alias("n"), F.any_value("bytes").alias("bytes"))
    # One row for each split of the files.
    file = Window.partitionBy("chunk", "file").orderBy("start")
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("open", F.sum("n").over(file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > F.col("bytes")).withColumn("last", F.lead("n").over(file).isNull())
    ahead = Window.partitionBy("chunk").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = sums.groupBy("chunk", "file").agg(F.any_value("bytes").alias("size")).select("chunk", "file", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("ahead"))
    sums = sums.join(files, ["chunk", "file"]).select(*split, (F.col("ahead") + F.col("before")).alias("at"), (F.col("open") & F.col("last")).alias("open"))
    rows = out.select(*split, "row", "value").withColumn("inside", F.coalesce(F.sum(F.octet_length("value") + 1).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("ends", F.lead("row").over(inside).isNull()).join(sums, split)
    # A file that does not end with a mark has none behind its last record.
    rows = rows.select(*split, "row", (F.col("at") + F.col("inside")).alias("at"), F.when(F.col("open") & F.col("ends"), F.col("value")).otherwise(F.concat("value", F.lit(mark))).alias("whole"))
    rows = rows.withColumn("breaks", F.length("whole") - F.length(F.translate("whole", "\n", "")))
    newline = F.col("at") + F.length("whole") - F.locate("\n", F.reverse("whole")) + 1
    rows = rows.withColumn("begun", F.when(F.col("breaks") > 0, newline))
    back = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("line", F.coalesce(F.sum("breaks").over(back), F.lit(0))).withColumn("begin", F.max("begun").over(back))
    whole = rows.groupBy(*split).agg(F.sum("breaks").alias("n"), F.max("begun").alias("begun"))
    earlier = Window.partitionBy("chunk").orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*split, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lines"), F.max("begun").over(earlier).alias("begun_before"))
    rows = rows.drop("begun").join(whole, split).withColumn("begin", F.coalesce("begin", "begun_before", F.lit(0).cast("long")))
    pieces = rows.select("chunk", F.col("line") + F.col("lines"), (F.col("at") - F.col("begin")).alias("first"), F.posexplode(F.split("whole", "\n", -1)).alias("i", "piece")).toDF("chunk", "line", "first", "i", "piece")
    placed = pieces.select("chunk", (F.col("line") + F.col("i")).alias("line"), F.when(F.col("i") == 0, F.col("first")).otherwise(0).cast("long").alias("col"), F.rtrim("piece").alias("piece"))
    return placed.where("piece <> ''")


def sequence_pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(chunk, row, col, piece): the pieces of lines that are no comments, which number from 0 on in each chunk."""
    pieces = letter_pieces(spark, paths)
    begun = pieces.where("col = 0").select("chunk", "line", F.col("piece").startswith("#") | F.col("piece").startswith(">"))
    begun = begun.toDF("chunk", "line", "comment").where("not comment")
    # One row for each line.
    names = begun.withColumn("row", F.row_number().over(Window.partitionBy("chunk").orderBy("line")) - 1)
    return pieces.join(names.drop("comment"), ["chunk", "line"]).select("chunk", "row", "col", "piece")


def write_lines(lines: DataFrame, path: str, *order: str, mark: str = "\n") -> None:
    """lines (value) as text, in part files whose names follow the order; behind each comes ``mark``."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(n, *order).sortWithinPartitions(*order).select("value").write.option("lineSep", mark).text(path)


def is_comment(value: Column) -> Column:
    return value.startswith("#") | value.startswith(">") | (F.trim(value) == "")


def read_mask(spark: SparkSession, paths: list[str]) -> DataFrame:
    """BED files as (chunk, line_no, start, end), half-open; a line without exactly three columns is an error."""
    lines = chunked_lines(spark, paths).where(~is_comment(F.col("value")))
    cells = F.split(F.trim("value"), r"\s+")
    checked = F.when(F.size(cells) == 3, cells).otherwise(F.raise_error(F.lit("a region has three columns")).cast("array<string>"))
    rows = lines.select("chunk", "line_no", checked.alias("c"))
    return rows.select("chunk", "line_no", F.col("c")[1].cast("long").alias("start"), F.col("c")[2].cast("long").alias("end"))


def read_reference(spark: SparkSession, paths: list[str], block: int = 10_000) -> DataFrame:
    """FASTA files as (chunk, block, start, bases): upper-cased, in blocks of ``block`` bases.

    A line's place is the length of all lines before it. It is summed in two steps, over runs of lines and within them, so
    that a long contig is neither one row nor one task; lines that cross a block's edge are cut there and blocks joined.
    """
    lines = chunked_lines(spark, paths).where(~is_comment(F.col("value"))).select("chunk", "line_no", F.upper(F.trim("value")).alias("value"))
    lines = lines.withColumn("run", F.expr("line_no div 1000000")).withColumn("n", F.length("value").cast("long"))
    sums = lines.groupBy("chunk", "run").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("chunk").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("chunk", "run", "before")
    within = Window.partitionBy("chunk", "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(before, ["chunk", "run"]).withColumn("start", F.col("before") + F.col("within"))
    pieces = placed.select("chunk", "start", "value", "n", F.explode(F.expr(f"sequence(start div {block}, (start + n - 1) div {block})")).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("n"), (F.col("block") + 1) * block)
    piece = F.substring("value", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    cut = pieces.select("chunk", "block", low.alias("start"), piece.alias("piece"))
    joined = cut.groupBy("chunk", "block").agg(F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("p"))
    return joined.select("chunk", "block", F.col("p")[0]["start"].alias("start"), F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("bases"))


def read_numbers(spark: SparkSession, path: str, name: str, kind: str = "double") -> DataFrame:
    """White-space separated numbers, a row for each line: (line_no, name)."""
    lines = chunked_lines(spark, [path]).where(~is_comment(F.col("value")))
    return lines.select("line_no", F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast(kind)).alias(name))


def read_start_points(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """Start points (particle_id, point); a row of another width is an error, as is a file of fewer than two rows."""
    rows = read_numbers(spark, path, "point")
    if rows.count() < 2:
        raise ValueError("a start file has two points at least")
    checked = F.when(F.size("point") == dimension, F.col("point")).otherwise(F.raise_error(F.lit("a start point has another dimension")).cast("array<double>"))
    return numbered(rows.select("line_no", checked.alias("point")), [], "line_no", [], "particle_id").select("particle_id", "point")


def read_rates(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Maps of rates, a file for each contig, as (chunk, start, end, rate): half-open ranges of loci, counted from 0. A line of
    another width is an error, and so are ranges that are empty or overlap."""
    lines = chunked_lines(spark, paths).where(~is_comment(F.col("value")))
    cells = F.split(F.trim("value"), r"\s+")
    c = F.when(F.size(cells) == 3, cells).otherwise(F.raise_error(F.lit("a range of a rate has three columns")).cast("array<string>"))
    rows = lines.select("chunk", c.alias("c")).select("chunk", F.col("c")[0].cast("long").alias("start"), F.col("c")[1].cast("long").alias("end"), F.col("c")[2].cast("double").alias("rate"))
    before = F.lag("end").over(Window.partitionBy("chunk").orderBy("start"))
    fine = (F.col("start") < F.col("end")) & F.coalesce(before <= F.col("start"), F.lit(True))
    return rows.withColumn("_fine", fine).select("chunk", "start", "end", F.when(F.col("_fine"), F.col("rate")).otherwise(F.raise_error(F.lit("ranges of rates are empty or overlap")).cast("double")).alias("rate"))


def read_points(spark: SparkSession, path: str) -> list[float]:
    """Interval boundaries: one line of numbers with commas."""
    lines = [r["value"] for r in chunked_lines(spark, [path]).where(~is_comment(F.col("value"))).limit(2).collect()]
    if len(lines) != 1:
        raise ValueError("a file of interval points has one line")
    return [float(x) for x in lines[0].split(",")]


def write_results(particles: DataFrame, path: str) -> None:
    """Tab-separated results: likelihood, milliseconds, coordinates and [generation_step_particle]."""
    label = F.format_string("[%d_%d_%d]", "generation", "em_step", "particle_id")
    cells = F.concat(F.array(F.col("loglik").cast("string"), F.col("ms").cast("string")), F.transform("point", lambda x: x.cast("string")), F.array(label))
    particles.select(F.array_join(cells, "\t").alias("value")).write.text(path)
