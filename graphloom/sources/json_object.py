"""Members of JSON objects of any size, in any layout, read in parallel.

A file is split by Spark at its blocks and cut at every ``}``, so a row, a segment, is at most one value long.  Whether a
segment begins inside a string, and how many braces are open, is carried over the byte ranges: sums within a block, and
an offset for each block from the sums of those before it.  A segment that begins and ends between two members is one by
itself; only members whose strings or inner objects hold a brace are put together from several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.sources.storage import stored

BLANK = r"^[\s\x{FEFF}]*$"


def _before(sums: DataFrame, column: str) -> DataFrame:
    """(file, block, column): the sum of ``column`` over the file's earlier blocks; one row a block comes in."""
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file", "block", F.coalesce(F.sum(column).over(w), F.lit(0)).alias(column))


def _carried(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all earlier segments of the file."""
    w = Window.partitionBy("file", "block").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("file", "block").agg(F.sum(value).alias("_sum"))
    out = rows.withColumn("_own", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return out.join(_before(sums, "_sum"), ["file", "block"]).withColumn(name, F.col("_own") + F.col("_sum")).drop("_own", "_sum")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, no, text, inside, quotes, opened, depth) of every segment in order of (block, no): its state at its start, and its braces. Stores the text once."""
    m = "_metadata"
    rows = spark.read.option("lineSep", "}").text(path).select(
        F.col(f"{m}.file_path").alias("file"), F.col(f"{m}.file_size").alias("size"), F.col(f"{m}.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"), F.col("value").alias("text")
    )
    # An escape never reaches over the end of a segment: a backslash may not stand before a brace.
    bare = F.regexp_replace("text", r"(?s)\\.", "")
    rows = rows.withColumn("quotes", F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit(""))))
    rows = _carried(rows, F.col("quotes"), "_quotes").withColumn("inside", F.col("_quotes") % 2 == 1).drop("_quotes")
    outside = F.when(F.col("inside"), F.regexp_replace(bare, r'(?s)^[^"]*("|$)', "")).otherwise(bare)
    outside = F.regexp_replace(outside, r'(?s)"[^"]*("|$)', "")
    rows = rows.withColumn("opened", F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit(""))))
    rows = rows.withColumn("closes", (F.col("inside") == (F.col("quotes") % 2 == 1)).cast("int"))
    rows = stored(rows, "json-segments")
    return _carried(rows, F.col("opened") - F.col("closes"), "depth")


def members(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(name, value) of all members of the top-level objects at ``path``, one or several a file, ``value`` being a type.

    Layout does not matter: one object over many lines, one a line, or anything between.  A name that is repeated gives
    as many rows.  Malformed text, an object that does not end, or text around objects stops the job that reads the rows.
    """
    rows = segments(spark, path)
    ends = rows.groupBy("file").agg(F.max(F.struct("block", "no")).alias("_last"), (F.sum(F.octet_length("text")) + F.count(F.lit(1)) - F.max("size")).alias("_over"))
    rows = rows.join(ends, "file").withColumn("_last", F.col("_last") == F.struct("block", "no"))
    blank = F.col("text").rlike(BLANK)
    # What is left behind the last brace is no segment.  Of a file that ends with a brace nothing is left; sizes of compressed files tell nothing.
    idle = F.col("_last") & blank & ~F.col("inside") & (F.col("depth") == 0) & (F.col("_over") != 0)
    broken = F.col("_last") & (((F.col("_over") == 1) & ~idle) | F.col("inside"))
    rows = rows.withColumn("after", F.col("depth") + F.col("opened") - F.col("closes")).withColumn("ends", (F.col("closes") == 1) & (F.col("after") <= 1))
    stop = lambda why: F.raise_error(F.concat(F.lit(f"{why} in "), F.col("file"), F.lit(": "), F.substring("text", 1, 200)))
    wrong = F.when(broken | (F.col("_last") & ~idle & (F.col("after") != 0)), stop("unfinished JSON object")).when(~idle & (F.col("after") < 0), stop("JSON brace without its object"))
    rows = rows.withColumn("_checked", F.coalesce(wrong.cast("int"), F.lit(0))).filter((F.col("_checked") == 0) & ~idle)
    rows = rows.withColumn("starts", ~F.col("inside") & (F.col("depth") <= 1))
    whole = rows.filter("starts and ends").select("file", "text", F.col("depth").alias("first"), F.col("after").alias("last"))
    parts = _carried(rows.select("file", "block", "no", "text", "depth", "after", "starts", "ends").withColumn("_e", F.col("ends").cast("int")), F.col("_e"), "member").filter("not (starts and ends)")
    parts = parts.groupBy("file", "member").agg(
        F.array_sort(F.collect_list(F.struct("block", "no", "text"))).alias("p"), F.min_by("depth", F.struct("block", "no")).alias("first"), F.max_by("after", F.struct("block", "no")).alias("last")
    )
    parts = parts.select("file", F.array_join(F.transform("p", lambda x: x["text"]), "}").alias("text"), "first", "last")
    both = whole.unionByName(parts).withColumn("text", F.when(F.col("last") == 1, F.concat("text", F.lit("}"))).otherwise(F.col("text")))
    lead = F.when(F.col("first") == 0, F.col("text").rlike(r"(?s)^[\s\x{FEFF}]*\{")).otherwise(F.col("text").rlike(r"(?s)^\s*(,\s*\S|$)"))
    body = F.regexp_replace("text", r"(?s)^[\s\x{FEFF}]*[{,]", "")
    body = F.when(lead, body).otherwise(stop("text between JSON members"))
    found = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), f"map<string, {value}>", {"mode": "FAILFAST"})
    return both.select(F.explode(found).alias("name", "value"))
