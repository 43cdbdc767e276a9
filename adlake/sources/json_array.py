"""Huge JSON array files as many tasks.

A file is read in pieces that end at a closing brace, so any byte range of it can start a task. Whether a piece starts
inside a string, and how deep, follows from all pieces before it: each byte range is summarised for both cases, the few
summaries are chained, and the pieces of a record are put together by its number in the file. Records of one piece, which
flat ads are unless a brace stands in a text, are parsed where they are and not shuffled again.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from adlake import schema

CORRUPT = "_corrupt_record"
_RANGE = ["file", "block"]


def _earlier(*by: str):
    return Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(value: Column, *by: str) -> Column:
    return F.coalesce(F.sum(value).over(_earlier(*by)), F.lit(0)).cast("long")


def _opened(bare: Column, inside: bool) -> Column:
    """Opening braces outside of strings, for a piece that starts inside of one or not."""
    whole = F.concat(F.lit('"'), bare) if inside else bare
    outside = F.regexp_replace(whole, r'"[^"]*("|\z)', "")
    return F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit("")))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces in file order with, for a start outside (0) or inside (1) of a string, the change of depth."""
    text = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("at"))
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    quoted = (F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))) % 2
    # The closing brace counts where the piece ends outside of a string.
    closes = [F.when(quoted == 0, 1).otherwise(0), F.when(quoted == 1, 1).otherwise(0)]
    return text.select(
        *_RANGE, "at", "value", "file_size", quoted.alias("quoted"), F.sum(quoted).over(_earlier(*_RANGE, "at")).alias("_q"),
        *[(_opened(bare, bool(s)) - closes[s]).alias(f"delta{s}") for s in (0, 1)],
        *[closes[s].alias(f"closes{s}") for s in (0, 1)]).withColumn("within", F.coalesce(F.col("_q") % 2, F.lit(0))).drop("_q")


def _deep(pieces: DataFrame) -> DataFrame:
    """Pieces with the depth before and after them, and whether they close a brace outside of strings."""
    def under(start: int, name: str) -> Column:  # the piece's value, if its range starts outside (0) or inside (1)
        return F.when(F.col("within") == 0, F.col(f"{name}{start}")).otherwise(F.col(f"{name}{1 - start}"))

    ranges = pieces.groupBy(*_RANGE).agg(
        F.sum("quoted").alias("quotes"), *[F.sum(under(s, "delta")).alias(f"sum{s}") for s in (0, 1)])
    ranges = ranges.withColumn("start", _sum_before(F.col("quotes"), "file", "block") % 2)
    ranges = ranges.withColumn("depth", _sum_before(F.when(F.col("start") == 0, F.col("sum0")).otherwise(F.col("sum1")), "file", "block"))
    joined = pieces.join(ranges.select(*_RANGE, "start", "depth"), _RANGE)
    change = F.when(F.col("start") == 0, under(0, "delta")).otherwise(under(1, "delta"))
    closed = F.when(F.col("start") == 0, under(0, "closes")).otherwise(under(1, "closes"))
    before = F.col("depth") + _sum_before(F.col("change"), *_RANGE, "at")
    return joined.withColumns({"change": change, "closed": closed}).withColumn("before", before).withColumn("after", F.col("before") + F.col("change"))


def read_array(spark: SparkSession, path: str, fields: StructType = schema.RAW) -> DataFrame:
    """The objects of JSON array files, in as many tasks as the files have byte ranges.

    Adds ``seq``, (file, place of the object in it), and ``_corrupt_record`` with the text of an object that is broken
    or cut off at the end of its file; such rows have null fields. Braces, quotes and escapes in texts are text.
    """
    deep = _deep(_pieces(spark, path))
    ends = ((F.col("after") == 0) & (F.col("closed") == 1)).cast("int")
    done = deep.groupBy(*_RANGE).agg(F.sum(ends).alias("_ends"))
    done = done.select(*_RANGE, _sum_before(F.col("_ends"), "file", "block").alias("_done"))
    numbered = deep.join(done, _RANGE).withColumn("place", F.col("_done") + _sum_before(ends, *_RANGE, "at"))
    # Only the last piece of a file may lack its closing brace: then the pieces are one byte longer than the file.
    files = deep.groupBy("file").agg(F.sum(F.octet_length("value") + 1).alias("_bytes"), F.max("file_size").alias("_size"), F.max(F.struct("block", "at")).alias("_last"))
    marked = numbered.join(files, "file").withColumn("cut", (F.col("_bytes") > F.col("_size")) & (F.struct("block", "at") == F.col("_last")))
    begins = F.col("before") == 0
    text = F.when(begins, F.regexp_replace("value", r"\A[^{]*", "")).otherwise(F.col("value"))
    parts = marked.withColumn("text", text).where(~begins | (F.col("text") != ""))
    alone = begins & (F.col("after") == 0) & ~F.col("cut")
    single = parts.where(alone).select("file", "place", F.concat("text", F.lit("}")).alias("json"), F.lit(False).alias("cut"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "at", F.concat("text", F.when(F.col("cut"), "").otherwise("}")).alias("text"))))
    several = parts.where(~alone).groupBy("file", "place").agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("json"), F.max("cut").alias("cut"))
    kinds = StructType([*fields, StructField(CORRUPT, StringType())])
    parsed = F.from_json("json", kinds, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = single.unionByName(several).select(F.struct("file", "place").alias("seq"), "json", "cut", parsed.alias("ad"))
    whole = [F.when(~F.col("cut"), F.col(f"ad.`{f.name}`")).alias(f.name) for f in fields]
    return rows.select(*whole, F.when(F.col("cut"), F.col("json")).otherwise(F.col(f"ad.{CORRUPT}")).alias(CORRUPT), "seq")
