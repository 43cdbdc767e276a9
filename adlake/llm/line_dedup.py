"""Line dedup in the DataFrame API: keep bitmaps instead of text.

Lines become 128-bit hashes of their keys. Only hashes found in enough documents go on; they are range-partitioned with
their document and position as further sort keys, so that a line that fills a third of the corpus is spread over many
tasks and first occurrences come in order. The result per document is a run-length compressed keep bitmap, and
``apply_bitmap`` makes the kept text from it wherever the text is wanted.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from adlake.llm.tables import needs, row_key, written

LINE_ENDS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# One of so many slots takes a document's lines; a line's documents are streamed slot by slot.
SLOTS = 256


def lines_of(text: Column) -> Column:
    """A text's lines; null and empty text are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at both ends and with A-Z lower-cased."""
    bare = F.btrim(line, F.lit(LINE_ENDS))
    # In plain ASCII both are the same, and lower() is much faster.
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _hashes(min_chars: int) -> Column:
    """Per line a struct of two 64-bit hashes of its key, null where the key is too short."""
    keys = F.transform(lines_of(F.col("text")), line_key)
    return F.transform(keys, lambda key: F.when(
        F.char_length(key) >= max(min_chars, 1),
        F.struct(F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2"))))


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep_first: bool = True) -> DataFrame:
    """Which lines stay, per distinct (doc_id, text): doc_id, row_key, n_lines, n_dropped, n_first, keep_runs.

    A line goes if its key has ``min_chars`` code points or more and is found in ``min_docs`` documents or more; with
    ``keep_first`` its first occurrence, in order of doc_id and position, stays (later ones in that document go too).
    ``n_first`` counts a document's lines that are first occurrences of such keys. ``keep_runs`` is the bitmap:
    start and length of each run of kept lines.

    Rows that repeat doc_id and text are one document; equal ids with other texts are different documents; a null
    doc_id comes first in the order. Null and empty texts have one empty line, which always stays. No row, no result.
    Other columns are not read.
    """
    keyed = needs(docs, "doc_id", "text").select("doc_id", row_key("doc_id", "text").alias("row_key"),
                                                 _hashes(min_chars).alias("lines"))
    per_doc = written(keyed.distinct())
    once = per_doc.select(F.explode(F.filter(F.array_distinct("lines"), lambda x: x.isNotNull())).alias("x"))
    # As a table of its own: Spark can then split a skewed join with it.
    common = written(once.groupBy(F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2")).agg(F.count(F.lit(1)).alias("n"))
                     .where(F.col("n") >= min_docs).drop("n"))
    found = (per_doc.select("doc_id", "row_key", F.posexplode("lines").alias("pos", "x")).where(F.col("x").isNotNull())
             .select("doc_id", "row_key", "pos", F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2"))
             .join(common, ["h1", "h2"], "left_semi"))
    marked = _first_marked(found)
    gone = (marked.groupBy("row_key", F.col("doc_id").alias("_id"))
            .agg(F.sort_array(F.collect_list(F.when(~F.col("is_first") | F.lit(not keep_first), F.col("pos")))).alias("gone"),
                 F.count_if("is_first").alias("n_first")))
    sizes = per_doc.select("doc_id", F.col("row_key").alias("_key"), F.size("lines").alias("n_lines"))
    both = sizes.join(gone, (F.col("_key") == F.col("row_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    cuts = F.coalesce(F.col("gone"), F.array().cast("array<int>"))
    return both.select(
        "doc_id", F.col("_key").alias("row_key"), F.col("n_lines").cast("long").alias("n_lines"),
        F.size(cuts).cast("long").alias("n_dropped"), F.coalesce("n_first", F.lit(0)).cast("long").alias("n_first"),
        _kept_runs(cuts, F.col("n_lines")).alias("keep_runs"))


def _first_marked(found: DataFrame) -> DataFrame:
    """Each line with whether it is the first of its key: first per slot of documents, then the first of the slots."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.pmod(F.col("row_key"), F.lit(SLOTS)).cast("int")
    ranged = found.withColumn("slot", slot).repartitionByRange(n, "h1", "h2", "slot")
    order = Window.partitionBy("h1", "h2", "slot").orderBy(F.col("doc_id").asc_nulls_first(), "row_key", "pos")
    streamed = written(ranged.withColumn("nth", F.row_number().over(order)))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row_key", "pos"))
    # Only the first of a slot can be the first of all, so a line found everywhere brings SLOTS rows to the comparison.
    leading = streamed.where("nth = 1").drop("nth")
    firsts = leading.groupBy("h1", "h2").agg(first.alias("first"))
    is_first = (F.col("row_key") == F.col("first.row_key")) & (F.col("pos") == F.col("first.pos"))
    led = leading.join(firsts, ["h1", "h2"]).select("doc_id", "row_key", "pos", is_first.alias("is_first"))
    return led.union(streamed.where("nth > 1").select("doc_id", "row_key", "pos", F.lit(False)))


def _kept_runs(gone: Column, n_lines: Column) -> Column:
    """Runs of kept lines between sorted dropped positions, as structs of start and length."""
    starts = F.filter(gone, lambda p, i: (i == 0) | (F.get(gone, i - 1) != p - 1))
    ends = F.filter(gone, lambda p, i: (i == F.size(gone) - 1) | (F.get(gone, i + 1) != p + 1))
    begin = F.concat(F.array(F.lit(0)), F.transform(ends, lambda p: p + 1))
    runs = F.zip_with(begin, F.concat(starts, F.array(n_lines)),
                      lambda a, b: F.struct(a.alias("start"), (b - a).alias("length")))
    return F.filter(runs, lambda r: r.length > 0)


def apply_bitmap(text: Column, keep_runs: Column) -> Column:
    """The kept lines of a text, joined by line ends; a null text is empty."""
    lines = lines_of(text)
    parts = F.transform(keep_runs, lambda r: F.array_join(F.slice(lines, r.start + 1, r.length), "\n"))
    return F.array_join(parts, "\n")


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """Each row of ``docs`` as ``row`` (a struct of its columns) with kept_text, n_lines, n_dropped and n_first."""
    bitmaps = keep_bitmaps(docs, **options).withColumnRenamed("doc_id", "_id")
    rows = docs.select(row_key("doc_id", "text").alias("_key"), F.struct("*").alias("row"))
    joined = rows.join(bitmaps, (F.col("_key") == F.col("row_key")) & F.col("row.doc_id").eqNullSafe(F.col("_id")))
    kept = F.when(F.col("n_dropped") == 0, F.coalesce("row.text", F.lit(""))).otherwise(
        apply_bitmap(F.col("row.text"), F.col("keep_runs")))
    return joined.select("row", kept.alias("kept_text"), "n_lines", "n_dropped", "n_first")
