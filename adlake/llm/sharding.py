"""A seeded global shuffle into shards by a two-pass external shuffle.

Pass one scatters whole records by a seeded hash into buckets that fit in memory; pass two shuffles each bucket by
Fisher-Yates and numbers its records from where the bucket's share of the corpus begins. Numbers are dealt to shards in
turn, so shards' counts differ by one at most and every order is equally likely up to the seed.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from adlake.llm.tables import send_code, written

BUCKET_BYTES = 32 << 20
# Equal rows beyond this number are dealt to buckets by number of copy.
EQUAL_ROWS = 4096


def _shuffled(seed: int):
    def run(bucket: pa.Table) -> pa.Table:
        # A settled order first, so that the result depends on the seed and not on how records arrive.
        settled = np.argsort(bucket.column("key").to_numpy(), kind="stable")
        rng = np.random.Generator(np.random.PCG64([seed, bucket.column("bucket")[0].as_py()]))
        order = pa.array(settled[rng.permutation(len(settled))])  # numpy's permutation is Fisher-Yates
        begin = bucket.column("before")[0].as_py()
        return pa.table({"row": bucket.column("row").take(order), "place": pa.array(begin + np.arange(len(settled)), pa.int64())})
    return run


def prefix_sums(counts: DataFrame, key: str, value: str, chunk: int = 4096) -> DataFrame:
    """(key, before): the sum of ``value`` over smaller keys, in chunks of keys so that no task holds all of them."""
    def before(order, *within):
        return F.coalesce(F.sum(value).over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    chunked = counts.withColumn("chunk", F.floor(F.col(key) / chunk))
    totals = chunked.groupBy("chunk").agg(F.sum(value).alias(value)).withColumn("all", F.lit(0))
    totals = totals.select("chunk", before("chunk", "all").alias("ahead"))
    return chunked.select(key, "chunk", before(key, "chunk").alias("inner")).join(totals, "chunk").select(
        key, (F.col("inner") + F.col("ahead")).alias("before"))


def numbered_copies(keyed: DataFrame, seed: int, most: int) -> DataFrame:
    """(row, key) in which the copies of a row found more than ``most`` times have keys of their own.

    Such rows are counted, which combines them before the shuffle, and written out again ``most`` copies at a time, each
    with a key from its number. Copies are alike, so it does not matter which of them gets which number.
    """
    often = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key"))
    counted = keyed.join(often, "key", "left_semi").groupBy("row", "key").agg(F.count(F.lit(1)).alias("n"))
    parts = counted.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most))).alias("part")).repartition("key", "part")
    first = F.col("part") * most
    copies = parts.select("row", "key", F.explode(F.sequence(first, F.least(first + most, F.col("n")) - 1)).alias("copy"))
    return keyed.join(often, "key", "left_anti").select("row", "key").union(
        copies.select("row", F.xxhash64(F.lit(seed), "key", "copy").alias("key")))


def shuffle_into_shards(records: DataFrame, shards: int = 8, seed: int = 20, bucket_bytes: int = BUCKET_BYTES,
                        equal_rows: int = EQUAL_ROWS) -> DataFrame:
    """Each record as ``row`` (a struct of its columns) with place, shard and slot.

    ``place`` is the record's number in the global order, gapless from 0; shard = place mod shards, slot = place div
    shards, so slots are gapless in each shard too. Bytes of the columns ``text``, or else the number of rows, set the
    number of buckets; there are as many as shuffle partitions at least. Any column may be null. Wholly equal rows
    are each placed; up to ``equal_rows`` of them share a bucket, more are dealt to all buckets. A very long text makes its
    bucket larger by itself. An empty table has no places; with fewer rows than shards some shards are empty.
    """
    send_code(records.sparkSession)
    spark = records.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)) if "text" in records.columns else F.lit(0)
    key = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in records.columns])
    found = records.select(key.alias("key"), (size + F.lit(100)).alias("size")).groupBy("key").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).agg(F.sum("size"), F.max("n")).first()
    buckets = max(-(-(found[0] or 0) // bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = records.select(F.struct("*").alias("row"), key.alias("key"))
    keyed = numbered_copies(keyed, seed, equal_rows) if (found[1] or 0) > equal_rows else keyed
    keyed = keyed.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    scattered = keyed.join(prefix_sums(counts, "bucket", "n"), "bucket")
    schema = keyed.select("row").schema.add("place", "long")
    placed = scattered.groupBy("bucket").applyInArrow(_shuffled(seed), schema)
    return placed.withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": F.floor(F.col("place") / shards)})


def write_shards(placed: DataFrame, path: str) -> None:
    """The shards as folders ``shard=N`` of files in slot order, with the records' own columns and ``slot``."""
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (placed.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot")
     .select("row.*", "shard", "slot").write.partitionBy("shard").parquet(path))
