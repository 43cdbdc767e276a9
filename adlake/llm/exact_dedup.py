"""Exact deduplication as a stream with keyed state on disk, which holds digest, identifier and locator of each text.

The stream reads a folder of Parquet files and keeps, per digest of a text's content and without expiry, the number of
its rows and the first of them by identifier, with the place where its content lies (file and row). The state is
RocksDB under a checkpoint, so files that come later meet all that were read before. Decisions compare the full content
of every hit with that of the first row; rows whose content differs in spite of an equal digest are grouped by content.
"""

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window

from adlake.llm.tables import written
from adlake.session import scratch_root

# Content that one (digest, salt) cell may hold, and how many digests may be hot: these alone are broadcast.
CELL_BYTES = 1 << 20
MOST_HOT = 50_000
_STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # One bounded pool for all state partitions of an executor.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
# A state partition costs an executor some megabytes of disk whatever it holds, so their number follows the rows.
STATE_ROWS = 1_000_000
_STATE_PARTITIONS = "spark.sql.streaming.internal.stateStore.partitions"
_LOCATOR = ["file", "place"]


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def content_of(text: str = "text") -> Column:
    """What is compared: the text with each run of ASCII white space as one space; a null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256_digest(content: Column) -> Column:
    return F.unhex(F.sha2(F.encode(content, "UTF-8"), 256))


def _rows(files: DataFrame, identifier: str, text: str, digest) -> DataFrame:
    content = content_of(f"`{text}`")
    return files.select(
        F.col(f"`{identifier}`").alias("id"), content.alias("content"), digest(content).alias("digest"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))


def _files(path: str) -> str:
    """The path as a pattern of itself: a stream reads patterns of single files, but no path of one."""
    return f"{path[:-1]}[{path[-1]}]"


def ingest(spark: SparkSession, path: str, checkpoint: str, identifier: str = "doc_id", text: str = "text",
           digest=sha256_digest, bytes_per_batch: int = 1 << 38, state_rows: int = STATE_ROWS) -> None:
    """Read the files under ``path`` that the state at ``checkpoint`` has not seen, in batches, and then return.

    The first call sets the number of state partitions: one per ``state_rows`` rows, and as many as there are cores at
    least. Copies combine before the shuffle, so a text that a third of all rows repeat costs its partition a row per task.
    """
    whole = spark.read.parquet(path)
    partitions = max(spark.sparkContext.defaultParallelism, -(-whole.count() // state_rows))
    files = spark.readStream.schema(whole.schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(_files(path))
    rows = _rows(files, identifier, text, digest)
    first = F.struct(F.col("id").isNull().alias("lost"), "id", *_LOCATOR, F.octet_length("content").alias("size"))
    kept = rows.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    with _settings(spark, {**_STATE_SETTINGS, _STATE_PARTITIONS: str(partitions)}):
        kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def retained(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state: digest, keep_id, keep_file, keep_place, size of the content in bytes, n rows."""
    with _settings(spark, _STATE_SETTINGS):
        state = spark.read.format("statestore").load(checkpoint)
    first = "value." + state.select("value.*").columns[0]
    count = "value." + state.select("value.*").columns[1]
    return state.select("key.digest", F.col(f"{first}.id").alias("keep_id"), F.col(f"{first}.file").alias("keep_file"),
                        F.col(f"{first}.place").alias("keep_place"), F.col(f"{first}.size").alias("size"), F.col(count).alias("n"))


def _checked(rows: DataFrame, state: DataFrame, cell_bytes: int) -> DataFrame:
    """Rows with their state and ``same``, whether their content is that of the first row, byte by byte.

    A digest with more content than a cell takes is split over several by salt, and its first row goes to all of them.
    """
    total = state.agg(F.sum(F.col("n") * (F.col("size") + 1)).cast("long")).first()[0] or 0
    cell = max(cell_bytes, -(-total // MOST_HOT))  # so that at most MOST_HOT digests are above it
    bulk = F.col("n") * (F.col("size") + 1)
    hot = F.broadcast(state.where(bulk > cell).select(
        "digest", F.least("n", F.ceil(bulk / cell)).cast("int").alias("salts"), F.col("keep_file").alias("_file"), F.col("keep_place").alias("_place")))
    leads = (F.col("file") == F.col("_file")) & (F.col("place") == F.col("_place"))
    own = F.pmod(F.xxhash64("file", "place"), F.col("salts")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("salts") - 1)
    dealt = rows.join(hot, "digest", "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn(
        "salt", F.explode(F.when(leads, everywhere).otherwise(F.array("own"))))
    dealt = dealt.select("id", "content", "digest", *_LOCATOR, "salt", (F.col("salt") != F.col("own")).alias("extra"))
    cells = state.join(hot.select("digest", "salts"), "digest", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts", "size")
    met = dealt.join(cells, ["digest", "salt"]).withColumn("kept", (F.col("file") == F.col("keep_file")) & (F.col("place") == F.col("keep_place")))
    ahead = Window.partitionBy("digest", "salt").orderBy(F.desc("kept"))
    return met.withColumn("same", F.col("content") == F.first("content").over(ahead)).where(~F.col("extra")).drop("salt", "extra")


def decisions(spark: SparkSession, path: str, checkpoint: str, identifier: str = "doc_id", text: str = "text",
              digest=sha256_digest, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Every row of the files: id, file, place, keep_id, group_size, kept and the SHA-256 of its content, in hex."""
    rows, state = _rows(spark.read.parquet(path), identifier, text, digest), written(retained(spark, checkpoint))
    sha = F.sha2(F.encode("content", "UTF-8"), 256) if digest is not sha256_digest else F.lower(F.hex("digest"))
    checked = written(_checked(rows, state, cell_bytes).select(
        "id", *_LOCATOR, "digest", "keep_id", F.col("n").alias("group_size"), "kept", "same", sha.alias("text_sha256")))
    out = ["id", *_LOCATOR, "keep_id", "group_size", "kept", "text_sha256"]
    collided = written(checked.where(~F.col("same")).select("digest").distinct())
    if collided.isEmpty():
        return checked.select(*out)
    again = rows.join(collided, "digest", "left_semi").withColumn("sha", F.sha2(F.encode("content", "UTF-8"), 256))
    lead = F.struct(F.col("id").isNull().alias("lost"), "id", *_LOCATOR)
    groups = again.groupBy(F.col("content").alias("whole")).agg(F.min(lead).alias("lead"), F.count(F.lit(1)).alias("group_size"))
    settled = again.join(groups, F.col("content") == F.col("whole")).select(
        "id", *_LOCATOR, F.col("lead.id").alias("keep_id"), "group_size",
        ((F.col("file") == F.col("lead.file")) & (F.col("place") == F.col("lead.place"))).alias("kept"), F.col("sha").alias("text_sha256"))
    return checked.join(collided, "digest", "left_anti").select(*out).unionByName(settled)


def deduplicate(spark: SparkSession, path: str, checkpoint: str | None = None, **options) -> DataFrame:
    """Ingest what is new under ``path`` and decide on all of it; without a checkpoint, with a state of its own.

    Of equal contents the row with the smallest identifier stays (null ones last; of one identifier's rows the first by
    file and place), so of repeated rows exactly one stays. Null and empty texts are equal to each other. Other columns
    are not read, whatever their names. An empty table gives no rows. A long text counts whole.
    """
    checkpoint = checkpoint or os.path.join(scratch_root(spark), f"dedup-{uuid.uuid4().hex}")
    ingest(spark, path, checkpoint, **{k: v for k, v in options.items() if k != "cell_bytes"})
    return decisions(spark, path, checkpoint, **{k: v for k, v in options.items() if k not in ("bytes_per_batch", "state_rows")})
