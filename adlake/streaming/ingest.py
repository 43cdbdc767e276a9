"""Raw captures as a stream of files, loaded by the same keyed merges as a batch.

The tables are the only state. Merges are keyed and cover all days of a micro-batch at once, late days included;
a micro-batch that runs again changes nothing.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, StructField, StructType

from adlake import schema
from adlake.operators.daily import load_days
from adlake.sources.store import JobStore

_DATED_RAW = StructType(schema.RAW.fields + [StructField("run_date", DateType())])


def capture_stream(spark: SparkSession, folder: str, multi_line: bool = False, files_per_trigger: int = 1000) -> DataFrame:
    """Capture folders ``run_date=YYYY-MM-DD`` with an order column."""
    ads = spark.readStream.schema(_DATED_RAW).option("multiLine", multi_line).option(
        "maxFilesPerTrigger", files_per_trigger).json(folder)
    return ads.withColumn("file", F.col("_metadata.file_path"))


def _load_batch(store: JobStore, ads: DataFrame) -> None:
    ordered = ads.withColumn("seq", F.struct("file", F.monotonically_increasing_id().alias("place"))).drop("file")
    load_days(store, ordered, F.col("run_date"), complete=False)


def ingest(store: JobStore, folder: str, checkpoint: str, multi_line: bool = False) -> StreamingQuery:
    """Start loading all files that are there; ends by itself. Every touched day gets its metrics anew."""
    ads = capture_stream(store.spark, folder, multi_line)
    return ads.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda frame, _: _load_batch(store, frame)).start()
