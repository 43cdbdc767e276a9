"""Event files as a stream: duplicates are counted once, days are closed by the watermark, late rows are mended.

The state of the stream holds the events of open days and the totals of days; both leave it when the watermark passes
their day, and the closed day is appended. What arrives after that no longer meets its state, so a second, stateless pass
counts the rows that arrive per day, and a day whose closed row knows of fewer rows than arrived is measured again from
its files. The result equals a batch over all files, whatever their order.
Days are days of UTC, to which the session's time zone is to be set.
"""

import os
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def _state_on_disk(spark: SparkSession):
    before = {name: spark.conf.get(name, None) for name in _STATE}
    try:
        for name, value in _STATE.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class DayLog:
    """Daily totals of a folder of event files, kept under ``root``.

    ``key`` names the columns that make rows the same event, with ``time`` among them; of rows that differ in other
    columns the least counts. ``totals`` are aggregates over distinct events, in columns of the events.
    """

    def __init__(self, spark: SparkSession, folder: str, root: str, fields: StructType, key: list[str], time: str, totals: dict[str, Column]):
        self.spark, self.folder, self.root, self.fields, self.key, self.time, self.totals = spark, folder, root, fields, key, time, totals

    def _path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def _source(self, files_per_batch: int) -> DataFrame:
        return self.spark.readStream.schema(self.fields).option("maxFilesPerTrigger", files_per_batch).parquet(self.folder)

    def _once(self, events: DataFrame, *by: Column) -> DataFrame:
        rest = [f.name for f in self.fields if f.name not in self.key]
        return events.groupBy(*by, *self.key).agg(F.count(F.lit(1)).alias("_copies"), F.min(F.struct(*rest)).alias("_rest"))

    def _totals(self, once: DataFrame, *by: Column) -> DataFrame:
        flat = once.select("*", "_rest.*").drop("_rest")
        return flat.groupBy(*by).agg(F.sum("_copies").alias("n_rows"), F.count(F.lit(1)).alias("n_events"), *[c.alias(n) for n, c in self.totals.items()])

    def _closing(self, events: DataFrame, delay: str) -> DataFrame:
        # The watermark marks a copy, so that the event's own time may be part of its key.
        timed = events.withColumn("_time", F.col(self.time)).withWatermark("_time", delay)
        once = self._once(timed, F.window("_time", "1 day").alias("_day"))
        return self._totals(once, F.window(F.col("_day"), "1 day").alias("_w")).select(F.col("_w.start").cast("date").alias("day"), F.col("*")).drop("_w")

    def _arrived(self, batch: DataFrame, number: int) -> None:
        # One folder per batch: a batch that runs again replaces its own counts.
        counts = batch.groupBy(F.to_date(self.time).alias("day")).agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(self._path(f"arrivals/batch={number}"))

    def advance(self, delay: str = "2 days", files_per_batch: int = 1000) -> None:
        """Take in the files that are new, and return. Days that end before the watermark are closed."""
        with _state_on_disk(self.spark):
            closing = self._closing(self._source(files_per_batch), delay).writeStream.outputMode("append").format("parquet")
            closing = closing.option("path", self._path("closed")).option("checkpointLocation", self._path("_closing"))
            arriving = self._source(files_per_batch).writeStream.foreachBatch(self._arrived).option("checkpointLocation", self._path("_arriving"))
            for query in (closing, arriving):
                query.trigger(availableNow=True).start().awaitTermination()
        self._mend()

    def _mend(self) -> None:
        """Measure those days anew that have more rows than their last measure knows of; open days are among them."""
        arrived = self.spark.read.parquet(self._path("arrivals")).groupBy("day").agg(F.sum("n").alias("n"))
        known = self.days().select(F.col("day").alias("_known"), "n_rows")
        stale = arrived.join(known, F.col("day") == F.col("_known"), "left").where(~F.col("n").eqNullSafe(F.col("n_rows"))).select("day")
        day = F.to_date(self.time)
        # Few days, each one value: the files' rows are filtered before they are shuffled.
        rows = self.spark.read.schema(self.fields).parquet(self.folder).join(F.broadcast(stale), day == F.col("day"), "left_semi")
        again = self._totals(self._once(rows, day.alias("day")), F.col("day"))
        again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self._path("mended"))

    def closed(self) -> DataFrame:
        """Days as the stream has closed them."""
        return self.spark.read.parquet(self._path("closed"))

    def days(self) -> DataFrame:
        """One row per day: as measured last."""
        held = self.spark.createDataFrame([], StructType([*self._fields()]))
        for name, order in (("closed", 0), ("mended", 1)):
            if self._written(name):
                held = held.unionByName(self.spark.read.parquet(self._path(name)).withColumn("_order", F.lit(order)))
        columns = [c for c in held.columns if c not in ("day", "_order")]
        return held.groupBy("day").agg(F.max_by(F.struct(*columns), "_order").alias("_row")).select("day", "_row.*")

    def _fields(self):
        empty = self.spark.createDataFrame([], self.fields)
        measured = self._totals(self._once(empty, F.to_date(self.time).alias("day")), F.col("day"))
        return measured.withColumn("_order", F.lit(0)).schema

    def _written(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.exists(path) and any(s.getPath().getName()[0] not in "_." for s in files.listStatus(path))
