"""The history store: Parquet folders that are replaced by day or by bucket.

A change first writes all its new rows beside the tables, in ``_changes``, then the list of its steps, and only then
moves its files in place of those of the touched days and buckets. Each step may be done twice. Whoever opens the store next
finishes a change whose list is there and discards one without, so after a crash at any point the store is as before or as
after the change.
One writer at a time; readers that run beside it open with ``mend=False``.
"""

import json
import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from adlake import schema
from adlake.session import delete_path, move_file, names_in

# Stores made before the number was kept have so many buckets of postings.
_OLD_BUCKETS = 64
ROWS_PER_BUCKET = 500_000

# The column whose values are folders, for the tables that are replaced in parts.
_PARTS = {**dict.fromkeys(schema.DATED, "snapshot_date"), "rejects": "snapshot_date", "daily_metrics": "metric_date", "job_postings": "bucket"}
# The key by which a table that only grows takes no row twice.
_GROWS = {"technologies": "technology_id"}
_CHANGES, _STEPS, _LAYOUT = "_changes", "_steps", "_layout"


def fields_of(name: str) -> StructType:
    return schema.REJECTS if name == "rejects" else schema.TABLES[name]


class JobStore:
    def __init__(self, spark: SparkSession, root: str, mend: bool = True):
        self.spark, self.root, self._buckets = spark, root, None
        if mend:
            self.mend()

    def path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def exists(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def folders(self, path: str) -> list[str]:
        """Names of what lies in a folder; a change's own folder holds a few tables, so the list is short."""
        return names_in(self.spark, path)

    @property
    def buckets(self) -> int:
        """The number of buckets of postings, kept with the store."""
        if self._buckets is None:
            if self.exists(self.path(_LAYOUT)):
                self._buckets = json.loads(self.spark.read.text(self.path(_LAYOUT)).first().value)["buckets"]
            elif self.exists(self.path("job_postings")):
                self._buckets = _OLD_BUCKETS
        return self._buckets

    def settle_buckets(self, postings: DataFrame) -> None:
        """At the first load: buckets for twice as many postings as there are."""
        if self.buckets is None:
            number = max(1, -(-2 * postings.count() // ROWS_PER_BUCKET))
            kept = self.spark.createDataFrame([(json.dumps({"buckets": number}),)], "value string")
            kept.coalesce(1).write.mode("overwrite").text(self.path(_LAYOUT))
            self._buckets = number

    def bucket_of(self, job_id: str = "job_id") -> Column:
        """The part of the postings that a job is in."""
        return F.pmod(F.xxhash64(job_id), F.lit(self.buckets or _OLD_BUCKETS)).cast("int")

    def mend(self) -> None:
        """Finish the changes whose list of steps is complete, and drop the others."""
        for name in self.folders(self.path(_CHANGES)):
            aside = self.path(_CHANGES, name)
            # One file that appears when it is complete; without it no table has been touched.
            listed = self.spark.read.text(os.path.join(aside, _STEPS)).collect() if self.exists(os.path.join(aside, _STEPS)) else []
            if listed:
                self.redo(aside, json.loads(listed[0].value))
            delete_path(self.spark, aside)

    def redo(self, aside: str, steps: list[dict]) -> None:
        for step in steps:
            self.apply(aside, step)

    def apply(self, aside: str, step: dict) -> None:
        """Do one step of a change; doing it again changes nothing."""
        name, column = step["table"], step["column"]
        if step["rows"] and column is None:
            rows, key = self.spark.read.schema(_staged_fields(name)).parquet(os.path.join(aside, name)), _GROWS[name]
            rows.join(self.table(name).select(key), key, "left_anti").select(*rows.columns).write.mode("append").parquet(self.path(name))
        elif step["rows"]:
            for part in names_in(self.spark, os.path.join(aside, name)):
                if part.startswith(f"{column}="):
                    self._move(os.path.join(aside, name, part), self.path(name, part))
        for value in step["emptied"]:
            delete_path(self.spark, self.path(name, f"{column}={value}"))

    def _move(self, staged: str, part: str) -> None:
        """The staged files of a day or bucket in place of those it has; files moved already, known by their write, stay."""
        files = names_in(self.spark, staged)
        if files:
            write = {_write_of(f) for f in files}
            for old in names_in(self.spark, part):
                if _write_of(old) not in write:
                    delete_path(self.spark, os.path.join(part, old))
            for file in files:
                move_file(self.spark, os.path.join(staged, file), part)

    def __getitem__(self, name: str) -> DataFrame:
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        fields = fields_of(name)
        if not self.exists(self.path(name)):
            # Known to be empty when a query is planned, so that a first load joins nothing with it.
            nothing = self.spark.range(1).where(F.lit(False))
            return nothing.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
        return self.spark.read.schema(fields).parquet(self.path(name)).select(*fields.names)

    def days_of(self, name: str, days: DataFrame) -> DataFrame:
        """Rows of the days in a one-column frame; a filter on the folders."""
        return self.table(name).join(F.broadcast(days.select("snapshot_date").distinct()), "snapshot_date", "left_semi")

    def days(self, name: str = "job_snapshots") -> list:
        """Days held by a dated table, ascending: one value per folder."""
        return [r.snapshot_date for r in self.table(name).select("snapshot_date").distinct().orderBy("snapshot_date").collect()]

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in schema.TABLES}

    def change(self) -> "Change":
        return Change(self)

    def append_run(self, run: DataFrame) -> None:
        """The run log only grows."""
        run.coalesce(1).write.mode("append").parquet(self.path("scrape_runs"))

    def retain(self, as_of, keep_days: int) -> list:
        """Drop the folders of days before the cutoff. Returns the days."""
        cutoff = self.spark.range(1).select(F.date_sub(F.lit(as_of).cast("date"), keep_days).alias("d")).first().d
        gone = {name: [d for d in self.days(name) if d < cutoff] for name in schema.DATED}
        with self.change() as change:
            for name, days in gone.items():
                change.empty(name, days)
        return sorted({d for days in gone.values() for d in days})

    def delete_jobs(self, keys: DataFrame) -> None:
        """Rewrite the days and buckets that hold one of the jobs."""
        keys = keys.select("job_id")
        with self.change() as change:
            for name in (*schema.DATED, "job_postings"):
                part = F.col("snapshot_date") if name in schema.DATED else self.bucket_of()
                rows = self.table(name).withColumn("_part", part)
                hit = rows.join(keys, "job_id", "left_semi").select("_part").distinct()
                touched = rows.join(F.broadcast(hit), "_part", "left_semi")
                change.replace(name, touched.join(keys, "job_id", "left_anti").drop("_part"), hit)

    def drop(self) -> None:
        """Remove the store."""
        delete_path(self.spark, self.root)


def _write_of(file: str) -> str:
    """What the files of one write have in common: part-<task>-<write>.c<number>.<kind>."""
    return re.sub(r"^part-[0-9]+-|[.-]c[0-9]+\.[^-]*$", "", file)


def _staged_fields(name: str) -> StructType:
    fields = fields_of(name)
    return StructType([*fields, StructField("bucket", IntegerType())]) if _PARTS.get(name) == "bucket" else fields


class Change:
    """Rows are written aside as they come and replace what they touch when the block ends without an error."""

    def __init__(self, store: JobStore):
        self.store, self.aside, self.steps = store, store.path(_CHANGES, uuid.uuid4().hex), []

    def __enter__(self):
        return self

    def _stage(self, name: str, rows: DataFrame, column: str | None) -> DataFrame:
        fields, path = _staged_fields(name), os.path.join(self.aside, name)
        writer = rows.select(*fields.names)
        if column is None:
            writer.write.parquet(path)
        else:  # one writer per part, or several where AQE finds a part too large: few files per folder
            writer.hint("rebalance", F.col(column)).write.partitionBy(column).parquet(path)
        return self.store.spark.read.schema(fields).parquet(path)

    def replace(self, name: str, rows: DataFrame, parts: DataFrame | None = None) -> DataFrame:
        """Replace the parts (days or buckets) that rows has; those of ``parts`` without rows become empty."""
        column = _PARTS[name]
        rows = rows.withColumn("bucket", self.store.bucket_of()) if column == "bucket" else rows
        written = self._stage(name, rows, column)
        emptied = [] if parts is None else [str(r[0]) for r in parts.join(
            written.select(F.col(column).alias("_has")).distinct(), parts[parts.columns[0]] == F.col("_has"), "left_anti").collect()]
        self.steps.append({"table": name, "column": column, "rows": True, "emptied": emptied})
        return written

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        written = self._stage(name, rows, None)
        self.steps.append({"table": name, "column": None, "rows": True, "emptied": []})
        return written

    def empty(self, name: str, parts: list) -> None:
        """Drop parts (days or buckets)."""
        if parts:
            self.steps.append({"table": name, "column": _PARTS[name], "rows": False, "emptied": [str(p) for p in parts]})

    def __exit__(self, kind, error, trace):
        spark = self.store.spark
        if kind is None and self.steps:
            listed = spark.createDataFrame([(json.dumps(self.steps),)], "value string")
            listed.coalesce(1).write.text(os.path.join(self.aside, _STEPS))
            # From here on an error leaves the folder, and the next opening finishes the change.
            self.store.redo(self.aside, self.steps)
        delete_path(spark, self.aside)
        return False


def create_tables(spark: SparkSession, database: str, buckets: int | None = None) -> None:
    """The seven tables in the session catalog, dated ones partitioned by day.

    With ``buckets`` the tables of jobs are clustered by job_id: their joins move no stored row, and a merge of new rows
    moves these alone. For joins on job and day this asks for ``spark.sql.requireAllClusterKeysForCoPartition`` = false.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, fields in schema.TABLES.items():
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
        partition = "PARTITIONED BY (snapshot_date)" if name in schema.DATED else ""
        clustered = f"CLUSTERED BY (job_id) SORTED BY (job_id) INTO {buckets} BUCKETS" if buckets and "job_id" in fields.names else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet {partition} {clustered}")


def drop_tables(spark: SparkSession, database: str) -> None:
    for name in schema.TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def insert_rows(rows: DataFrame, table: str) -> None:
    """Bulk append by column name to a catalog table; a bucketed one gets a file per bucket and folder."""
    spark = rows.sparkSession
    rows = rows.select(*spark.table(table).columns)
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    if "Num Buckets" in described:
        rows = rows.repartition(int(described["Num Buckets"]), "job_id")
    rows.write.mode("append").insertInto(table)


class CatalogTables:
    """The tables of a database by name, as the queries of ``plans`` take them."""

    def __init__(self, spark: SparkSession, database: str):
        self.spark, self.database = spark, database

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}")
