"""Reading the given tables, and written intermediate tables in the shared folder."""

import ctypes
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from adlake.session import scratch_root


_SENT = set()


def send_code(spark: SparkSession) -> None:
    """Give this package to the executors, once per application, so that they need no copy of it."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="adlake-code-"), "adlake_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _SENT.add(context.applicationId)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, *by: str) -> DataFrame:
    """The frame as a table in the shared folder: it cuts the lineage and survives lost executors.

    The table stays after the call, since frames built on it are lazy; the folder is the cluster's checkpoint folder
    and is emptied with it.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_root(spark), f"corpus-{uuid.uuid4().hex}")
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """At a task's end: what Arrow's pool and the C library keep of freed memory goes back to the system, for the worker waits or
    runs other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def row_key(*columns: str):
    """A non-null 64-bit key of a row's content; equal rows share it."""
    return F.xxhash64(*[F.col(c) for c in columns])


def needs(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that others, whatever their names, cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
