"""Session defaults and shared scratch space."""

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Set only where the cluster has not set them already.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", partitions: int = 8, **conf) -> SparkSession:
    """A session for tests and the bench; on a cluster, use the session you are given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("adlake")
    settings = {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false",
                "spark.driver.memory": "16g", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only a local session may do without, and uses its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; empty where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(hadoop)) if files.exists(hadoop) else []


def move_file(spark: SparkSession, path: str, folder: str) -> None:
    """Move a file into a folder of the same file system."""
    hadoop, to = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(to)
    target = spark._jvm.org.apache.hadoop.fs.Path(to, hadoop.getName())
    if files.exists(target):  # a copy that was cut off
        files.delete(target, False)
    if not files.rename(hadoop, target):
        raise OSError(f"{path} was not moved to {folder}")


@contextmanager
def staged(df: DataFrame, *by: str):
    """Write a frame that several jobs read to the shared folder, and drop it when they are done.

    Unlike a cache on the executors it survives their loss, and later reads still prune columns; with ``by``
    they also prune folders.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_root(spark), f"adlake-{uuid.uuid4().hex}")
    df.write.partitionBy(*by).parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        delete_path(spark, path)
