"""Raw captures and page tables (S3-S5), query and result files (S1, S2, S8), run log rows."""

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from adlake import schema

_CORRUPT = "_corrupt_record"
RAW_WITH_CORRUPT = StructType(schema.RAW.fields + [StructField(_CORRUPT, StringType())])


def write_capture(ads: DataFrame, path: str) -> None:
    """S3: one folder per run date; text is written as it is, not escaped."""
    ads.write.mode("append").partitionBy("run_date").json(path)


def read_capture(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Ads plus ``seq``, their order within the capture. Fields of the wrong kind become null.

    ``multi_line`` reads JSON array files; folders written by write_capture hold one ad per line.
    """
    ads = spark.read.schema(RAW_WITH_CORRUPT).option("multiLine", multi_line).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", _CORRUPT).json(path)
    return with_sequence(ads)


def with_sequence(ads: DataFrame) -> DataFrame:
    """Order of ads: by file name (captures are named by time), then by place in the file."""
    return ads.withColumn("seq", F.struct(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """S5."""
    return spark.read.schema(schema.PAGES).parquet(path)


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, table in tables.items():
        table.createOrReplaceTempView(name)


def fetch_all(spark: SparkSession, query: str, **params) -> DataFrame:
    """A query over the registered views with named parameters, ``:name`` in the text."""
    return spark.sql(query, args=params or None)


def fetch_one(spark: SparkSession, query: str, **params) -> Row | None:
    """S2."""
    return fetch_all(spark, query, **params).limit(1).first()


def export(result: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with header or JSON records."""
    writer = result.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown export format {kind!r}")


def scrape_run(
    spark: SparkSession, run_date: Column, jobs_found: int = 0, jobs_new: int = 0, jobs_updated: int = 0,
    jobs_expired: int = 0, status: str | None = None, error_message: str | None = None,
    duration_seconds: float | None = None,
) -> DataFrame:
    """One run log row; without a status, 'partial' when nothing was found, else 'success'."""
    values = {
        "run_date": run_date, "jobs_found": jobs_found, "jobs_new": jobs_new, "jobs_updated": jobs_updated,
        "jobs_expired": jobs_expired, "status": status or ("success" if jobs_found else "partial"),
        "error_message": error_message, "duration_seconds": duration_seconds,
    }
    kinds = {f.name: f.dataType for f in schema.TABLES["scrape_runs"]}
    return spark.range(1).select(*[
        (v if isinstance(v, Column) else F.lit(v)).cast(kinds[n]).alias(n) for n, v in values.items()])
