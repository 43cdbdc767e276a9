"""Checked records to normalised rows."""

from pyspark.sql import Column, DataFrame, functions as F

from adlake.functions.labels import seniority_level, technology_category
from adlake.functions.pay import with_pay
from adlake.functions.place import with_place


def normalise(records: DataFrame, cities: Column | None = None) -> DataFrame:
    """One flat row per ad; technologies stay an array of names until the link table needs them.

    All expressions return null on bad text, so no row can fail here.
    """
    carried = [c for c in ("seq",) if c in records.columns]
    flat = records.select(*carried, "job_posting.*", "snapshot.*", "salary.salary_text", "technologies")
    placed = with_place(flat, "location", cities)
    levelled = placed.withColumn("seniority_level", seniority_level(F.col("seniority")))
    return with_pay(levelled, "salary_text").drop("location", "seniority", "salary_text")


def technology_rows(rows: DataFrame) -> DataFrame:
    """(.., name, pos) per technology of each ad; categories are added on distinct names only."""
    carried = [c for c in ("job_id", "snapshot_date", "seq") if c in rows.columns]
    return rows.select(*carried, F.posexplode("technologies").alias("pos", "name")).filter("name IS NOT NULL")


def categorised(names: DataFrame) -> DataFrame:
    """N11 + N6 for a frame with a distinct ``name`` column."""
    return names.withColumn("category", technology_category(F.col("name")))
