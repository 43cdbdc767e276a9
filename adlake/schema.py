"""Explicit schemas of the raw feed and of the seven history tables."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DateType, DoubleType, LongType, StringType, StructField, StructType, TimestampType,
)

_S, _D, _N, _L = StringType(), DateType(), DoubleType(), LongType()


def _struct(**fields):
    return StructType([StructField(name, kind) for name, kind in fields.items()])


RAW = _struct(
    url=_S, job_id=_S, title=_S, company_name=_S, description=_S, requirements=_S, salary=_S, location=_S,
    technologies=ArrayType(_S), seniority=_S, employment_type=_S,
)

PAGES = _struct(page_id=_L, url=_S, html=_S)

TABLES = {
    "job_postings": _struct(
        job_id=_S, title=_S, company_name=_S, url=_S, first_seen_date=_D, last_seen_date=_D,
        is_active=BooleanType(), created_at=TimestampType(), updated_at=TimestampType(),
    ),
    "job_snapshots": _struct(
        job_id=_S, snapshot_date=_D, description=_S, requirements=_S, location_type=_S, city=_S, region=_S,
        country=_S, seniority_level=_S, employment_type=_S,
    ),
    "salaries": _struct(
        job_id=_S, snapshot_date=_D, currency=_S, salary_min=_N, salary_max=_N, salary_avg=_N, period=_S,
        is_b2b=BooleanType(),
    ),
    "technologies": _struct(technology_id=_L, name=_S, category=_S),
    "job_technologies": _struct(job_id=_S, technology_id=_L, proficiency_level=_S, snapshot_date=_D),
    "daily_metrics": _struct(
        metric_date=_D, total_jobs=_L, remote_jobs=_L, office_jobs=_L, hybrid_jobs=_L, avg_salary_pln=_N,
        median_salary_pln=_N, jobs_scraped=_L,
    ),
    "scrape_runs": _struct(
        run_date=TimestampType(), jobs_found=_L, jobs_new=_L, jobs_updated=_L, jobs_expired=_L, status=_S,
        error_message=_S, duration_seconds=_N,
    ),
}

# Refused ads with their reason, beside the history.
REJECTS = StructType([*RAW.fields, StructField("reason", _S), StructField("snapshot_date", _D)])

# Tables with one row per key and day: written and pruned by snapshot_date.
DATED = ("job_snapshots", "salaries", "job_technologies")

UNIQUE_KEYS = {
    "job_postings": ["job_id"],
    "job_snapshots": ["job_id", "snapshot_date"],
    "salaries": ["job_id", "snapshot_date"],
    "technologies": ["name"],
    "job_technologies": ["job_id", "technology_id", "snapshot_date"],
    "daily_metrics": ["metric_date"],
}

NOT_NULL = {
    "job_postings": ["job_id", "title", "company_name", "url", "first_seen_date", "last_seen_date"],
    "job_snapshots": ["job_id", "snapshot_date"],
    "salaries": ["job_id", "snapshot_date"],
    "technologies": ["name"],
    "job_technologies": ["job_id", "technology_id", "snapshot_date"],
    "daily_metrics": ["metric_date"],
    "scrape_runs": ["run_date"],
}

FOREIGN_KEYS = [
    ("job_snapshots", "job_id", "job_postings", "job_id"),
    ("salaries", "job_id", "job_postings", "job_id"),
    ("job_technologies", "job_id", "job_postings", "job_id"),
    ("job_technologies", "technology_id", "technologies", "technology_id"),
]


def empty(spark, table):
    return spark.createDataFrame([], TABLES[table])
