"""Catalog tables bucketed by job: right results, and plans that move no stored row."""

import uuid

import pytest
from pyspark.sql import functions as F

from adlake.operators import load
from adlake.plans import queries
from adlake.sources.store import CatalogTables, create_tables, drop_tables, insert_rows

_SETTINGS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


@pytest.fixture(scope="module")
def tables(spark):
    before = {key: spark.conf.get(key, None) for key in _SETTINGS}
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    database = f"adlake_b{uuid.uuid4().hex[:8]}"
    create_tables(spark, database, buckets=4)
    jobs = spark.range(200).select(F.concat(F.lit("j"), "id").alias("job_id"), "id")
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 3).cast("int"))
    rows = {
        "job_postings": jobs.select("job_id", F.lit("t").alias("title"), F.lit("c").alias("company_name"), F.lit("u").alias("url"),
                                    day.alias("first_seen_date"), day.alias("last_seen_date"), (F.col("id") % 5 != 0).alias("is_active"),
                                    F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at")),
        "salaries": jobs.select("job_id", day.alias("snapshot_date"), F.lit("PLN").alias("currency"), F.col("id").cast("double").alias("salary_min"),
                                (F.col("id") + 10.0).alias("salary_max"), (F.col("id") + 5.0).alias("salary_avg"), F.lit("monthly").alias("period"),
                                F.lit(False).alias("is_b2b")),
        "technologies": spark.createDataFrame([(1, "A", "x"), (2, "B", "y")], "technology_id bigint, name string, category string"),
        "job_technologies": jobs.select("job_id", (F.col("id") % 2 + 1).alias("technology_id"), F.lit(None).cast("string").alias("proficiency_level"),
                                        day.alias("snapshot_date")),
    }
    for name, frame in rows.items():
        insert_rows(frame, f"{database}.{name}")
    yield CatalogTables(spark, database), rows
    drop_tables(spark, database)
    spark.sql(f"DROP DATABASE {database}")
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_file_per_bucket_and_folder(spark, tables):
    held, _ = tables
    files = held["salaries"].select("snapshot_date", F.input_file_name().alias("file")).distinct().groupBy("snapshot_date").count()
    assert {r["count"] for r in files.collect()} == {4}
    insert_rows(held["salaries"].limit(0), f"{held.database}.salaries")
    assert held["salaries"].count() == 200


def test_joins_of_stored_tables_move_nothing(tables):
    held, _ = tables
    links, pay, ads = held["job_technologies"], held["salaries"], held["job_postings"]
    joined = links.join(ads.filter("is_active").select("job_id"), "job_id").join(pay, ["job_id", "snapshot_date"])
    assert "SortMergeJoin" in _plan(joined) and "Exchange" not in _plan(joined)
    assert joined.count() == 160
    per_job = joined.groupBy("job_id").agg(F.max("salary_max"))
    assert "Exchange" not in _plan(per_job)


def test_queries_equal_those_on_plain_tables(tables):
    held, rows = tables
    plain = {row.technology: row for row in queries.salary_by_technology(rows).collect()}
    assert {row.technology: row for row in queries.salary_by_technology(held).collect()} == plain and len(plain) == 2


def test_a_merge_moves_only_the_batch(spark, tables):
    held, _ = tables
    batch = spark.range(100, 300).select(
        F.concat(F.lit("j"), "id").alias("job_id"), F.lit("t").alias("title"), F.lit("c").alias("company_name"), F.lit("u").alias("url"),
        F.lit("2026-01-04").cast("date").alias("snapshot_date"), F.col("id").alias("seq"))
    merged = load.merge_postings(held["job_postings"], batch, F.current_timestamp())
    lines = _plan(merged).splitlines()
    moved = [line for line in lines if "Exchange hashpartitioning(job_id" in line]
    assert len(moved) == 1 and any("job_postings" in line and "Bucketed: true" in line for line in lines), moved
    states = {r.change: r["count"] for r in merged.groupBy("change").count().collect()}
    assert states["new"] == 100 and states["updated"] == 100
