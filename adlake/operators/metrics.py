"""Daily metrics (M1-M3)."""

from pyspark.sql import Column, DataFrame, functions as F

from adlake.operators.ranks import upper_median


def _type_count(kind: str) -> Column:
    return F.sum(F.when(F.col("location_type") == kind, 1).otherwise(0)).alias(f"{kind}_jobs")


def daily_metrics(postings: DataFrame, snapshots: DataFrame, salaries: DataFrame, day: Column) -> DataFrame:
    """M1 + M2 for one day: active postings with that day's snapshot and pay, both optional."""
    day = day.cast("date")
    snap = snapshots.filter(F.col("snapshot_date") == day).select("job_id", "location_type")
    pay = salaries.filter(F.col("snapshot_date") == day).select("job_id", "salary_avg")
    row = (
        postings.filter("is_active").select("job_id").join(snap, "job_id", "left").join(pay, "job_id", "left")
        .agg(
            F.count_distinct("job_id").alias("total_jobs"),
            _type_count("remote"), _type_count("office"), _type_count("hybrid"),
            F.avg("salary_avg").alias("avg_salary_pln"),
        )
    )
    median = upper_median(pay, [], "salary_avg", "m").scalar()
    return row.select(
        day.alias("metric_date"), "total_jobs", "remote_jobs", "office_jobs", "hybrid_jobs", "avg_salary_pln",
        median.alias("median_salary_pln"), F.col("total_jobs").alias("jobs_scraped"))


def metrics_by_date(postings: DataFrame, snapshots: DataFrame, salaries: DataFrame) -> DataFrame:
    """M1 + M2 for every day of the history in one pass, on the present active flag.

    Jobs without a snapshot that day only add to the total, so the total is one count of active postings and
    the other columns come from the active rows of the day.
    """
    active = postings.filter("is_active").select("job_id")
    total = active.agg(F.count_distinct("job_id")).scalar()
    # Snapshots and pay meet the active postings together: one join, one grouping.
    nothing = F.lit(None)
    rows = snapshots.select("job_id", "snapshot_date", F.lit(True).alias("_seen"), "location_type", nothing.cast("double").alias("_pay")).union(
        salaries.select("job_id", "snapshot_date", F.lit(False), nothing.cast("string"), "salary_avg"))
    flagged = rows.join(active.distinct().withColumn("_active", F.lit(True)), "job_id", "left")

    def of_type(kind: str) -> Column:
        return F.sum(F.when(F.col("_active") & F.col("_seen"), (F.col("location_type") == kind).cast("bigint"))).alias(f"{kind}_jobs")

    days = flagged.groupBy("snapshot_date").agg(
        F.max("_seen").alias("_captured"), *[of_type(k) for k in ("remote", "office", "hybrid")],
        F.avg(F.when(F.col("_active"), F.col("_pay"))).alias("avg_salary_pln")).filter("_captured")
    median = upper_median(salaries.select("snapshot_date", "salary_avg"), ["snapshot_date"], "salary_avg", "median_salary_pln")
    # A sum over no active posting at all is null, a sum over none that day is zero.
    none = F.when(total > 0, F.lit(0).cast("bigint"))
    return (
        days.join(median, "snapshot_date", "left")
        .select(
            F.col("snapshot_date").alias("metric_date"), total.alias("total_jobs"),
            *[F.coalesce(c, none).alias(c) for c in ("remote_jobs", "office_jobs", "hybrid_jobs")],
            "avg_salary_pln", "median_salary_pln", total.alias("jobs_scraped"))
    )


def metrics_of_days(seen: DataFrame, salaries: DataFrame) -> DataFrame:
    """M1 + M2 for each day as it was at its end: the ads of the day are the active ones."""
    counts = seen.groupBy("snapshot_date").agg(
        F.count_distinct("job_id").alias("total_jobs"), _type_count("remote"), _type_count("office"), _type_count("hybrid"))
    pay = salaries.join(seen.select("job_id", "snapshot_date"), ["job_id", "snapshot_date"], "left_semi").groupBy("snapshot_date").agg(
        F.avg("salary_avg").alias("avg_salary_pln"))
    median = upper_median(salaries.select("snapshot_date", "salary_avg"), ["snapshot_date"], "salary_avg", "median_salary_pln")
    return counts.join(pay, "snapshot_date", "left").join(median, "snapshot_date", "left").select(
        F.col("snapshot_date").alias("metric_date"), "total_jobs", "remote_jobs", "office_jobs", "hybrid_jobs",
        "avg_salary_pln", "median_salary_pln", F.col("total_jobs").alias("jobs_scraped"))


def upsert_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """M3: new rows replace old ones of the same date."""
    return old.join(new.select("metric_date"), "metric_date", "left_anti").unionByName(new)
