"""Product and ad-hoc queries."""

from pyspark.sql import DataFrame, Window, functions as F

from adlake import schema
from adlake.functions.text import percent
from adlake.plans.filters import _date, active, in_pln, in_range, top

_DAY = ["job_id", "snapshot_date"]


def _one() -> F.Column:
    return F.count(F.lit(1))


def active_jobs(t, date_from=None, date_to=None) -> DataFrame:
    """M4: active postings with snapshots and pay; a date range drops postings without a snapshot in it."""
    postings = active(t["job_postings"]).select("job_id", "title", "company_name", "url", "first_seen_date", "last_seen_date")
    snaps = in_range(t["job_snapshots"], date_from, date_to).select(
        *_DAY, "location_type", "city", "region", "seniority_level", "employment_type")
    pay = t["salaries"].select(*_DAY, "salary_min", "salary_max", "salary_avg", "currency", "period", "is_b2b")
    ranged = date_from is not None or date_to is not None
    return postings.join(snaps, "job_id", "inner" if ranged else "left").join(pay, _DAY, "left").select(
        "job_id", "title", "company_name", "url", "first_seen_date", "last_seen_date", "snapshot_date",
        "location_type", "city", "region", "seniority_level", "employment_type",
        "salary_min", "salary_max", "salary_avg", "currency", "period", "is_b2b",
    )


def active_jobs_ordered(t, date_from=None, date_to=None) -> DataFrame:
    """M4 with its display order; the charts use the unordered form and skip the sort."""
    return active_jobs(t, date_from, date_to).orderBy(F.desc("first_seen_date"), "job_id", "snapshot_date")


def salary_data(t, date_from=None, date_to=None) -> DataFrame:
    """M5: pay in PLN of active postings with level and city."""
    pay = in_range(in_pln(t["salaries"]), date_from, date_to).select(
        *_DAY, "salary_min", "salary_max", "salary_avg", "currency", "is_b2b")
    postings = active(t["job_postings"]).select("job_id", "title")
    snaps = in_range(t["job_snapshots"], date_from, date_to).select(*_DAY, "seniority_level", "city")
    return pay.join(postings, "job_id").join(snaps, _DAY).select(
        "snapshot_date", "salary_min", "salary_max", "salary_avg", "currency", "is_b2b", "title", "seniority_level", "city")


def pln_salaries(t, date_from=None, date_to=None) -> DataFrame:
    """M5 cut to day and amount, for the charts that use nothing else."""
    pay = in_range(in_pln(t["salaries"]), date_from, date_to).select(*_DAY, "salary_avg")
    return (
        pay.join(active(t["job_postings"]).select("job_id"), "job_id")
        .join(in_range(t["job_snapshots"], date_from, date_to).select(*_DAY), _DAY).select("snapshot_date", "salary_avg"))


def _active_links(t, date_from=None, date_to=None) -> DataFrame:
    links = in_range(t["job_technologies"], date_from, date_to).select("job_id", "technology_id", "snapshot_date")
    return links.join(active(t["job_postings"]).select("job_id"), "job_id")


def _with_names(counted: DataFrame, t) -> DataFrame:
    """Names are joined to the counts, not to the links: far fewer rows carry strings."""
    names = t["technologies"].select("technology_id", F.col("name").alias("technology"), "category")
    return counted.join(names, "technology_id")


def technology_data(t, date_from=None, date_to=None) -> DataFrame:
    """M6: distinct active jobs per technology and day."""
    counted = _active_links(t, date_from, date_to).groupBy("technology_id", "snapshot_date").agg(
        F.count_distinct("job_id").alias("job_count"))
    return _with_names(counted, t).select("technology", "category", "snapshot_date", "job_count")


def location_data(t, date_from=None, date_to=None) -> DataFrame:
    """M7: distinct active jobs per day, type, city and region; null groups kept."""
    snaps = in_range(t["job_snapshots"], date_from, date_to).select(*_DAY, "location_type", "city", "region")
    return snaps.join(active(t["job_postings"]).select("job_id"), "job_id").groupBy(
        "snapshot_date", "location_type", "city", "region").agg(F.count_distinct("job_id").alias("job_count"))


def salary_by_technology(t, top_n: int = 20) -> DataFrame:
    """M8: pay in PLN by technology; the mean is over ad-days, at least two jobs."""
    pay = in_pln(t["salaries"]).select(*_DAY, "salary_min", "salary_max", "salary_avg")
    counted = (
        _active_links(t).join(pay, _DAY).groupBy("technology_id").agg(
            F.count_distinct("job_id").alias("job_count"), F.avg("salary_avg").alias("avg_salary"),
            F.min("salary_min").alias("min_salary"), F.max("salary_max").alias("max_salary"))
        .filter("job_count >= 2"))
    return top(_with_names(counted, t).select(
        "technology", "category", "job_count", "avg_salary", "min_salary", "max_salary"), top_n, "job_count", "technology")


def recent_daily_metrics(t, as_of, days: int = 90) -> DataFrame:
    """M9."""
    return t["daily_metrics"].filter(F.col("metric_date") >= F.date_sub(_date(as_of), days)).select(
        "metric_date", "total_jobs", "remote_jobs", "office_jobs", "hybrid_jobs", "avg_salary_pln", "median_salary_pln",
    ).orderBy("metric_date")


def _newest(table: DataFrame) -> DataFrame:
    """Rows of the table's own latest day."""
    return table.filter(F.col("snapshot_date") == table.agg(F.max("snapshot_date")).scalar())


def kpi_total(t) -> DataFrame:
    """M10."""
    return active(t["job_postings"]).agg(_one().alias("total_jobs"))


def kpi_average_salary(t) -> DataFrame:
    """M11."""
    pay = in_pln(_newest(t["salaries"])).select("job_id", "salary_avg")
    return pay.join(active(t["job_postings"]).select("job_id"), "job_id").agg(
        F.coalesce(F.avg("salary_avg"), F.lit(0.0).cast("double")).alias("avg_salary"))


def kpi_remote_share(t) -> DataFrame:
    """M12."""
    snaps = _newest(t["job_snapshots"]).select("job_id", "location_type")
    remote = F.count_if(F.col("location_type") == "remote")
    return snaps.join(active(t["job_postings"]).select("job_id"), "job_id").agg(
        F.coalesce(percent(remote, _one()), F.lit(0.0).cast("double")).alias("remote_pct"))


def kpi_top_technology(t) -> DataFrame:
    """No row when there is no link."""
    links = _newest(t["job_technologies"]).select("job_id", "technology_id")
    counted = links.join(active(t["job_postings"]).select("job_id"), "job_id").groupBy("technology_id").agg(_one().alias("n"))
    return top(_with_names(counted, t), 1, "n", "technology").select(F.col("technology").alias("top_technology"))


def kpi_metrics(t) -> DataFrame:
    """The four indicators as one row."""
    return kpi_total(t).select(
        "total_jobs",
        kpi_average_salary(t).scalar().alias("avg_salary"),
        kpi_remote_share(t).scalar().alias("remote_pct"),
        F.coalesce(kpi_top_technology(t).scalar(), F.lit("N/A")).alias("top_technology"))


def technology_trends(t, technologies: list[str], as_of, days: int = 30) -> DataFrame:
    """Distinct active jobs per listed technology and day."""
    # At most one row per listed name.
    names = F.broadcast(t["technologies"].filter(F.col("name").isin(list(technologies))).select(
        "technology_id", F.col("name").alias("technology")))
    return _active_links(t, date_from=F.date_sub(_date(as_of), days)).join(names, "technology_id").groupBy(
        "technology", "snapshot_date").agg(F.count_distinct("job_id").alias("job_count")).orderBy("snapshot_date", "technology")


def last_run(t) -> DataFrame:
    """The newest run of any status, or the defaults of a store without runs."""
    newest = t["scrape_runs"].orderBy(F.desc("run_date")).limit(1).select(
        F.date_format("run_date", "yyyy-MM-dd HH:mm:ss").alias("last_update"), "jobs_found", "jobs_new", "status")
    never = newest.sparkSession.range(1).select(
        F.lit("Never").alias("last_update"), F.lit(0).cast("bigint").alias("jobs_found"),
        F.lit(0).cast("bigint").alias("jobs_new"), F.lit("unknown").alias("status"))
    return newest.unionByName(never.filter(~newest.exists()))


def last_success(t) -> DataFrame:
    """Time of the newest successful run, null without one."""
    return t["scrape_runs"].filter("status = 'success'").agg(F.max("run_date").alias("run_date"))


def table_counts(t) -> DataFrame:
    """One row per table."""
    counts = [t[name].agg(_one().alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name in schema.TABLES]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


def store_totals(t) -> DataFrame:
    """M19."""
    return t["job_postings"].agg(_one().alias("total_jobs"), F.count_if("is_active").alias("active_jobs")).select(
        "*", t["technologies"].agg(_one()).scalar().alias("technologies"),
        t["job_snapshots"].agg(_one()).scalar().alias("snapshots"))


def jobs_by_city(t, top_n: int = 10) -> DataFrame:
    """Snapshots per city, the null city included."""
    return t["job_snapshots"].groupBy("city").agg(_one().alias("count")).orderBy(
        F.desc("count"), F.asc_nulls_first("city")).limit(top_n)


def average_salary_by_technology(t, top_n: int = 10) -> DataFrame:
    """Links and pay meet on the job alone, so every link day counts every pay day of the job.

    The mean of that product needs no product: per job, each technology's link days weigh the job's pay sum
    and count. Both sides are reduced to one row per key before they meet.
    """
    pay = t["salaries"].groupBy("job_id").agg(
        F.sum("salary_avg").alias("_sum"), F.count("salary_avg").alias("_n"), _one().alias("_rows"))
    links = t["job_technologies"].groupBy("job_id", "technology_id").agg(_one().alias("_links"))
    counted = links.join(pay, "job_id").groupBy("technology_id").agg(
        F.sum(F.col("_links") * F.col("_sum")).alias("_total"), F.sum(F.col("_links") * F.col("_n")).alias("_of"),
        F.sum(F.col("_links") * F.col("_rows")).alias("jobs"))
    named = _with_names(counted, t).select(
        F.col("technology").alias("name"), F.try_divide("_total", "_of").alias("avg_salary"), "jobs")
    return top(named, top_n, "avg_salary", "name")


def location_share(t) -> DataFrame:
    """Share of snapshots per location type, the null type included."""
    counted = t["job_snapshots"].groupBy("location_type").agg(_one().alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(F.lit(1)))  # over one row per type
    return counted.select("location_type", percent(F.col("_n"), total).alias("percentage"))


def technology_trend_recent(t, as_of, days: int = 7) -> DataFrame:
    """Links per technology and day, all postings."""
    counted = in_range(t["job_technologies"], F.date_sub(_date(as_of), days)).groupBy(
        "technology_id", "snapshot_date").agg(_one().alias("job_count"))
    return _with_names(counted, t).select(F.col("technology").alias("name"), "snapshot_date", "job_count").orderBy(
        "snapshot_date", F.desc("job_count"), "name")


def best_paid_jobs(t, top_n: int = 10) -> DataFrame:
    """Snapshots and pay meet on the job alone, so equal rows repeat.

    Both sides are reduced to distinct (job, city) and (job, amount) with their counts first; the repeats are
    written out only for the rows that made the cut.
    """
    pay = in_pln(t["salaries"]).groupBy("job_id", "salary_avg").agg(_one().alias("_pays"))
    places = t["job_snapshots"].groupBy("job_id", "city").agg(_one().alias("_snaps"))
    order = [F.desc("salary_avg"), F.asc("title"), F.asc_nulls_first("city")]
    best = (
        active(t["job_postings"]).select("job_id", "title").join(pay, "job_id").join(places, "job_id")
        .withColumn("_copies", F.least(F.col("_pays") * F.col("_snaps"), F.lit(top_n).cast("bigint")))
        .select("title", "salary_avg", "city", "_copies").orderBy(*order).limit(top_n))
    return best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies"))).select(
        "title", "salary_avg", "city").orderBy(*order).limit(top_n)


def aggregate_preview(t) -> DataFrame:
    """Like the daily metrics, but without the day: postings meet all their snapshots and pay rows.

    Snapshots and pay of a job are counted per job first, so the many-to-many product is never built.
    """
    kinds = ("remote", "office", "hybrid")
    snaps = t["job_snapshots"].groupBy("job_id").agg(
        _one().alias("_snaps"), *[F.count_if(F.col("location_type") == k).alias(f"_{k}") for k in kinds])
    pay = t["salaries"].groupBy("job_id").agg(
        F.sum("salary_avg").alias("_sum"), F.count("salary_avg").alias("_n"), _one().alias("_rows"))
    # A missing side of a left join still gives one row.
    pay_rows, snap_rows = F.coalesce("_rows", F.lit(1)), F.coalesce("_snaps", F.lit(1))
    return (
        active(t["job_postings"]).select("job_id").join(snaps, "job_id", "left").join(pay, "job_id", "left").agg(
            F.count_distinct("job_id").alias("total_jobs"),
            *[F.coalesce(F.sum(F.coalesce(F.col(f"_{k}"), F.lit(0)) * pay_rows), F.lit(0)).alias(f"{k}_jobs") for k in kinds],
            F.try_divide(F.sum(F.col("_sum") * snap_rows), F.sum(F.col("_n") * snap_rows)).alias("avg_salary")))


def technology_popularity(t) -> DataFrame:
    """Links and required links per technology; technologies without links kept."""
    counted = t["job_technologies"].groupBy("technology_id").agg(
        F.count("job_id").alias("_jobs"), F.count_if(F.col("proficiency_level") == "required").alias("_required"))
    zero = F.lit(0).cast("bigint")
    return t["technologies"].join(counted, "technology_id", "left").select(
        "name", "category", F.coalesce("_jobs", zero).alias("job_count"), F.coalesce("_required", zero).alias("required_count"))


def technologies_of_job(t, job_id: str) -> DataFrame:
    """A job's technologies with proficiency, one row per link."""
    links = t["job_technologies"].filter(F.col("job_id") == job_id).select("technology_id", "proficiency_level")
    return links.join(t["technologies"], "technology_id").select("name", "category", "proficiency_level").orderBy("name")
