"""Loads, from raw ads of one day or many to the store."""

import time

from pyspark.sql import Column, DataFrame, functions as F

from adlake.operators import load, metrics
from adlake.operators.extract import only_listed, records, with_reason, without_fields
from adlake.operators.transform import categorised, normalise, technology_rows
from adlake.session import staged
from adlake.sources.raw import scrape_run
from adlake.sources.store import JobStore

_KEY = ["job_id", "snapshot_date"]
_SNAPSHOT = ["description", "requirements", "location_type", "city", "region", "country", "seniority_level", "employment_type"]
_PAY = ["currency", "salary_min", "salary_max", "salary_avg", "period", "is_b2b"]


def prepare(raw: DataFrame, snapshot_date: Column, cities: Column | None = None, lists: dict | None = None,
            judged: bool = False, **fields: bool) -> DataFrame:
    """Accepted ads as flat normalised rows, with ``seq`` for their order and their day.

    ``lists`` keeps ads whose column has one of the listed values; ``fields`` switches fields off (salary=False); ``judged`` ads
    have been accepted already.
    """
    ordered = raw if "seq" in raw.columns else raw.withColumn("seq", F.monotonically_increasing_id())
    wanted = without_fields(only_listed(ordered, **(lists or {})), **fields)
    return normalise(records(wanted, snapshot_date, judged), cities).withColumn("snapshot_date", F.col("first_seen_date"))


def load_days(store: JobStore, raw: DataFrame, day: Column, now: Column | None = None, complete: bool = True, **options) -> DataFrame:
    """Merge ads of any number of days into the store in one pass. Returns the statistics row.

    ``day`` is the ads' day, a column or a literal. All tables change together when everything has been computed:
    postings, snapshots, pay, technologies, links, the metrics of the touched days, and the refused ads with their
    reasons in ``rejects``; ``errors`` counts those. ``complete=False`` is for days that arrive in pieces. Repeating
    a load changes nothing but the timestamps.
    """
    now = F.current_timestamp() if now is None else now
    judged = with_reason(raw if "seq" in raw.columns else raw.withColumn("seq", F.monotonically_increasing_id()))
    judged = judged.withColumn("snapshot_date", day.cast("date"))
    with staged(judged) as ads, store.change() as change:
        days = ads.select("snapshot_date").distinct()
        refused = ads.filter("reason IS NOT NULL")
        change.replace("rejects", refused.select(*store.table("rejects").columns), days)
        with staged(prepare(ads.filter("reason IS NULL").drop("reason"), F.col("snapshot_date"), judged=True, **options)) as batch:
            statistics = _merge(store, change, batch, days, now, complete)
            statistics = statistics.withColumn("errors", refused.agg(F.count(F.lit(1))).scalar())
            out = store.spark.createDataFrame([statistics.first()], statistics.schema)
    return out


def _merge(store: JobStore, change, batch: DataFrame, days: DataFrame, now: Column, complete: bool):
    postings = load.merge_postings(store.table("job_postings"), batch.select(*_KEY, "title", "company_name", "url", "seq"), now, complete)
    with staged(postings) as merged:
        store.settle_buckets(merged)
        # Buckets in which nothing happened stay as they are.
        hit = merged.filter("change <> 'kept'").select(store.bucket_of().alias("bucket")).distinct()
        fresh = merged.withColumn("bucket", store.bucket_of()).join(F.broadcast(hit), "bucket", "left_semi")
        change.replace("job_postings", fresh.select(*store.table("job_postings").columns))
        active = merged.filter("is_active").select("job_id")

        last = load.last_per_key(batch.select(*_KEY, "seq", *_SNAPSHOT), _KEY, "seq").drop("seq")
        snapshots = change.replace("job_snapshots", load.replace_by_key(store.days_of("job_snapshots", days), last, _KEY))
        pay = load.last_per_key(batch.filter("salary_min IS NOT NULL").select(*_KEY, "seq", *_PAY), _KEY, "seq").drop("seq")
        salaries = change.replace("salaries", load.replace_by_key(store.days_of("salaries", days), pay, _KEY))

        dimension, named = store.table("technologies"), technology_rows(batch)
        new = change.append("technologies", load.new_technologies(dimension, categorised(named.select("name").distinct()), "name"))
        links = load.technology_links(named, dimension.unionByName(new))
        change.replace("job_technologies", load.insert_or_ignore(
            store.days_of("job_technologies", days), links, ["job_id", "technology_id", "snapshot_date"]))

        # On the newest day the postings tell who is active; an earlier day is closed with all ads it saw.
        newest = merged.agg(F.max("last_seen_date")).scalar()
        still = active.withColumn("_active", F.lit(True))
        seen = snapshots.join(still, "job_id", "left").filter((F.col("snapshot_date") < newest) | F.col("_active"))
        change.replace("daily_metrics", metrics.metrics_of_days(seen, salaries))
        statistics = load.load_statistics(merged, new.agg(F.count(F.lit(1))).scalar(), F.lit(0).cast("bigint"))
        return store.spark.createDataFrame([statistics.first()], statistics.schema)


def load_day(store: JobStore, raw: DataFrame, snapshot_date, now: Column | None = None, **options) -> DataFrame:
    """L1 for one complete capture."""
    return load_days(store, raw, F.lit(snapshot_date), now, **options)


def run_day(store: JobStore, raw: DataFrame, snapshot_date) -> DataFrame:
    """The daily run: load and log it (S9), as partial when the capture was empty, as failed when the load was."""
    started = time.monotonic()
    now = F.current_timestamp()
    try:
        found = raw.count()
        statistics = load_day(store, raw, snapshot_date).first()
    except Exception as error:
        store.append_run(scrape_run(store.spark, now, status="failed", error_message=str(error),
                                    duration_seconds=time.monotonic() - started))
        raise
    run = scrape_run(store.spark, now, found, statistics.jobs_new, statistics.jobs_updated, statistics.jobs_expired,
                     duration_seconds=time.monotonic() - started)
    store.append_run(run)
    return run


def backfill(store: JobStore, dated_ads: DataFrame, **options) -> DataFrame:
    """Load a frame with a snapshot_date column; the number of jobs does not depend on the number of days."""
    return load_days(store, dated_ads.withColumnRenamed("snapshot_date", "_day"), F.col("_day"), **options)
