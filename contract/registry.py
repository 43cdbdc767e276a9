"""One Spark query per operator, each over whole tables."""

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from adlake import fixed_values as fv
from adlake.functions import keys, labels, pay, place, text
from adlake.operators import extract, lifecycle, load, maintain, metrics, pages
from adlake.operators.ranks import upper_median
from adlake.plans import marts, queries
from adlake.operators import daily, transform
from adlake.plans.filters import preset_range
from adlake.operators import lookup, rollups
from adlake.session import scratch_root
from adlake.sources.json_array import read_array
from adlake.sources.star import StarHistory, _level_word, raw_ads as order_ads
from adlake.sources.store import CatalogTables, JobStore, create_tables, drop_tables, insert_rows
from adlake.streaming.run_log import DayLog
from contract.job_pages import job_pages

TREND_NAMES = ["cold widget", "red bolt", "small ring", "no such part"]
TREND_DAYS = 180
PAIR_NAME = "cold widget"
ONE_JOB = "job-1"
# The invented prose holds no job words, so the keyword search is run on common words of its languages.
PROSE_WORDS = ["the", "of", "and", "que", "de", "und", "der", "für", "les", "ón", "The", "st.", ".I"]

_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Dates as text and doubles rounded, so that two engines can be compared value by value."""
    out = []
    for field in df.schema:
        kind, column = field.dataType.simpleString(), F.col(field.name)
        if kind in ("date", "timestamp", "timestamp_ntz"):
            column = column.cast("string") if kind == "date" else F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif kind == "double":
            column = F.round(column, 4)
        elif kind == "array<string>":
            column = F.array_join(column, ",")
        out.append(column.alias(field.name))
    return df.select(*out)


def _register(function):
    name = function.__name__

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _plain(function(StarHistory(spark, folder)))

    run.__name__ = name
    _REGISTRY[name] = run
    return function


def queries_by_name() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_REGISTRY)


def _ask(name: str, question, **params) -> None:
    def run(t):
        return question(t, **params)

    run.__name__ = name
    _register(run)


# --- product and ad-hoc queries, chart tables --------------------------------

_ask("salary_by_technology", queries.salary_by_technology)
_ask("active_jobs", queries.active_jobs)
_ask("salary_data", queries.salary_data)
_ask("technology_data", queries.technology_data)
_ask("location_data", queries.location_data)
_ask("kpi_total", queries.kpi_total)
_ask("kpi_average_salary", queries.kpi_average_salary)
_ask("kpi_top_technology", queries.kpi_top_technology)
_ask("kpi_metrics", queries.kpi_metrics)
_ask("last_run", queries.last_run)
_ask("last_success", queries.last_success)
_ask("table_counts", queries.table_counts)
_ask("store_totals", queries.store_totals)
_ask("jobs_by_city_adhoc", queries.jobs_by_city)
_ask("avg_salary_by_tech_adhoc", queries.average_salary_by_technology)
_ask("location_share", queries.location_share)
_ask("best_paid_jobs", queries.best_paid_jobs)
_ask("aggregate_preview", queries.aggregate_preview)
_ask("tech_popularity", queries.technology_popularity)
_ask("job_technologies_of", queries.technologies_of_job, job_id=ONE_JOB)
_ask("salary_histogram", marts.salary_histogram)
_ask("salary_by_top_technology", marts.salary_by_top_technology)
_ask("salary_trend", marts.salary_trend)
_ask("salary_by_seniority", marts.salary_by_seniority)
_ask("salary_by_location_type", marts.salary_by_location_type)
_ask("salary_summary", marts.salary_summary)
_ask("top_technologies", marts.top_technologies)
_ask("top_technology_trends", marts.top_technology_trends)
_ask("technology_categories", marts.technology_categories)
_ask("top_per_category", marts.top_per_category)
_ask("co_occurrence", marts.co_occurrence, technology=PAIR_NAME)
_ask("technology_summary", marts.technology_summary)
_ask("demand_heatmap", marts.demand_heatmap)
_ask("city_top", marts.city_top)
_ask("location_type_distribution", marts.location_type_distribution)
_ask("location_type_trend", marts.location_type_trend)
_ask("regional_comparison", marts.regional_comparison)
_ask("city_by_location_type", marts.city_by_location_type)
_ask("location_summary", marts.location_summary)
_ask("remote_share_trend", marts.remote_share_trend)
_ask("best_paying_technologies", marts.best_paying_technologies)
_ask("overview_counts", marts.overview_counts)
_ask("recent_postings", marts.recent_postings)


@_register
def active_jobs_in_range(t):
    """M4 + F8/F9: the last 90 days of the history."""
    return queries.active_jobs(t.recent(90), F.date_sub(t.latest, 90), t.latest)


@_register
def technology_trends(t):
    return queries.technology_trends(t.recent(TREND_DAYS), TREND_NAMES, t.latest, TREND_DAYS)


@_register
def tech_trend_7d(t):
    return queries.technology_trend_recent(t.recent(7), t.latest)


@_register
def daily_metrics(t):
    return metrics.metrics_by_date(t.job_postings, t.job_snapshots, t.salaries)


@_register
def daily_metrics_latest(t):
    """M1 + M2 as the loader computes them, for the newest day."""
    newest = t.recent(0)
    return metrics.daily_metrics(t.job_postings, newest.job_snapshots, newest.salaries, t.latest)


@_register
def recent_daily_metrics(t):
    """M9."""
    return queries.recent_daily_metrics(t.recent(TREND_DAYS), t.latest, TREND_DAYS)


@_register
def upper_median_by_date(t):
    """M2."""
    return upper_median(t.salaries, ["snapshot_date"], "salary_avg", "median_salary")


@_register
def kpi_remote_share(t):
    """Every order gives a snapshot, so the newest day of the table is the newest month."""
    return queries.kpi_remote_share(t.recent(0))


# --- normalisation -----------------------------------------------------------

@_register
def parse_salary(t):
    return pay.with_pay(t.salary_texts, "salary_text")


@_register
def parse_salary_prose(t):
    """N1-N4 on texts that were never meant as pay."""
    return pay.with_pay(t.read("documents").select("doc_id", "text"), "text").drop("text").filter("salary_min IS NOT NULL")


@_register
def standardize_location(t):
    placed = place.with_place(t.with_location(t.kept_orders), "location_text", t.cities)
    return placed.select("job_id", "snapshot_date", "location_text", "location_type", "city", "region", "country")


@_register
def categorize_technology(t):
    """N6 on every distinct word of the documents and every part name."""
    words = t.read("documents").select(F.explode(F.split("text", "[ \n]")).alias("name")).filter("name <> ''")
    names = words.union(t.read("part").select("p_name")).distinct()
    return names.withColumn("category", labels.technology_category(F.col("name")))


@_register
def normalize_seniority(t):
    """N7 on the level words of all orders; N8 on the titles made of them."""
    ads = t.with_ad_text(t.monthly_orders)
    word = _level_word(F.col("o_orderstatus"))
    return ads.groupBy(word.alias("word"), "title").agg(F.count(F.lit(1)).alias("ads")).select(
        "word", "title", "ads", labels.seniority_level(F.col("word")).alias("seniority_level"),
        labels.seniority_level(F.col("title")).alias("title_level"))


@_register
def detect_seniority(t):
    """X11 with the first line of a document as the heading."""
    return t.read("documents").select(
        "doc_id", labels.detect_seniority(F.substring_index("text", "\n", 1), F.col("text")).alias("seniority"))


@_register
def clean_text(t):
    return t.read("documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@_register
def truncate_description(t):
    return t.read("documents").select("doc_id", text.truncate_description(F.col("text"), fv.MAX_TEXT).alias("description"))


@_register
def keyword_extract(t):
    return t.read("documents").select("doc_id", text.find_keywords(F.col("text"), PROSE_WORDS).alias("keywords"))


@_register
def employment_type(t):
    return t.read("documents").select("doc_id", text.employment_type(F.col("text")).alias("employment_type"))


# --- validation --------------------------------------------------------------

def raw_ads(t) -> DataFrame:
    """Documents as raw ads: the quality label decides the URL, the toxic label the company."""
    marked = t.read("documents").join(t.read("labels"), "doc_id", "left")
    doc = F.col("doc_id").cast("string")
    return marked.select(
        F.when(F.col("quality") == 1, F.concat(F.lit("http://ads.example/"), doc))
        .when(F.col("quality") == 0, F.concat(F.lit("ftp://ads.example/"), doc)).alias("url"),
        doc.alias("job_id"), F.col("text").alias("title"),
        F.when(F.col("toxic") == 1, "x").otherwise(F.col("source")).alias("company_name"),
        F.col("text").alias("description"), F.lit(None).cast("string").alias("requirements"),
        F.lit(None).cast("string").alias("salary"), F.col("lang").alias("location"),
        F.lit(None).cast("array<string>").alias("technologies"), F.lit(None).cast("string").alias("seniority"),
        F.lit(None).cast("string").alias("employment_type"))


@_register
def validate_records(t):
    return extract.with_reason(raw_ads(t)).select("job_id", F.coalesce("reason", F.lit("accepted")).alias("reason"))


@_register
def reject_counts(t):
    return extract.reject_counts(raw_ads(t))


@_register
def job_key(t):
    """X2 and F6 on page URLs and on posting URLs."""
    urls = t.read("pages").select("url").union(t.job_postings.select("url"))
    nothing = F.lit(None).cast("string")
    return urls.select(
        "url", keys.job_key_from_url(F.col("url")).alias("url_key"),
        keys.job_key(nothing, F.col("url"), F.lit("title"), nothing).alias("job_key"))


# --- pages -------------------------------------------------------------------

@_register
def page_links(t):
    """X1; these pages have no /job/ links, so every rooted link counts."""
    return pages.page_links(t.read("pages"), "/")


@_register
def page_unique_urls(t):
    return pages.unique_urls(page_links(t))


@_register
def capped_urls(t):
    return pages.capped(page_unique_urls(t))


@_register
def page_title(t):
    return t.read("pages").select("page_id", pages.page_title(F.col("html")).alias("title"))


@_register
def next_page(t):
    return t.read("pages").select("page_id", pages.has_next_page(F.col("html")).alias("has_next"))


@_register
def page_records(t):
    """X13."""
    return pages.parse_details(t.read("pages"), PROSE_WORDS)


@_register
def job_page_records(t):
    """X2-X13 on pages whose fields come from customers; the default keyword list."""
    return pages.parse_details(job_pages(t))


@_register
def job_page_outlines(t):
    """X2-X13 on the same pages, without a Python worker."""
    return pages.parse_details(job_pages(t), python=False)


@_register
def job_next_page(t):
    """X14."""
    return job_pages(t).select("page_id", pages.has_next_page(F.col("html")).alias("has_next"))


@_register
def normalised_ads(t):
    """F1-F5, N1-N8, N12 on the ads of those pages; the default city list."""
    ads = daily.prepare(pages.parse_details(job_pages(t)), F.to_date(F.lit("2026-01-05")))
    return ads.select("job_id", "title", "company_name", "first_seen_date", "snapshot_date", "is_active", "description", "location_type",
                      "city", "region", "country", "seniority_level", "employment_type", "currency", "salary_min", "salary_max", "period")


@_register
def listed_ads(t):
    """Ads of listed levels, with pay and technologies switched off."""
    ads = extract.only_listed(pages.parse_details(job_pages(t)), seniority=["senior", "junior"], location=[])
    return extract.without_fields(ads, skills=False, salary=False).select("job_id", "salary", "technologies", "description")


@_register
def extracted_records(t):
    """F4 on the documents as ads."""
    rows = extract.records(raw_ads(t), F.to_date(F.lit("2026-01-05")))
    return rows.select("job_posting.job_id", "job_posting.company_name", "job_posting.first_seen_date", "job_posting.is_active",
                       F.col("snapshot.location").alias("location"), F.size("technologies").alias("n_technologies"))


@_register
def technology_rows(t):
    """N11 on part names taken apart."""
    ads = t.read("part").select(F.col("p_partkey").cast("string").alias("job_id"), F.split("p_name", " ").alias("technologies"))
    return transform.categorised(transform.technology_rows(ads))


@_register
def preset_jobs(t):
    """the last 30 days as the named range gives them."""
    start, end = preset_range("Last 30 days", t.latest)
    return queries.active_jobs(t.recent(30), start, end).select("job_id", "snapshot_date", "city", "salary_avg")


@_register
def dashboard_rows(t):
    """Rows of each frame of the dashboard."""
    out = None
    for name, frame in marts.dashboard(t).items():
        one = frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("frame"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@_register
def listing_prefix(t):
    """X15 on events as listing pages: run = user, order = time, stop = an error event; numbers only for what is kept."""
    kept = pages.listing_prefix(t.listing, "run_id", "place", F.col("stop"))
    order = Window.partitionBy("run_id").orderBy("place")
    return kept.select("run_id", F.row_number().over(order).alias("page"), "place.event_id", "stop")


@_register
def capture_statistics(t):
    """X18 over all pages as listing and as detail pages."""
    listing = t.read("pages").select("page_id").join(
        page_links(t).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links")), "page_id", "left").na.fill(0)
    return pages.capture_statistics(listing, t.read("pages"), pages.parse_details(t.read("pages")))


# --- load: the history before the latest month meets the latest month ---------

def _months(t) -> tuple[DataFrame, DataFrame]:
    """(kept orders before the latest month, all orders of the latest month, copies included)."""
    return (t.kept_orders.filter(F.col("snapshot_date") < t.latest),
            t.monthly_orders.filter(F.col("snapshot_date") == t.latest))


def _old_postings(t) -> DataFrame:
    before, _ = _months(t)
    return t.postings_of(before, before.agg(F.max("snapshot_date")).scalar())


def _batch_ads(t) -> DataFrame:
    _, batch = _months(t)
    return _ads_of(t, batch)


def _ads_of(t, orders: DataFrame) -> DataFrame:
    return t.with_ad_text(orders).select("job_id", "title", "company_name", "url", "snapshot_date", F.col("o_orderkey").alias("seq"))


def _merged(old: DataFrame, batch: DataFrame) -> DataFrame:
    return load.merge_postings(old, batch, F.lit(None).cast("timestamp"))


def _merged_postings(t) -> DataFrame:
    return _merged(_old_postings(t), _batch_ads(t))


@_register
def posting_upsert(t):
    return _merged_postings(t).drop("created_at", "updated_at")


@_register
def load_statistics(t):
    """Technologies that a dimension without the ECONOMY parts lacks, refused documents as errors."""
    refused = extract.quarantined(raw_ads(t)).agg(F.count(F.lit(1))).scalar()
    return load.load_statistics(_merged_postings(t), technology_dimension(t).agg(F.count(F.lit(1))).scalar(), refused)


@_register
def load_with_rejects(t):
    """Documents as one capture; those with a clean label are known already, refused ones are counted."""
    day = F.to_date(F.lit("2026-01-05"))
    judged = extract.with_reason(raw_ads(t).withColumn("seq", F.col("job_id").cast("bigint")))
    ads = judged.filter("reason IS NULL").withColumn("snapshot_date", day)
    clean = t.read("labels").filter("toxic = 0").select(F.col("doc_id").cast("string").alias("job_id"))
    known = raw_ads(t).join(clean, "job_id", "left_semi").select(
        "job_id", "title", "company_name", "url", F.date_sub(day, 1).alias("first_seen_date"), F.date_sub(day, 1).alias("last_seen_date"),
        F.lit(True).alias("is_active"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    refused = judged.filter("reason IS NOT NULL").agg(F.count(F.lit(1))).scalar()
    return load.load_statistics(_merged(known, ads), F.lit(0).cast("bigint"), refused).drop("technologies_new")


@_register
def late_day(t):
    """The month before the newest one arrives last; the state is that of a load in order."""
    late = F.add_months(t.latest, -1)
    before = t.kept_orders.filter(F.col("snapshot_date") != late)
    arrives = t.monthly_orders.filter(F.col("snapshot_date") == late)
    return _merged(t.postings_of(before, t.latest), _ads_of(t, arrives)).select("job_id", "first_seen_date", "last_seen_date", "is_active")


@_register
def backfill_state(t):
    """All months loaded at once into an empty store."""
    nothing = t.job_postings.limit(0)
    return _merged(nothing, _ads_of(t, t.monthly_orders)).drop("created_at", "updated_at", "change", "copies")


@_register
def metrics_of_days(t):
    """M1-M3 for every month as it was at its end, as a backfill writes them."""
    return metrics.metrics_of_days(t.job_snapshots.select("job_id", "snapshot_date", "location_type"), t.salaries)


@_register
def metrics_upsert(t):
    """M3: the newest month's row, measured anew, replaces the one that is there."""
    old = metrics_of_days(t)
    again = old.filter(F.col("metric_date") == t.latest).withColumn("total_jobs", F.col("total_jobs") + 1)
    return metrics.upsert_metrics(old, again)


@_register
def expire_jobs(t):
    return load.expired(_old_postings(t), _batch_ads(t)).select("job_id", "last_seen_date")


def _copies(t, orders: DataFrame) -> DataFrame:
    return orders.select("*", F.concat(F.lit("job-"), F.col("o_custkey").cast("string")).alias("job_id"))


@_register
def snapshot_upsert(t):
    """L4: the latest month is loaded twice, first with each ad's first copy, then with all copies."""
    before, batch = _months(t)
    stale = load.first_per_key(batch, ["o_custkey", "snapshot_date"], "o_orderkey")
    fresh = load.last_per_key(batch, ["o_custkey", "snapshot_date"], "o_orderkey")
    stored = before.unionByName(_copies(t, stale).select(*before.columns))
    merged = load.replace_by_key(stored, _copies(t, fresh).select(*before.columns), ["job_id", "snapshot_date"])
    return t.snapshots_of(merged).drop("description", "requirements", "employment_type")


@_register
def salary_upsert(t):
    """As above, on pay; a day loaded twice still has one row per ad."""
    pay_rows = t.salaries
    again = pay_rows.filter(F.col("snapshot_date") == t.latest).withColumn("salary_min", F.col("salary_min") + 1)
    return load.replace_by_key(pay_rows, again, ["job_id", "snapshot_date"]).select(
        "job_id", "snapshot_date", "salary_min", "salary_max")


@_register
def technology_dimension(t):
    """Names that a dimension without the ECONOMY parts lacks."""
    part = t.read("part").select(F.col("p_name").alias("name"), F.col("p_type").alias("category"), "p_partkey")
    known = t.technologies.filter("category <> 'ECONOMY'")
    return load.new_technologies(known, part, "p_partkey").select("name", "category")


@_register
def technology_links(t):
    """Links of the first copies are stored, links of all copies come in."""
    _, batch = _months(t)
    all_links = t.links_of(_copies(t, batch))
    first = load.first_per_key(batch, ["o_custkey", "snapshot_date"], "o_orderkey")
    stored = t.links_of(_copies(t, first))
    merged = load.insert_or_ignore(stored, all_links, ["job_id", "technology_id", "snapshot_date"])
    return merged.join(t.technologies, "technology_id").select("job_id", "snapshot_date", "name", "proficiency_level")


@_register
def delete_jobs(t):
    """Snapshots after all inactive ads are deleted."""
    gone = t.job_postings.filter("NOT is_active")
    return load.without_keys(t.job_snapshots, gone).groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("rows"))


# --- maintenance and lifecycle -----------------------------------------------

@_register
def retention(t):
    return maintain.retained(t.recent(fv.RETENTION_DAYS).job_snapshots, t.latest).select("job_id", "snapshot_date", "city")


@_register
def fk_violations(t):
    """R2 on a store whose inactive postings and ECONOMY technologies are missing."""
    links = t.job_technologies.join(t.technologies, "technology_id").select("job_id", "name")
    tables = {
        "job_postings": t.job_postings.filter("is_active"), "job_snapshots": t.job_snapshots, "salaries": t.salaries,
        "technologies": t.technologies.filter("category <> 'ECONOMY'"), "job_technologies": links,
    }
    return maintain.foreign_key_violations(tables, [
        ("job_snapshots", "job_id", "job_postings", "job_id"), ("salaries", "job_id", "job_postings", "job_id"),
        ("job_technologies", "job_id", "job_postings", "job_id"), ("job_technologies", "name", "technologies", "name")])


@_register
def duplicate_keys(t):
    """R3 on orders before their copies are merged."""
    return maintain.duplicate_keys(_copies(t, t.monthly_orders), "job_snapshots")


@_register
def null_counts(t):
    """R4 where inactive postings have lost their URL and snapshots without a city their day."""
    tables = t.all()
    tables["job_postings"] = tables["job_postings"].withColumn("url", F.when(F.col("is_active"), F.col("url")))
    tables["job_snapshots"] = tables["job_snapshots"].withColumn("snapshot_date", F.when(F.col("city").isNotNull(), F.col("snapshot_date")))
    return maintain.null_counts(tables)


@_register
def lifecycle_of_jobs(t):
    return lifecycle.lifecycle(t.job_snapshots)


@_register
def active_spans(t):
    return lifecycle.active_spans(t.job_snapshots)


@_register
def merged_spans(t):
    """Spans from span sets to which the days of odd months come late, between those of even months."""
    late = F.month("snapshot_date") % 2 == 1
    none = t.job_snapshots.limit(0)
    no_spans = none.select("job_id", F.lit(None).cast("array<struct<span_start:date,span_end:date>>").alias("spans"))
    early = t.job_snapshots.filter(~late)
    held = lifecycle.merge_spans(no_spans, none, early)
    held = lifecycle.merge_spans(held, early, t.job_snapshots.filter(late))
    return lifecycle.spans_as_rows(held, t.job_snapshots)


# --- roll-ups per day, lookups as tables, arrays, streams ------------------------


@_register
def technology_jobs_range(t):
    """M6 over a range: distinct jobs per technology in the newest year, from the daily bitmaps."""
    days = rollups.technology_bitmaps(t).filter(F.col("snapshot_date") > F.add_months(t.latest, -12))
    return rollups.distinct_jobs(days, ["technology_id"]).join(t["technologies"], "technology_id").select(
        F.col("name").alias("technology"), "category", "job_count")


@_register
def technology_jobs_by_year(t):
    """M6 rolled up: distinct jobs per category and year; a job counts once however many technologies and days it has."""
    named = rollups.technology_bitmaps(t).join(t["technologies"], "technology_id")
    return rollups.distinct_jobs(named, ["category", F.year("snapshot_date").alias("year")])


@_register
def place_jobs_rollup(t):
    """Distinct jobs by quarter, in all and per region and type, from the same daily bitmaps."""
    daily_places = rollups.place_bitmaps(t)
    quarter = F.trunc("snapshot_date", "QUARTER").alias("quarter")
    fine = rollups.merged_bitmaps(daily_places, [quarter, "region", "location_type"])
    rows = rollups.distinct_jobs(fine, ["quarter", "region", "location_type"]).withColumn("grain", F.lit("place"))
    total = rollups.distinct_jobs(fine, ["quarter"]).withColumns({"region": F.lit(None).cast("string"), "location_type": F.lit(None).cast("string"), "grain": F.lit("all")})
    return rows.unionByName(total)


def _sketched(t, by):
    """Quartiles of pay from merged daily sketches, held against the exact ranks of the same rows."""
    pay = t["salaries"].filter("currency = 'PLN'").select("snapshot_date", "salary_avg")
    merged = rollups.merged_sketches(rollups.pay_sketches(pay, ["snapshot_date"]), [by.alias("span")])
    out = rollups.sketched_quantiles(merged, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    found = pay.withColumn("span", by).join(out.select("span", F.col("n").alias("_n"), "q1", "q2", "q3"), "span")
    # Where a value stands among the rows: the share below it, and the share up to it.
    shares = [e for q in ("q1", "q2", "q3") for e in (
        (F.count_if(F.col("salary_avg") < F.col(q)) / F.count(F.lit(1))).alias(f"{q}_below"), (F.count_if(F.col("salary_avg") <= F.col(q)) / F.count(F.lit(1))).alias(f"{q}_upto"))]
    ranks = found.groupBy("span").agg(*shares)
    # A sketch's bound holds for each quantile at 99 %; three of them per span, at twice the bound, leave no doubt.
    error = F.lit(2 * rollups.KLL_ERROR)
    within = [((F.col(f"{q}_below") <= r + error) & (F.col(f"{q}_upto") >= r - error)).alias(f"{q}_within") for q, r in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))]
    return out.join(ranks, "span").select("span", "n", "least", "most", *within)


@_register
def pay_quartiles_sketched(t):
    """Quartiles of pay per year from daily sketches; each is compared by whether its true rank is within the bound."""
    return _sketched(t, F.year("snapshot_date"))


@_register
def median_pay_sketched(t):
    """M2's opt-in: the same per month, where most sketches hold all of their values."""
    return _sketched(t, F.trunc("snapshot_date", "MONTH").cast("string"))


@_register
def standardize_location_table(t):
    """N5 by an indexed join with the lookup table: the rows of standardize_location."""
    lookup_table = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return lookup.with_place_from(t.with_location(t.kept_orders), "location_text", lookup_table, "n_nationkey", "n_name", "r_name").select(
        "job_id", "snapshot_date", "location_text", "location_type", "city", "region", "country")


@_register
def company_in_text(t):
    """N5's join with a lookup that grows: the first of all customers, by key, whose number stands in a page's path."""
    digits = F.regexp_extract("url", "([0-9]+)[^0-9]*$", 1)
    rows = t.read("pages").select("page_id", F.concat(F.lit("Customer#"), F.lpad(digits, 9, "0"), F.lit(" / Remote")).alias("text"))
    found = lookup.with_place_from(rows, "text", t.read("customer"), "c_custkey", "c_name", "c_mktsegment")
    return found.select("page_id", "location_type", "city", "region")


@_register
def technology_category_table(t):
    """N6 by an indexed join; the names of parts, and as lookup the parts' names without their first letter."""
    names = t.read("part").select(F.col("p_name").alias("name")).distinct()
    table = t.read("part").select(F.col("p_partkey").alias("pos"), F.expr("substring(p_name, 2)").alias("name"), F.col("p_type").alias("category"))
    return lookup.categorised_from(names, table)


@_register
def keyword_table(t):
    """X10 with a keyword list that is a table: every word of the benchmark items, and its first and last two words together."""
    words = F.split(F.lower("text"), " ")
    one = t.read("benchmark").select(F.explode(words).alias("keyword"))
    two = t.read("benchmark").select(F.explode(F.array(F.concat_ws(" ", F.slice(words, 1, 2)), F.concat_ws(" ", F.slice(words, -2, 2)))).alias("keyword"))
    listed = one.union(two).filter("keyword RLIKE '^[a-z]+( [a-z]+)?$'").distinct().select(F.crc32("keyword").alias("pos"), "keyword")
    found = lookup.keywords_from(t.read("documents"), "doc_id", "text", listed)
    return found.select("doc_id", F.size("keywords").alias("n"), F.array_join(F.array_sort("keywords"), ",").alias("keywords"))


def _scratch(t, name):
    return os.path.join(scratch_root(t.spark), f"{name}-{uuid.uuid4().hex}")


@_register
def capture_array(t):
    """Customers as ads in one JSON array per nation, written as it would be captured and read in byte ranges."""
    text = F.concat(F.lit('say "{x" \\\\ }, {'), "c_mktsegment", F.lit("}\n"), F.when(F.col("c_custkey") % 3 == 0, '"}').otherwise("{{"))
    ads = t.read("customer").select("c_nationkey", F.col("c_custkey").cast("long").alias("pos"), F.to_json(F.struct(
        F.concat(F.lit("job-"), "c_custkey").alias("job_id"), F.col("c_name").alias("company_name"), text.alias("title"),
        F.array(F.lit("a}"), F.lit("b")).alias("technologies"))).alias("value"))
    first = Window.partitionBy("c_nationkey").orderBy("pos")
    listed = ads.withColumn("value", F.concat(F.when(F.row_number().over(first) == 1, "").otherwise(", "), "value"))
    nations = t.read("nation").select(F.col("n_nationkey").alias("c_nationkey"))
    frame = listed.unionByName(nations.select("c_nationkey", F.lit(-1).cast("long").alias("pos"), F.lit("[").alias("value"))).unionByName(
        nations.select("c_nationkey", F.lit((1 << 62)).alias("pos"), F.lit("]").alias("value")))
    path = _scratch(t, "capture")
    frame.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "pos").select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    read = read_array(t.spark, path)
    place = F.regexp_extract("seq.file", "c_nationkey=([0-9]+)", 1).cast("int")
    return read.select(place.alias("nation"), F.col("seq.place").alias("place"), "job_id", "company_name", "title", "technologies",
                       F.col("_corrupt_record").isNotNull().alias("broken"))


@_register
def run_log_stream(t):
    """The events as files in order of arrival, some twice and some a month late, streamed into daily totals."""
    events = t.read("events").select("event_id", "ts", "user_id", "event_type")
    twice = events.where("event_id % 10 = 0").withColumn("_delay", F.lit(3))
    arrivals = events.withColumn("_delay", F.when(F.col("event_id") % 50 == 7, 30).otherwise(F.col("event_id") % 2)).unionByName(twice)
    path = _scratch(t, "arrivals")
    by = F.col("ts") + F.make_dt_interval(F.col("_delay").cast("int"))
    arrivals.withColumn("_at", by).repartitionByRange(6, "_at").drop("_delay", "_at").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    of = {f"{kind}s": F.count_if(F.col("event_type") == kind) for kind in ("view", "purchase", "error")}
    log = DayLog(t.spark, path, _scratch(t, "days"), t.spark.read.parquet(path).schema, ["event_id", "ts"], "ts", {**of, "last_ts": F.max("ts")})
    log.advance(delay="2 days", files_per_batch=2)
    return log.days()


# --- the same history loaded into a store -----------------------------------------


# Where the history has been loaded to, by application and folder: the queries below share one load.
_LOADED: dict = {}


def loaded_store(t) -> JobStore:
    """A store into which all months have been loaded, as captured ads, in one pass."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _LOADED:
        store = JobStore(t.spark, _scratch(t, "store"))
        daily.backfill(store, order_ads(t), cities=t.cities)
        _LOADED[key] = store.root
    return JobStore(t.spark, _LOADED[key])


@_register
def store_active_jobs_range(t):
    """F7, F8 on a store: active ads of the newest half year; only its days' folders are read."""
    store = loaded_store(t)
    return queries.active_jobs(store, F.add_months(t.latest, -6), t.latest).select(
        "job_id", "title", "snapshot_date", "location_type", "city", "seniority_level")


@_register
def store_technology_trend(t):
    """M6 on a store, per day of the newest year; the links hold the technologies of all copies of an ad."""
    return queries.technology_data(loaded_store(t), F.add_months(t.latest, -12), t.latest).drop("category")


@_register
def store_retention(t):
    """R1 on a copy of the store: the folders of days before the cutoff are dropped; rows per table and day of what is left."""
    whole, store = loaded_store(t), JobStore(t.spark, _scratch(t, "store"))
    with store.change() as change:
        for name in ("job_snapshots", "salaries", "job_technologies"):
            change.replace(name, whole[name])
    newest = store["job_snapshots"].agg(F.max("snapshot_date")).first()[0]
    store.retain(newest, 400)
    out = None
    for name in ("job_snapshots", "salaries", "job_technologies"):
        rows = store[name].groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@_register
def catalog_round_trip(t):
    """The tables made in the catalog, filled in bulk, read back by SQL with a parameter, and dropped."""
    database = f"adlake_{uuid.uuid4().hex[:12]}"
    create_tables(t.spark, database)
    for name in ("salaries", "job_snapshots"):
        insert_rows(t[name], f"{database}.{name}")
    out = t.spark.sql(f"""SELECT n.snapshot_date, n.location_type, count(*) AS rows, max(s.salary_max) AS most FROM {database}.salaries s
        JOIN {database}.job_snapshots n ON n.job_id = s.job_id AND n.snapshot_date = s.snapshot_date
        WHERE s.currency = :currency GROUP BY 1, 2""", args={"currency": "PLN"})
    kept = _scratch(t, "result")
    out.write.parquet(kept)
    drop_tables(t.spark, database)
    t.spark.sql(f"DROP DATABASE {database}")
    return t.spark.read.parquet(kept)


@_register
def bucketed_salaries(t):
    """Pay by technology from catalog tables that are bucketed by job."""
    database = f"adlake_{uuid.uuid4().hex[:12]}"
    create_tables(t.spark, database, buckets=8)
    for name in ("technologies", "job_postings", "job_snapshots", "salaries", "job_technologies"):
        insert_rows(t[name], f"{database}.{name}")
    kept = _scratch(t, "result")
    queries.salary_by_technology(CatalogTables(t.spark, database)).write.parquet(kept)
    drop_tables(t.spark, database)
    t.spark.sql(f"DROP DATABASE {database}")
    return t.spark.read.parquet(kept)


@_register
def capped_run(t):
    """X17 with a cap: the first hundred ad URLs of a run, in URL order."""
    return pages.capped(page_unique_urls(t), 100)


@_register
def dashboard_content(t):
    """What the dashboard's frames hold, as (frame, key, value)."""
    frames, day = marts.dashboard(t), F.coalesce(F.col("snapshot_date").cast("string"), F.lit(""))
    wanted = {
        "jobs": (["job_id", day], "salary_avg"), "salary": (["title", day, F.col("seniority_level")], "salary_avg"), "technology": (["technology", day], "job_count"),
        "location": ([day, "location_type", "city", "region"], "job_count"), "salary_by_tech": (["technology"], "avg_salary"),
        "kpis": (["top_technology"], "total_jobs"), "scrape_info": (["status"], "jobs_found")}
    out = None
    for name, (key, value) in wanted.items():
        row = frames[name].select(F.lit(name).alias("frame"), F.concat_ws("|", *key).alias("key"), F.round(F.col(value).cast("double"), 4).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out
