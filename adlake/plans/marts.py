"""Tables behind the charts.

Counts summed over days are ad-days: an ad seen on five days counts five times. Rows with a null group are
left out, as the charts do; only the remote share keeps them in its total.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from adlake import fixed_values as fv
from adlake.functions.text import pln, title_case
from adlake.operators.ranks import summary
from adlake.plans import queries
from adlake.plans.filters import top

_MEDIAN = {"median": 0.5}
_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _sums(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.dropna(subset=list(keys)).groupBy(*keys).agg(F.sum("job_count").alias("job_count"))


def _share(sums: DataFrame) -> DataFrame:
    """A share per group; the sums are few rows, one per category or type."""
    total = F.sum("job_count").over(W.partitionBy(F.lit(1)))
    return sums.withColumn("share", F.try_divide(F.col("job_count").cast("double"), total))


# --- pay ---------------------------------------------------------------------

def salary_histogram(t, bins: int = fv.HISTOGRAM_BINS, date_from=None, date_to=None) -> DataFrame:
    """A1: equal-width bins over mean pay with the exact median beside them; empty bins are left out."""
    pay = queries.pln_salaries(t, date_from, date_to).filter("salary_avg IS NOT NULL")
    stats = summary(pay, [], "salary_avg", _MEDIAN).select(F.struct("low", "high", "median")).scalar()
    # Equal amounts fall in one bin: bin their counts instead of the rows.
    amounts = pay.groupBy("salary_avg").agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", stats)
    width = (F.col("_s.high") - F.col("_s.low")) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col("salary_avg") - F.col("_s.low"), width)), F.lit(0))
    binned = amounts.withColumn("bin", F.least(place, F.lit(bins - 1)))
    return binned.groupBy("bin").agg(
        F.first(F.col("_s.low") + F.col("bin") * width).alias("bin_start"), F.sum("_n").alias("jobs"),
        F.first("_s.median").alias("median_salary"))


def salary_by_top_technology(t, top_n: int = 15) -> DataFrame:
    """A2: the most frequent of the technologies M8 returns."""
    return top(queries.salary_by_technology(t).select("technology", "job_count", "avg_salary"), top_n, "job_count", "technology")


def salary_trend(t, date_from=None, date_to=None, support: int = fv.MIN_TREND_SUPPORT) -> DataFrame:
    """A3: mean and median pay per day, for days with enough ads."""
    stats = summary(queries.pln_salaries(t, date_from, date_to), ["snapshot_date"], "salary_avg", _MEDIAN)
    return stats.filter(F.col("n") >= support).select(
        "snapshot_date", F.col("mean").alias("mean_salary"), F.col("median").alias("median_salary"), F.col("n").alias("count"))


def _boxes(t, key: str, date_from, date_to) -> DataFrame:
    """Five numbers per group over the active jobs, any currency."""
    snaps = queries.in_range(t["job_snapshots"], date_from, date_to).select("job_id", "snapshot_date", key)
    pay = t["salaries"].select("job_id", "snapshot_date", "salary_avg")
    rows = (
        snaps.dropna(subset=[key]).join(queries.active(t["job_postings"]).select("job_id"), "job_id")
        .join(pay, ["job_id", "snapshot_date"]).select(key, "salary_avg"))
    return summary(rows, [key], "salary_avg", _QUARTILES).select(
        key, F.col("n").alias("count"), F.col("low").alias("min_salary"), "q1", "median", "q3",
        F.col("high").alias("max_salary"))


def salary_by_seniority(t, date_from=None, date_to=None) -> DataFrame:
    """A4: in order junior, mid, senior; other levels only when none of these exists."""
    boxes = _boxes(t, "seniority_level", date_from, date_to)
    place = F.array_position(F.array(*map(F.lit, fv.SENIORITY_ORDER)), F.col("seniority_level"))
    # One row per level, so a window over all of them is small.
    known = F.coalesce(F.max("level_order").over(W.partitionBy(F.lit(1))), F.lit(0)) > 0
    return boxes.withColumn("level_order", place).withColumn("_known", known).filter(
        (F.col("level_order") > 0) | ~F.col("_known")).drop("_known").orderBy("level_order", "seniority_level")


def salary_by_location_type(t, date_from=None, date_to=None) -> DataFrame:
    """A5."""
    return _boxes(t, "location_type", date_from, date_to)


def salary_summary(t, date_from=None, date_to=None) -> DataFrame:
    """Six labelled figures, formatted; no rows without pay."""
    stats = summary(queries.pln_salaries(t, date_from, date_to), [], "salary_avg", _QUARTILES)
    figures = [("Mean", "mean"), ("Median", "median"), ("Min", "low"), ("Max", "high"),
               ("25th Percentile", "q1"), ("75th Percentile", "q3")]
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("position"), F.lit(label).alias("metric"), F.format_number(column, 0).alias("value_pln"))
        for i, (label, column) in enumerate(figures)])
    return stats.select(F.inline(rows))


# --- technologies ------------------------------------------------------------

def top_technologies(t, top_n: int = 20, date_from=None, date_to=None) -> DataFrame:
    """A7."""
    return top(_sums(queries.technology_data(t, date_from, date_to), "technology"), top_n, "job_count", "technology")


def _of_top_technologies(t, top_n: int, date_from, date_to) -> DataFrame:
    counts = queries.technology_data(t, date_from, date_to)
    # The kept side has top_n rows.
    keep = F.broadcast(top(_sums(counts, "technology"), top_n, "job_count", "technology").select("technology"))
    return counts.join(keep, "technology", "left_semi")


def top_technology_trends(t, top_n: int = 10, date_from=None, date_to=None) -> DataFrame:
    """Daily counts of the top technologies."""
    return _of_top_technologies(t, top_n, date_from, date_to).select("technology", "category", "snapshot_date", "job_count")


def technology_categories(t, date_from=None, date_to=None) -> DataFrame:
    """Positive totals per category with their share."""
    return _share(_sums(queries.technology_data(t, date_from, date_to), "category").filter("job_count > 0"))


def top_per_category(t, top_n: int = 5, date_from=None, date_to=None) -> DataFrame:
    """A10: each task keeps top_n rows per category before the shuffle (window group limit)."""
    sums = _sums(queries.technology_data(t, date_from, date_to), "category", "technology")
    order = W.partitionBy("category").orderBy(F.desc("job_count"), "technology")
    return sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n).select(
        "category", "technology", "job_count", "rank")


def co_occurrence(t, technology: str, top_n: int = 10) -> DataFrame:
    """Technologies in the same ad on the same day as a given one, by distinct jobs.

    The given technology's ads are the one side, so pairs among the others are never formed.
    """
    links = t["job_technologies"].select("job_id", "snapshot_date", "technology_id")
    given = t["technologies"].filter(F.col("name") == technology).select("technology_id")
    ads = links.join(given, "technology_id", "left_semi").select("job_id", "snapshot_date")
    counted = links.join(ads, ["job_id", "snapshot_date"], "left_semi").join(given, "technology_id", "left_anti").groupBy(
        "technology_id").agg(F.count_distinct("job_id").alias("job_count"))
    named = counted.join(t["technologies"], "technology_id").select(F.col("name").alias("technology"), "category", "job_count")
    return top(named, top_n, "job_count", "technology")


def technology_summary(t, top_n: int = 20, date_from=None, date_to=None) -> DataFrame:
    """Ranked from 1."""
    sums = _sums(queries.technology_data(t, date_from, date_to), "technology", "category")
    kept = top(sums, top_n, "job_count", "technology", "category")
    return kept.withColumn("rank", F.row_number().over(W.orderBy(F.desc("job_count"), "technology", "category")))


def demand_heatmap(t, top_n: int = 15, date_from=None, date_to=None) -> DataFrame:
    """A13 in long form: mean daily count per top technology and day, zero where a day has none."""
    rows = _of_top_technologies(t, top_n, date_from, date_to)
    means = rows.groupBy("technology", "snapshot_date").agg(F.avg("job_count").alias("job_count"))
    # top_n names and one row per captured day: the grid is as large as the picture.
    days = F.array_sort(F.collect_set("snapshot_date"))
    grid = means.groupBy().agg(days.alias("_days")).scalar()
    cells = means.select("technology").distinct().withColumn("snapshot_date", F.explode(grid))
    return cells.join(means, ["technology", "snapshot_date"], "left").select(
        "technology", "snapshot_date", F.coalesce("job_count", F.lit(0.0).cast("double")).alias("job_count"))


def demand_heatmap_wide(t, days: list, top_n: int = 15) -> DataFrame:
    """A13 as a matrix with one column per given day; naming the days spares a pass to find them."""
    rows = _of_top_technologies(t, top_n, None, None)
    return rows.groupBy("technology").pivot("snapshot_date", list(days)).agg(F.avg("job_count")).fillna(0.0)


# --- places ------------------------------------------------------------------

def city_top(t, top_n: int = 15, date_from=None, date_to=None) -> DataFrame:
    """A14."""
    return top(_sums(queries.location_data(t, date_from, date_to), "city"), top_n, "job_count", "city")


def location_type_distribution(t, date_from=None, date_to=None) -> DataFrame:
    """With title-case labels and shares."""
    sums = _share(_sums(queries.location_data(t, date_from, date_to), "location_type"))
    return sums.select("location_type", title_case(F.col("location_type")).alias("label"), "job_count", "share")


def location_type_trend(t, date_from=None, date_to=None) -> DataFrame:
    """One column per location type, zero for none."""
    counts = queries.location_data(t, date_from, date_to).dropna(subset=["location_type"])
    return counts.groupBy("snapshot_date").pivot("location_type", fv.LOCATION_TYPES).agg(F.sum("job_count")).fillna(0)


def regional_comparison(t, date_from=None, date_to=None) -> DataFrame:
    """Ascending."""
    return _sums(queries.location_data(t, date_from, date_to), "region").orderBy("job_count", "region")


def city_by_location_type(t, top_n: int = 10, date_from=None, date_to=None) -> DataFrame:
    """Types within the top cities."""
    sums = _sums(queries.location_data(t, date_from, date_to), "city", "location_type")
    cities = F.broadcast(top(_sums(sums, "city"), top_n, "job_count", "city").select("city"))  # top_n rows
    return sums.join(cities, "city", "left_semi")


def location_summary(t, top_n: int = 15, date_from=None, date_to=None) -> DataFrame:
    """Ranked from 1."""
    kept = top(_sums(queries.location_data(t, date_from, date_to), "city", "region"), top_n, "job_count", "city", "region")
    return kept.withColumn("rank", F.row_number().over(W.orderBy(F.desc("job_count"), "city", "region")))


def remote_share_trend(t, date_from=None, date_to=None) -> DataFrame:
    """Remote jobs in percent of all jobs of the day, null types counted, one decimal, half to even."""
    counts = queries.location_data(t, date_from, date_to)
    remote = F.sum(F.when(F.col("location_type") == "remote", F.col("job_count")).otherwise(0))
    days = counts.groupBy("snapshot_date").agg(F.sum("job_count").alias("total_jobs"), remote.alias("remote_jobs"))
    # The quotient first, then times 100: the order decides how halves round.
    pct = F.try_divide(F.col("remote_jobs").cast("double"), F.col("total_jobs").cast("double")) * 100
    return days.withColumn("remote_pct", F.bround(pct, 1))


# --- overview ----------------------------------------------------------------

def best_paying_technologies(t, top_n: int = 10) -> DataFrame:
    """By mean pay, of the technologies M8 returns."""
    return top(queries.salary_by_technology(t).select("technology", "avg_salary", "job_count"), top_n, "avg_salary", "technology")


def overview_counts(t, date_from=None, date_to=None) -> DataFrame:
    """Pay rows, distinct technologies, distinct cities. Each count needs only part of M5-M7."""
    links = queries._active_links(t, date_from, date_to).select("technology_id").distinct()
    names = t["technologies"].join(links, "technology_id", "left_semi").agg(F.count_distinct("name")).scalar()
    cities = queries.in_range(t["job_snapshots"], date_from, date_to).select("job_id", "city").join(
        queries.active(t["job_postings"]).select("job_id"), "job_id", "left_semi").agg(F.count_distinct("city")).scalar()
    return queries.pln_salaries(t, date_from, date_to).agg(F.count(F.lit(1)).alias("jobs_with_salary")).select(
        "jobs_with_salary", names.alias("technologies"), cities.alias("cities"))


def recent_postings(t, top_n: int = 20, date_from=None, date_to=None) -> DataFrame:
    """The newest rows of M4 with formatted pay."""
    newest = queries.active_jobs(t, date_from, date_to).select(
        "job_id", "title", "company_name", "city", "seniority_level", "salary_avg", "first_seen_date", "snapshot_date"
    ).orderBy(F.desc("first_seen_date"), "job_id", "snapshot_date").limit(top_n)
    return newest.select("title", "company_name", "city", "seniority_level", pln(F.col("salary_avg")).alias("avg_salary"),
                         "job_id", "snapshot_date")


def dashboard(t, date_from=None, date_to=None) -> dict[str, DataFrame]:
    """All inputs of the dashboard as lazy frames."""
    return {
        "jobs": queries.active_jobs_ordered(t, date_from, date_to),
        "salary": queries.salary_data(t, date_from, date_to),
        "technology": queries.technology_data(t, date_from, date_to),
        "location": queries.location_data(t, date_from, date_to),
        "salary_by_tech": queries.salary_by_technology(t, top_n=20),
        "kpis": queries.kpi_metrics(t),
        "scrape_info": queries.last_run(t),
    }
