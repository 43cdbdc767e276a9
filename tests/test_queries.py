"""The questions on a small history whose answers are worked out by hand."""

from datetime import date

import pytest

from adlake.operators import metrics
from adlake.plans import filters, marts, queries
from ads_for_tests import D1, D2, D3, rows_of, table


@pytest.fixture(scope="module")
def t(spark):
    def posting(job, first, last, live):
        return (job, f"Title {job}", f"Firm {job}", f"https://h/job/{job}", first, last, live, None, None)

    def snap(job, day, kind, city, region, level="mid"):
        return (job, day, None, None, kind, city, region, "Poland", level, None)

    def pay(job, day, amount, currency="PLN"):
        return (job, day, currency, amount - 1, amount + 1, amount, "monthly", False)

    postings = [posting("a", D1, D2, True), posting("b", D1, D2, True), posting("c", D1, D1, False), posting("d", D2, D2, True)]
    snaps = [
        snap("a", D1, "remote", None, None, "senior"), snap("a", D2, "office", "Kraków", "Małopolskie", "senior"),
        snap("b", D1, "hybrid", "Łódź", "Łódzkie"), snap("b", D2, None, None, None), snap("c", D1, "office", "Kraków", "Małopolskie")]
    pays = [pay("a", D1, 10.0), pay("a", D2, 20.0), pay("b", D1, 40.0), pay("b", D2, 50.0, "EUR"), pay("c", D1, 1000.0)]
    techs = [(1, "Go", "language"), (2, "AWS", "cloud"), (3, "Perl", "other")]
    links = [("a", 1, "required", D1), ("a", 2, None, D1), ("a", 1, None, D2), ("b", 1, None, D1), ("b", 2, None, D2),
             ("c", 2, "required", D1)]
    return {
        "job_postings": table(spark, "job_postings", postings), "job_snapshots": table(spark, "job_snapshots", snaps),
        "salaries": table(spark, "salaries", pays), "technologies": table(spark, "technologies", techs),
        "job_technologies": table(spark, "job_technologies", links),
        "daily_metrics": table(spark, "daily_metrics", [(D1, 3, 1, 0, 1, 25.0, 40.0, 3), (D3, 4, 0, 0, 0, None, None, 4)]),
        "scrape_runs": table(spark, "scrape_runs", []),
    }


def test_active_jobs(t):
    rows = queries.active_jobs_ordered(t).collect()
    # d has no snapshot: kept without a range, dropped by one
    assert [(r.job_id, r.snapshot_date, r.salary_avg) for r in rows] == [
        ("d", None, None), ("a", D1, 10.0), ("a", D2, 20.0), ("b", D1, 40.0), ("b", D2, 50.0)]
    assert {r.job_id for r in queries.active_jobs(t, D1, D2).collect()} == {"a", "b"}
    assert queries.active_jobs(t, date_from=D2).count() == 2


def test_salary_data(t):
    assert sorted(r.salary_avg for r in queries.salary_data(t).collect()) == [10.0, 20.0, 40.0]
    assert queries.salary_data(t, date_to=D1).count() == 2
    assert rows_of(queries.pln_salaries(t), "salary_avg") == [(D1, 10.0), (D2, 20.0), (D1, 40.0)]


def test_technology_and_location_data(t):
    assert rows_of(queries.technology_data(t), "technology", "snapshot_date") == [
        ("AWS", "cloud", D1, 1), ("AWS", "cloud", D2, 1), ("Go", "language", D1, 2), ("Go", "language", D2, 1)]
    assert rows_of(queries.location_data(t), "snapshot_date", "job_count", "city") == [
        (D1, "remote", None, None, 1), (D1, "hybrid", "Łódź", "Łódzkie", 1),
        (D2, None, None, None, 1), (D2, "office", "Kraków", "Małopolskie", 1)]


def test_salary_by_technology(t):
    # AWS has one job with PLN pay on the day and is left out
    assert rows_of(queries.salary_by_technology(t)) == [("Go", "language", 2, pytest.approx(70 / 3), 9.0, 41.0)]
    assert rows_of(marts.best_paying_technologies(t)) == [("Go", pytest.approx(70 / 3), 2)]
    assert rows_of(marts.salary_by_top_technology(t)) == [("Go", 2, pytest.approx(70 / 3))]


def test_indicators(t):
    assert tuple(queries.kpi_metrics(t).first()) == (3, 20.0, 0.0, "AWS")
    empty = {n: f.limit(0) for n, f in t.items()}
    assert tuple(queries.kpi_metrics(empty).first()) == (0, 0.0, 0.0, "N/A")


def test_daily_metrics(t):
    row = metrics.daily_metrics(t["job_postings"], t["job_snapshots"], t["salaries"], filters._date(D1)).first()
    # the median looks at all pay of the day, the mean at active postings only
    assert tuple(row) == (D1, 3, 1, 0, 1, 25.0, 40.0, 3)
    by_date = rows_of(metrics.metrics_by_date(t["job_postings"], t["job_snapshots"], t["salaries"]), "metric_date")
    assert by_date == [(D1, 3, 1, 0, 1, 25.0, 40.0, 3), (D2, 3, 0, 1, 0, 35.0, 50.0, 3)]
    nobody = metrics.daily_metrics(t["job_postings"].limit(0), t["job_snapshots"], t["salaries"].limit(0), filters._date(D1)).first()
    assert tuple(nobody) == (D1, 0, None, None, None, None, None, 0)
    assert rows_of(queries.recent_daily_metrics(t, D3, 1)) == [(D3, 4, 0, 0, 0, None, None)]


def test_ad_hoc(t):
    assert rows_of(queries.jobs_by_city(t)) == [(None, 2), ("Kraków", 2), ("Łódź", 1)]
    # job a: 2 Go links x 2 pay rows, b: 1 x 2; AWS: a 1 x 2, b 1 x 2, c 1 x 1
    assert rows_of(queries.average_salary_by_technology(t)) == [
        ("AWS", pytest.approx((10 + 20 + 40 + 50 + 1000) / 5), 5), ("Go", pytest.approx((10 + 20 + 10 + 20 + 40 + 50) / 6), 6)]
    assert {r.location_type: r.percentage for r in queries.location_share(t).collect()} == {
        "remote": 20.0, "hybrid": 20.0, "office": 40.0, None: 20.0}
    assert rows_of(queries.technology_trend_recent(t, D3, 1)) == [("AWS", D2, 1), ("Go", D2, 1)]
    assert rows_of(queries.best_paid_jobs(t, 5)) == [
        ("Title b", 40.0, None), ("Title b", 40.0, "Łódź"), ("Title a", 20.0, None), ("Title a", 20.0, "Kraków"),
        ("Title a", 10.0, None)]
    preview = queries.aggregate_preview(t).first()
    assert (preview.total_jobs, preview.remote_jobs, preview.office_jobs, preview.hybrid_jobs) == (3, 2, 2, 2)
    assert preview.avg_salary == pytest.approx((2 * 10 + 2 * 20 + 2 * 40 + 2 * 50) / 8)
    assert rows_of(queries.technology_popularity(t), "name") == [
        ("AWS", "cloud", 3, 1), ("Go", "language", 3, 1), ("Perl", "other", 0, 0)]
    assert rows_of(queries.technologies_of_job(t, "c")) == [("AWS", "cloud", "required")]
    assert rows_of(queries.technology_trends(t, ["Go", "none"], D2, 0)) == [("Go", D2, 1)]
    assert queries.technology_trends(t, [], D2).count() == 0
    assert tuple(queries.store_totals(t).first()) == (4, 3, 3, 5)
    assert dict(rows_of(queries.table_counts(t)))["job_technologies"] == 6


def test_pay_charts(t):
    bins = rows_of(marts.salary_histogram(t, bins=3), "bin")
    assert bins == [(0, 10.0, 1, 20.0), (1, 20.0, 1, 20.0), (2, 30.0, 1, 20.0)]
    assert marts.salary_trend(t).count() == 0
    assert rows_of(marts.salary_trend(t, support=2)) == [(D1, 25.0, 25.0, 2)]
    assert rows_of(marts.salary_by_seniority(t)) == [("mid", 2, 40.0, 42.5, 45.0, 47.5, 50.0, 2), ("senior", 2, 10.0, 12.5, 15.0, 17.5, 20.0, 3)]
    assert rows_of(marts.salary_by_location_type(t), "location_type") == [
        ("hybrid", 1, 40.0, 40.0, 40.0, 40.0, 40.0), ("office", 1, 20.0, 20.0, 20.0, 20.0, 20.0),
        ("remote", 1, 10.0, 10.0, 10.0, 10.0, 10.0)]
    assert [r.value_pln for r in marts.salary_summary(t).orderBy("position").collect()] == ["23", "20", "10", "40", "15", "30"]
    assert marts.salary_summary(t, date_from=D3).collect() == []


def test_one_amount_is_one_bin(t):
    assert rows_of(marts.salary_histogram(t, date_from=D2)) == [(0, 20.0, 1, 20.0)]


def test_unknown_levels_only_without_known_ones(t):
    from pyspark.sql import functions as F

    odd = {**t, "job_snapshots": t["job_snapshots"].withColumn("seniority_level", F.lit("expert"))}
    assert [r.seniority_level for r in marts.salary_by_seniority(odd).collect()] == ["expert"]


def test_technology_charts(t):
    assert rows_of(marts.top_technologies(t, 1)) == [("Go", 3)]
    assert {r.technology for r in marts.top_technology_trends(t, 1).collect()} == {"Go"}
    assert rows_of(marts.technology_categories(t), "category") == [("cloud", 2, 0.4), ("language", 3, 0.6)]
    assert rows_of(marts.top_per_category(t, 1), "category") == [("cloud", "AWS", 2, 1), ("language", "Go", 3, 1)]
    assert rows_of(marts.co_occurrence(t, "Go")) == [("AWS", "cloud", 1)]
    assert rows_of(marts.technology_summary(t), "rank") == [("Go", "language", 3, 1), ("AWS", "cloud", 2, 2)]
    assert rows_of(marts.demand_heatmap(t, 1), "snapshot_date") == [("Go", D1, 2.0), ("Go", D2, 1.0)]
    wide = marts.demand_heatmap_wide(t, [D1, D2, D3]).orderBy("technology").collect()
    assert [tuple(r) for r in wide] == [("AWS", 1.0, 1.0, 0.0), ("Go", 2.0, 1.0, 0.0)]


def test_place_charts(t):
    assert rows_of(marts.city_top(t)) == [("Kraków", 1), ("Łódź", 1)]
    assert rows_of(marts.location_type_distribution(t), "label") == [
        ("hybrid", "Hybrid", 1, pytest.approx(1 / 3)), ("office", "Office", 1, pytest.approx(1 / 3)),
        ("remote", "Remote", 1, pytest.approx(1 / 3))]
    assert rows_of(marts.location_type_trend(t), "snapshot_date") == [(D1, 1, 0, 1), (D2, 0, 1, 0)]
    assert rows_of(marts.regional_comparison(t)) == [("Małopolskie", 1), ("Łódzkie", 1)]
    assert rows_of(marts.city_by_location_type(t, 1)) == [("Kraków", "office", 1)]
    assert rows_of(marts.location_summary(t), "rank") == [("Kraków", "Małopolskie", 1, 1), ("Łódź", "Łódzkie", 1, 2)]
    assert rows_of(marts.remote_share_trend(t), "snapshot_date") == [(D1, 2, 1, 50.0), (D2, 2, 0, 0.0)]


@pytest.mark.parametrize("total, want", [(8, 12.5), (16, 6.2), (80, 1.2)])
def test_share_rounds_half_to_even(spark, t, total, want):
    snaps = [(f"j{i}", D1, None, None, "remote" if i == 0 else None, None, None, "Poland", "mid", None) for i in range(total)]
    posts = [(f"j{i}", "t", "c", "u", D1, D1, True, None, None) for i in range(total)]
    tables = {**t, "job_snapshots": table(spark, "job_snapshots", snaps), "job_postings": table(spark, "job_postings", posts)}
    assert marts.remote_share_trend(tables).first().remote_pct == want


def test_overview(t):
    assert tuple(marts.overview_counts(t).first()) == (3, 2, 2)
    first = marts.recent_postings(t).first()
    assert (first.title, first.city, first.avg_salary) == ("Title d", None, "N/A")
    assert set(marts.dashboard(t)) == {"jobs", "salary", "technology", "location", "salary_by_tech", "kpis", "scrape_info"}


def test_presets(spark):
    day = date(2026, 3, 31)
    start, end = filters.preset_range("Last 30 days", day)
    assert tuple(spark.range(1).select(start, end).first()) == (date(2026, 3, 1), day)
    assert filters.preset_range("All time", day) == (None, None)
