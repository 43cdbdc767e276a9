import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from adlake import schema
from adlake.operators import daily, extract, lifecycle, maintain
from adlake.operators.load import expired
from adlake.sources.sample import Profile, sample_ads
from adlake.sources.store import JobStore, create_tables, drop_tables, insert_rows
from ads_for_tests import D1, D2, D3, THREE_ADS, ad, raw_frame, rows_of

STAMPS = ("created_at", "updated_at")


@pytest.fixture
def store(spark, tmp_path):
    return JobStore(spark, str(tmp_path / "store"))


def load(store, day, ads):
    return daily.load_day(store, raw_frame(store.spark, ads), day).first().asDict()


def state(store):
    return {n: sorted(map(repr, t.drop(*STAMPS).collect())) for n, t in store.tables().items()}


def active(store):
    return {r.job_id for r in store["job_postings"].filter("is_active").collect()}


def test_extraction(spark):
    rows = extract.records(raw_frame(spark, THREE_ADS), F.lit(D1)).collect()
    assert len(rows) == 3
    assert rows[0].job_posting.first_seen_date == D1 and rows[0].job_posting.is_active


def test_rejects(spark):
    ads = [ad("a", title="ab"), ad("b", company="x"), ad("c", url="ftp://x"), ad("d", title="   "), ad("", title="Good title"),
           ad("e", title=""), ad("f")]
    raw = raw_frame(spark, ads)
    assert rows_of(extract.reject_counts(raw), "reason") == [
        ("accepted", 1), ("bad url", 1), ("company too short", 1), ("missing job_id", 1), ("missing title", 1),
        ("title too short", 2)]
    assert extract.quarantined(raw).count() == 6


def test_transformation(spark):
    rows = {r.job_id: r for r in daily.prepare(raw_frame(spark, THREE_ADS), F.lit(D1)).collect()}
    first, second, third = (rows[a["job_id"]] for a in THREE_ADS)
    assert (first.location_type, first.city, first.region) == ("hybrid", "Gdynia", "Pomorskie")
    assert (first.salary_min, first.salary_max, first.salary_avg, first.currency) == (21000, 26500, 23750, "PLN")
    assert (second.location_type, second.city, second.salary_avg) == ("office", "Łódź", 10600)
    assert (third.location_type, third.city, third.salary_avg, third.seniority_level) == ("remote", None, 5500, "junior")


def test_load_twice(store):
    assert load(store, D1, THREE_ADS) == {
        "jobs_new": 3, "jobs_updated": 0, "jobs_expired": 0, "technologies_new": 9, "errors": 0}
    once = state(store)
    assert load(store, D1, THREE_ADS) == {
        "jobs_new": 0, "jobs_updated": 3, "jobs_expired": 0, "technologies_new": 0, "errors": 0}
    assert state(store) == once
    categories = {r.name: r.category for r in store["technologies"].collect()}
    assert (categories["Rust"], categories["Redis"], categories["Terraform"]) == ("language", "database", "tool")
    row = store["daily_metrics"].first()
    assert (row.metric_date, row.total_jobs, row.remote_jobs, row.office_jobs, row.hybrid_jobs) == (D1, 3, 1, 1, 1)
    assert row.avg_salary_pln == pytest.approx(39850 / 3) and row.median_salary_pln == 10600


def test_expiry_and_return(store):
    load(store, D1, [ad("a"), ad("b")])
    assert load(store, D2, [ad("b"), ad("c")])["jobs_expired"] == 1
    assert active(store) == {"b", "c"}
    assert load(store, D3, [ad("a", title="New title")])["jobs_expired"] == 2
    assert active(store) == {"a"}
    row = store["job_postings"].filter("job_id = 'a'").first()
    assert (row.title, row.first_seen_date, row.last_seen_date) == ("Keeper of Otters", D1, D3)
    assert load(store, date(2026, 1, 8), [])["jobs_expired"] == 0
    assert active(store) == {"a"}
    replay = rows_of(store["job_postings"].select("job_id", "first_seen_date", "last_seen_date", "is_active"), "job_id")
    at_once = rows_of(lifecycle.lifecycle(store["job_snapshots"]).select(
        "job_id", "first_seen_date", "last_seen_date", "is_active"), "job_id")
    assert replay == at_once
    spans = rows_of(lifecycle.active_spans(store["job_snapshots"]), "job_id", "span_start")
    assert spans == [("a", D1, D1, 1), ("a", D3, D3, 1), ("b", D1, D2, 2), ("c", D2, D2, 1)]


def test_copies_in_one_batch(store):
    got = load(store, D1, [ad("a", title="First title", salary="1000 PLN", technologies=["Go"]),
                           ad("a", title="Second title", salary="2000 PLN", location="Kraków", technologies=["Go", "R"])])
    assert (got["jobs_new"], got["jobs_updated"]) == (1, 1)
    assert store["job_postings"].first().title == "First title"
    assert store["job_snapshots"].first().city == "Kraków" and store["job_snapshots"].count() == 1
    assert [r.salary_avg for r in store["salaries"].collect()] == [2000.0]
    assert store["job_technologies"].count() == 2


def test_same_day_again_replaces_pay_but_keeps_links(store):
    load(store, D1, [ad("a", salary="1000 PLN", technologies=["Go"]), ad("b", salary="5 PLN")])
    got = load(store, D1, [ad("a", salary="3000 PLN", technologies=["R"])])
    assert got["jobs_expired"] == 1 and active(store) == {"a"}
    assert rows_of(store["salaries"].select("job_id", "salary_avg"), "job_id") == [("a", 3000.0), ("b", 5.0)]
    assert store["job_technologies"].count() == 2


def test_expired_keys(spark):
    old = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "job_id string, is_active boolean")
    assert [r.job_id for r in expired(old, spark.createDataFrame([("b",)], "job_id string")).collect()] == ["a"]


def test_refused_ads_are_kept_and_counted(store):
    got = load(store, D1, [ad("a"), ad("b"), ad("c", title="ab"), ad("d", url="ftp://x"), ad("e")])
    assert (got["jobs_new"], got["errors"]) == (3, 2)
    assert rows_of(store["rejects"].select("job_id", "reason", "snapshot_date"), "job_id") == [
        ("c", "title too short", D1), ("d", "bad url", D1)]
    assert load(store, D1, [ad("a"), ad("b"), ad("c"), ad("e")])["errors"] == 0
    assert store["rejects"].count() == 0


def test_days_out_of_order_end_like_days_in_order(spark, tmp_path):
    days = {D1: [ad("a"), ad("b", salary="10 PLN")], D2: [ad("b"), ad("c", location="remote")], D3: [ad("c"), ad("d")]}
    stores = []
    for name, order in (("in", (D1, D2, D3)), ("out", (D3, D1, D2))):
        stores.append(JobStore(spark, str(tmp_path / name)))
        for day in order:
            load(stores[-1], day, days[day])
    one, other = (rows_of(s["job_postings"].select("job_id", "first_seen_date", "last_seen_date", "is_active"), "job_id") for s in stores)
    assert one == other == [("a", D1, D1, False), ("b", D1, D2, False), ("c", D2, D3, True), ("d", D3, D3, True)]
    assert rows_of(stores[0]["daily_metrics"], "metric_date") == rows_of(stores[1]["daily_metrics"], "metric_date")
    at_once = JobStore(spark, str(tmp_path / "once"))
    dated = [(day, a) for day, ads in days.items() for a in ads]
    frame = spark.createDataFrame([{**a, "snapshot_date": day, "seq": i} for i, (day, a) in enumerate(dated)],
                                  "url string, job_id string, title string, company_name string, description string, requirements string, "
                                  "salary string, location string, technologies array<string>, seniority string, employment_type string, "
                                  "snapshot_date date, seq bigint")
    daily.backfill(at_once, frame)
    assert state(at_once) == state(stores[0])


def test_only_touched_buckets_and_days_are_written(store, tmp_path):
    load(store, D1, [ad(str(i)) for i in range(40)])
    root = tmp_path / "store"

    def files(name):
        return {p for p in (root / name).rglob("*.parquet")}

    before = {n: files(n) for n in ("job_postings", "job_snapshots")}
    daily.load_days(store, raw_frame(store.spark, [ad("7")]), F.lit(D1), complete=False)
    assert len(before["job_postings"] - files("job_postings")) == 1
    load(store, D2, [ad("7")])
    kept = {p for p in files("job_snapshots") if "2026-01-05" in str(p)}
    load(store, D2, [ad("7")])
    assert kept <= files("job_snapshots")


def test_lists_and_switches(spark):
    raw = raw_frame(spark, THREE_ADS)
    rows = daily.prepare(raw, F.lit(D1), lists={"seniority": ["mid", "junior"], "location": []}, salary=False, skills=False).collect()
    assert {r.job_id for r in rows} == {a["job_id"] for a in THREE_ADS[1:]}
    assert all(r.salary_avg is None and r.technologies == [] for r in rows)


def test_failed_load_is_not_seen(store, monkeypatch):
    load(store, D1, THREE_ADS)
    before = state(store)

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(daily.load, "technology_links", fail)
    with pytest.raises(RuntimeError):
        load(store, D2, [ad("z", salary="1 PLN", technologies=["Go"])])
    monkeypatch.undo()
    assert state(store) == before
    assert load(store, D2, [ad("z", technologies=["Go"])])["jobs_expired"] == 3


def test_daily_run_is_logged(spark, store, monkeypatch):
    run = daily.run_day(store, raw_frame(spark, THREE_ADS), D1).first()
    assert (run.jobs_found, run.jobs_new, run.status) == (3, 3, "success")
    monkeypatch.setattr(daily, "load_day", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        daily.run_day(store, raw_frame(spark, THREE_ADS), D2)
    assert sorted(r.status for r in store["scrape_runs"].collect()) == ["failed", "success"]


def test_backfill_in_date_order(spark, store):
    ads = sample_ads(spark, 40, 3)
    assert daily.backfill(store, ads).first().jobs_new == 40
    assert store["job_snapshots"].count() == 40 and store["salaries"].count() == 40
    newest = max(store.days())
    assert active(store) == {r.job_id for r in ads.filter(F.col("snapshot_date") == F.lit(newest)).collect()}
    assert store["daily_metrics"].count() == len(store.days())


def test_sample_feed(spark):
    profile = Profile()
    rows = sample_ads(spark, 300).collect()
    assert rows == sample_ads(spark, 300).repartition(7).orderBy("seq").collect()
    assert rows != sample_ads(spark, 300, seed=43).collect() and len({r.job_id for r in rows}) == 300
    assert all(3 <= len(set(r.technologies)) == len(r.technologies) <= 6 and set(r.technologies) <= set(profile.skills) for r in rows)
    assert {r.snapshot_date for r in rows} == {date(2026, 1, 7) - timedelta(days=n) for n in range(8)}
    for level, (share, median, spread) in profile.levels.items():
        pays = [tuple(map(int, r.salary.split(" ")[:3:2])) for r in rows if r.seniority == level]
        assert abs(len(pays) / 300 - share) < 0.1
        assert all(median * math.exp(-3 * spread) - 50 <= low <= high <= low * 1.25 + 50 and low <= median * math.exp(3 * spread) + 50 for low, high in pays)
    assert extract.accepted(spark.createDataFrame(rows)).count() == 300


def test_maintenance(store):
    load(store, date(2025, 9, 1), THREE_ADS)
    load(store, D1, THREE_ADS)
    load(store, D1, THREE_ADS)
    assert store["job_technologies"].count() == 18
    assert store.retain(D1, 90) == [date(2025, 9, 1)]
    assert {n: store[n].count() for n in schema.DATED} == {"job_snapshots": 3, "salaries": 3, "job_technologies": 9}
    assert maintain.foreign_key_violations(store.tables()).count() == 0
    assert {r.nulls for r in maintain.null_counts(store.tables()).collect()} == {0}
    for name in schema.UNIQUE_KEYS:
        assert maintain.duplicate_keys(store[name], name).count() == 0
    store.delete_jobs(store.spark.createDataFrame([(THREE_ADS[0]["job_id"],)], "job_id string"))
    assert store["job_postings"].count() == 2 and store["salaries"].count() == 2 and store["job_technologies"].count() == 5


def test_integrity_reports(spark):
    twice = spark.createDataFrame([("a", D1), ("a", D1), ("b", D1)], "job_id string, snapshot_date date")
    assert rows_of(maintain.duplicate_keys(twice, "job_snapshots")) == [("job_snapshots", "a|2026-01-05", 2)]
    parents = spark.createDataFrame([("a",)], "job_id string")
    got = maintain.foreign_key_violations({"job_snapshots": twice, "job_postings": parents},
                                          [("job_snapshots", "job_id", "job_postings", "job_id")])
    assert rows_of(got) == [("job_snapshots", "job_id", "b", 1)]


def test_catalog_tables(spark):
    create_tables(spark, "adlake_t")
    create_tables(spark, "adlake_t")
    rows = spark.createDataFrame([("a", D1, "EUR", 1.0, 2.0, 1.5, "monthly", True)], schema.TABLES["salaries"])
    insert_rows(rows, "adlake_t.salaries")
    got = spark.sql("SELECT salary_avg FROM adlake_t.salaries WHERE currency = :c", args={"c": "EUR"}).collect()
    assert [r[0] for r in got] == [1.5]
    drop_tables(spark, "adlake_t")
    assert spark.sql("SHOW TABLES IN adlake_t").count() == 0


def test_a_load_judges_its_ads_once(spark):
    raw = raw_frame(spark, THREE_ADS)
    batch = daily.prepare(raw, F.lit(D1), judged=True)
    assert "title too short" not in batch._jdf.queryExecution().optimizedPlan().toString()
    assert rows_of(batch.drop("seq")) == rows_of(daily.prepare(raw, F.lit(D1)).drop("seq"))
