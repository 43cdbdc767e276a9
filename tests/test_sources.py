import json
from datetime import datetime

from pyspark.sql import functions as F

from adlake.operators import extract
from adlake.operators.daily import load_day
from adlake.plans import queries
from adlake.sources import raw
from adlake.sources.store import JobStore
from adlake.streaming.ingest import ingest
from ads_for_tests import D1, D2, D3, THREE_ADS, ad, raw_frame


def write_array(folder, day, name, ads):
    path = folder / f"run_date={day}"
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{name}.json").write_text(json.dumps(ads, ensure_ascii=False), encoding="utf-8")


def test_array_capture(spark, tmp_path):
    write_array(tmp_path, D1, "raw_1", [{**THREE_ADS[0], "extra": 1}, {**THREE_ADS[1], "salary": None}])
    ads = raw.read_capture(spark, str(tmp_path / f"run_date={D1}")).orderBy("seq").collect()
    assert [a.job_id for a in ads] == [a["job_id"] for a in THREE_ADS[:2]]
    assert ads[1].location == "Łódź" and ads[1].salary is None


def test_capture_round_trip(spark, tmp_path):
    frame = raw_frame(spark, THREE_ADS).withColumn("run_date", F.lit(D1))
    raw.write_capture(frame, str(tmp_path / "bronze"))
    back = raw.read_capture(spark, str(tmp_path / "bronze"), multi_line=False)
    assert {r.location for r in back.collect()} == {a["location"] for a in THREE_ADS}
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "bronze").rglob("*.json"))
    assert "Łódź" in text


def test_queries_with_parameters(spark):
    raw.register_views({"salaries_v": spark.createDataFrame([("a", 1.0), ("b", 2.0)], "job_id string, amount double")})
    got = raw.fetch_all(spark, "SELECT job_id FROM salaries_v WHERE amount >= :least", least=1.5)
    assert [r.job_id for r in got.collect()] == ["b"]
    assert raw.fetch_one(spark, "SELECT job_id FROM salaries_v WHERE amount > :least", least=9.0) is None


def test_exports(spark, tmp_path):
    frame = spark.createDataFrame([("ł", 1)], "a string, b int")
    raw.export(frame, str(tmp_path / "c"), "csv")
    raw.export(frame, str(tmp_path / "j"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().asDict() == {"a": "ł", "b": "1"}
    assert spark.read.json(str(tmp_path / "j")).first().a == "ł"


def test_run_log(spark, tmp_path):
    store = JobStore(spark, str(tmp_path / "s"))
    assert queries.last_run(store.tables()).first().asDict() == {
        "last_update": "Never", "jobs_found": 0, "jobs_new": 0, "status": "unknown"}
    assert queries.last_success(store.tables()).first().run_date is None
    for hour, found, status in ((1, 100, None), (2, 0, None), (3, 5, "failed")):
        at = F.lit(datetime(2026, 1, 5, hour))
        store.append_run(raw.scrape_run(spark, at, found, 25, status=status, duration_seconds=45.5))
    runs = {r.run_date.hour: r.status for r in store["scrape_runs"].collect()}
    assert runs == {1: "success", 2: "partial", 3: "failed"}
    assert queries.last_run(store.tables()).first().status == "failed"
    assert queries.last_success(store.tables()).first().run_date == datetime(2026, 1, 5, 1)


def snapshot(store):
    return {n: sorted(map(repr, t.drop("created_at", "updated_at").collect())) for n, t in store.tables().items()}


def test_stream_equals_batch(spark, tmp_path):
    days = {D1: [THREE_ADS[0], THREE_ADS[1]], D2: [THREE_ADS[1], THREE_ADS[2]], D3: [THREE_ADS[0], ad("late", salary="7 PLN")]}
    batch = JobStore(spark, str(tmp_path / "batch"))
    for day, ads in days.items():
        load_day(batch, raw_frame(spark, ads), day)

    folder, checkpoint = tmp_path / "in", str(tmp_path / "check")
    stream = JobStore(spark, str(tmp_path / "stream"))
    for day in (D1, D2):
        for i, one in enumerate(days[day]):
            write_array(folder, day, f"raw_{i}", [one])
    ingest(stream, str(folder), checkpoint, multi_line=True).awaitTermination()
    for i, one in enumerate(days[D3]):
        write_array(folder, D3, f"raw_{i}", [one])
    ingest(stream, str(folder), checkpoint, multi_line=True).awaitTermination()
    assert snapshot(stream) == snapshot(batch)
    ingest(stream, str(folder), checkpoint, multi_line=True).awaitTermination()
    assert snapshot(stream) == snapshot(batch)


def test_late_file_closes_its_day_again(spark, tmp_path):
    folder, checkpoint, store = tmp_path / "in", str(tmp_path / "check"), JobStore(spark, str(tmp_path / "store"))
    for day, i, ads in ((D1, 0, [ad("a")]), (D2, 0, [ad("b")]), (D1, 1, [ad("c"), ad("bad", title="x")])):
        write_array(folder, day, f"raw_{i}", ads)
        ingest(store, str(folder), checkpoint, multi_line=True).awaitTermination()
    assert {r.metric_date: r.total_jobs for r in store["daily_metrics"].collect()} == {D1: 2, D2: 1}
    assert {r.job_id: r.is_active for r in store["job_postings"].collect()} == {"a": False, "b": True, "c": False}
    assert [r.job_id for r in store["rejects"].collect()] == ["bad"]


def test_filters(spark):
    frame = raw_frame(spark, THREE_ADS)
    assert extract.only_listed(frame, seniority=["mid"], employment_type=[]).count() == 1
    blank = extract.without_fields(frame, skills=False, salary=False).first()
    assert blank.technologies == [] and blank.salary is None and blank.location
