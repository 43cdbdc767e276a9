"""Changes of the store that are cut off at any point."""

import os
import shutil
from datetime import date

import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from adlake import schema
from adlake.operators import daily, load
from adlake.plans import queries
from adlake.sources import store as stores
from adlake.sources.store import JobStore
from ads_for_tests import D1, D2, D3, THREE_ADS, ad, raw_frame, rows_of, table

HELD = [n for n in schema.TABLES if n != "scrape_runs"]


def content(spark, root):
    """All tables without clock times, read from the files, so that nothing is mended."""
    out = {}
    for name in [*HELD, "rejects"]:
        path = os.path.join(root, name)
        rows = ds.dataset(path, partitioning="hive").to_table().to_pylist() if os.path.isdir(path) else []
        out[name] = sorted(repr({k: v for k, v in sorted(r.items()) if k not in ("created_at", "updated_at")}) for r in rows)
    return out


def pay(spark, day, *jobs):
    return table(spark, "salaries", [(j, day, "PLN", 1.0, 2.0, 1.5, "monthly", False) for j in jobs])


def change_all(store):
    """A day anew, a day emptied, a bucket anew, new technologies."""
    spark = store.spark
    with store.change() as change:
        change.replace("salaries", pay(spark, D2, "b", "c"), spark.createDataFrame([(D1,), (D2,)], "snapshot_date date"))
        change.append("technologies", table(spark, "technologies", [(2, "Kafka", "data"), (3, "Rust", None)]))
        change.replace("job_postings", table(spark, "job_postings", [("a", "t2", "c", "u", D1, D2, True, None, None)]))
        change.replace("job_snapshots", table(spark, "job_snapshots", [("a", D2, *[None] * 8)]))


def begun(spark, root):
    store = JobStore(spark, root)
    store.settle_buckets(spark.range(1))
    with store.change() as change:
        change.replace("salaries", pay(spark, D1, "a").unionByName(pay(spark, D2, "a")))
        change.append("technologies", table(spark, "technologies", [(1, "SQL", "data")]))
        change.replace("job_postings", table(spark, "job_postings", [("a", "t1", "c", "u", D1, D1, True, None, None)]))
    return store


class Lost(Exception):
    pass


def fail_at(monkeypatch, owner, name, call, after):
    """Let the given call of a function fail, before or after it has done its work."""
    real, seen = getattr(owner, name), []

    def cut(*args, **kwargs):
        seen.append(1)
        if len(seen) == call and not after:
            raise Lost
        out = real(*args, **kwargs)
        if len(seen) == call and after:
            raise Lost
        return out

    monkeypatch.setattr(owner, name, cut)


def test_a_change_cut_off_anywhere_is_whole_after_opening(spark, tmp_path, monkeypatch):
    first = str(tmp_path / "first")
    before = content(spark, begun(spark, first).root)
    whole = str(tmp_path / "whole")
    shutil.copytree(first, whole)
    change_all(JobStore(spark, whole))
    after = content(spark, whole)
    assert before != after and after["salaries"] and not any(str(D1) in r for r in after["salaries"])

    # While rows are staged, around the list of steps, and around each step.
    cuts = [(stores.Change, "_stage", 1, False), (stores.Change, "_stage", 4, True), (JobStore, "redo", 1, False)]
    cuts += [(JobStore, "apply", 1, True), (JobStore, "apply", 2, False), (JobStore, "apply", 2, True), (JobStore, "apply", 3, True), (JobStore, "apply", 4, True)]
    cuts += [(stores, "delete_path", 1, False), (stores, "delete_path", 2, False)]  # the emptied day's folder, the change's own
    for place, (owner, name, call, done) in enumerate(cuts):
        root = str(tmp_path / f"cut{place}")
        shutil.copytree(first, root)
        store = JobStore(spark, root)
        with monkeypatch.context() as patch:
            fail_at(patch, owner, name, call, done)
            with pytest.raises(Lost):
                change_all(store)
        # Staging alone changes nothing; a change with its list done is finished by the next opening.
        assert content(spark, root) == before or name in ("apply", "delete_path")
        reopened = JobStore(spark, root)
        assert content(spark, root) == (before if name == "_stage" else after), (name, call, done)
        assert reopened.folders(reopened.path("_changes")) == []


def test_mending_may_be_cut_off_too(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    begun(spark, root)
    with monkeypatch.context() as patch:
        fail_at(patch, JobStore, "apply", 1, True)
        with pytest.raises(Lost):
            change_all(JobStore(spark, root))
    for call in (1, 3):
        with monkeypatch.context() as patch:
            fail_at(patch, JobStore, "apply", call, True)
            with pytest.raises(Lost):
                JobStore(spark, root)
    JobStore(spark, root)
    done = content(spark, root)
    change_all(JobStore(spark, root))
    assert content(spark, root) == done


def test_a_load_and_a_retention_cut_off_are_finished(spark, tmp_path, monkeypatch):
    root, other = str(tmp_path / "a"), str(tmp_path / "b")
    store = JobStore(spark, root)
    daily.load_day(store, raw_frame(spark, THREE_ADS), date(2025, 9, 1))
    shutil.copytree(root, other)
    day = raw_frame(spark, [*THREE_ADS[:2], ad("new-1", technologies=["Go", "Rust"])])
    daily.load_day(JobStore(spark, other), day, D3)
    with monkeypatch.context() as patch:
        fail_at(patch, JobStore, "apply", 3, False)
        with pytest.raises(Lost):
            daily.load_day(store, day, D3)
    reopened = JobStore(spark, root)
    assert content(spark, root) == content(spark, other)
    with monkeypatch.context() as patch:
        fail_at(patch, JobStore, "apply", 2, False)
        with pytest.raises(Lost):
            reopened.retain(D3, 90)
    JobStore(spark, root)
    JobStore(spark, other).retain(D3, 90)
    assert content(spark, root) == content(spark, other)
    assert {r.snapshot_date for r in JobStore(spark, root)["salaries"].collect()} <= {D3}


def test_buckets_follow_the_first_load_and_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "ROWS_PER_BUCKET", 2)
    store = JobStore(spark, str(tmp_path / "s"))
    daily.load_day(store, raw_frame(spark, THREE_ADS), D1)
    assert store.buckets == 3
    daily.load_day(JobStore(spark, store.root), raw_frame(spark, [ad(str(i)) for i in range(20)]), D2)
    again = JobStore(spark, store.root)
    assert again.buckets == 3 and again["job_postings"].count() == 23
    assert rows_of(again["job_postings"].filter("is_active").agg(F.count(F.lit(1)))) == [(20,)]


def test_ranges_read_only_their_folders(spark, tmp_path):
    store = begun(spark, str(tmp_path / "s"))
    with store.change() as change:
        change.replace("job_snapshots", table(spark, "job_snapshots", [("a", d, *[None] * 8) for d in (D1, D2, D3)]))
    ranged = queries.active_jobs(store, D2, D2)
    assert [(r.job_id, r.snapshot_date) for r in ranged.collect()] == [("a", D2)]
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan and "(snapshot_date#" in plan
    # Days known only when the query runs prune the folders too.
    days = spark.createDataFrame([(D1,)], "snapshot_date date").where("snapshot_date > '2020-01-01'")
    found = store.days_of("job_snapshots", days)
    assert [r.snapshot_date for r in found.collect()] == [D1] and "dynamicpruning" in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_first_load_meets_no_empty_table(spark, tmp_path):
    store = JobStore(spark, str(tmp_path / "s"))
    new = pay(spark, D1, "a")
    days = new.select("snapshot_date")
    merged = load.replace_by_key(store.days_of("salaries", days), new, ["job_id", "snapshot_date"])
    assert "Join" not in merged._jdf.queryExecution().optimizedPlan().toString()
    assert [r.job_id for r in merged.collect()] == ["a"] and merged.schema.fieldNames() == new.schema.fieldNames()


def inodes(root):
    return {os.stat(os.path.join(d, f)).st_ino for d, _, files in os.walk(root) for f in files if f.endswith(".parquet")}


def test_staged_files_are_moved_not_written_again(spark, tmp_path, monkeypatch):
    store, staged = begun(spark, str(tmp_path / "s")), []
    real = JobStore.redo
    with monkeypatch.context() as patch:
        patch.setattr(JobStore, "redo", lambda self, aside, steps: (staged.append(inodes(os.path.join(aside, "salaries"))), real(self, aside, steps)))
        change_all(store)
    assert staged[0] and staged[0] == inodes(store.path("salaries"))


def test_a_move_cut_off_between_files_is_finished(spark, tmp_path, monkeypatch):
    store = begun(spark, str(tmp_path / "s"))
    rows = pay(spark, D1, *[f"n{i}" for i in range(40)]).repartition(2)
    for call in (1, 2, 3):
        with monkeypatch.context() as patch:
            # Two files in the one folder, as a large day has.
            patch.setattr(stores.Change, "_stage", lambda self, name, rows, column: rows.write.partitionBy(column).parquet(os.path.join(self.aside, name)) or rows)
            fail_at(patch, stores, "move_file", min(call, 2), call != 2)
            with pytest.raises(Lost):
                with store.change() as change:
                    change.replace("salaries", rows)
        again = JobStore(spark, store.root)
        assert sorted(r.job_id for r in again.table("salaries").filter(F.col("snapshot_date") == D1).collect()) == sorted(f"n{i}" for i in range(40))
        assert again["salaries"].count() == 41
