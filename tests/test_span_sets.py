"""Span sets updated day by day against the spans of the whole history."""

import datetime
import random

from adlake.operators.lifecycle import active_spans, merge_spans, spans_as_rows

SEEN = "job_id string, snapshot_date date"
HELD = "job_id string, spans array<struct<span_start:date,span_end:date>>"


def day(n):
    return datetime.date(2026, 1, 1) + datetime.timedelta(days=n)


def after(spark, batches):
    """Span sets and sightings after the batches, each a list of (job, day number)."""
    held, seen, changes = [], [], []
    for batch in batches:
        calendar = spark.createDataFrame([(x,) for x in sorted({d for _, d in seen})], "snapshot_date date")
        rows = [(job, day(n)) for job, n in batch]
        found = merge_spans(spark.createDataFrame(held, HELD), calendar, spark.createDataFrame(rows, SEEN)).collect()
        held = [(r.job_id, [tuple(s) for s in r.spans]) for r in found]
        changes.append({r.job_id for r in found if r.changed})
        seen += rows
    return held, seen, changes


def test_spans_equal_those_of_the_whole_history_in_any_order(spark):
    rng = random.Random(3)
    sightings = [(f"j{j}", d) for j in range(6) for d in (0, 1, 2, 5, 6, 7, 9, 14, 15, 40) if rng.random() < 0.65]
    order = sorted({d for _, d in sightings})
    rng.shuffle(order)
    # The days in threes; one sighting comes alone and again.
    batches = [[s for s in sightings if s[1] in order[i:i + 3]] for i in range(0, len(order), 3)]
    batches[1:1] = [[sightings[-1]]]
    held, seen, _ = after(spark, batches)
    calendar = spark.createDataFrame(sorted({(d,) for _, d in seen}), "snapshot_date date")
    got = spans_as_rows(spark.createDataFrame(held, HELD), calendar)
    want = active_spans(spark.createDataFrame(seen, SEEN))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_only_touched_jobs_change(spark):
    held, _, changes = after(spark, [[("a", 0), ("b", 0), ("a", 2), ("b", 2)], [("a", 4)], [("b", 1)], [("b", 1)]])
    # A newest day changes those that it shows; a late one also those whose span lies across it; a repeated one none.
    assert changes == [{"a", "b"}, {"a"}, {"a"}, set()]
    assert dict(held) == {"a": [(day(0), day(0)), (day(2), day(4))], "b": [(day(0), day(2))]}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "snapshot_date date")
    assert after(spark, [[]])[0] == [] and spans_as_rows(spark.createDataFrame([], HELD), none).collect() == []
    held, _, changes = after(spark, [[("a", 3)], []])
    assert held == [("a", [(day(3), day(3))])] and changes[1] == set()
