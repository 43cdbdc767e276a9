"""Posting lifecycle over the whole history in one pass (W5), instead of a replay day by day."""

from pyspark.sql import DataFrame, Window as W, functions as F


def active_spans(snapshots: DataFrame) -> DataFrame:
    """Unbroken runs of days per job: (job_id, span_start, span_end, days_seen).

    Two sightings belong to one span when no captured day lies between them. A job has one row per captured
    day at most, so its window is bounded by the calendar.
    """
    seen = snapshots.select("job_id", "snapshot_date").distinct()
    # One row per captured day: bounded by the calendar, whatever the history holds.
    days = snapshots.select("snapshot_date").distinct()
    previous = days.withColumn("_previous_day", F.lag("snapshot_date").over(W.orderBy("snapshot_date")))
    per_job = W.partitionBy("job_id").orderBy("snapshot_date")
    starts = seen.join(F.broadcast(previous), "snapshot_date").withColumn(
        "_start", ~F.lag("snapshot_date").over(per_job).eqNullSafe(F.col("_previous_day"))
        | F.col("_previous_day").isNull())
    numbered = starts.withColumn("_span", F.sum(F.col("_start").cast("int")).over(per_job))
    return numbered.groupBy("job_id", "_span").agg(
        F.min("snapshot_date").alias("span_start"), F.max("snapshot_date").alias("span_end"),
        F.count(F.lit(1)).alias("days_seen"),
    ).drop("_span")


def lifecycle(snapshots: DataFrame) -> DataFrame:
    """First and last day, sightings, spans and the active flag a full replay would leave behind."""
    latest = snapshots.agg(F.max("snapshot_date")).scalar()
    spans = active_spans(snapshots)
    return spans.groupBy("job_id").agg(
        F.min("span_start").alias("first_seen_date"), F.max("span_end").alias("last_seen_date"),
        F.sum("days_seen").alias("days_seen"), F.count(F.lit(1)).alias("spans"),
    ).withColumn("is_active", F.col("last_seen_date") == latest)


_RUN = "array<struct<span_start:date,span_end:date>>"


def _ranks(days: DataFrame) -> tuple:
    """The captured days as two arrays of the calendar's size: by days since the first one the number of captured days up
    to there, and by that number (less one) the day. Also the first day."""
    ordered = days.agg(F.array_sort(F.collect_set("snapshot_date")).alias("days"))
    first = F.get("days", F.lit(0))
    every = ordered.select(F.posexplode("days").alias("place", "day"), first.alias("first")).select(
        "place", F.date_diff("day", "first").alias("since"),
        F.coalesce(F.lead(F.date_diff("day", "first")).over(W.orderBy("place")), F.date_diff("day", "first") + 1).alias("until"))
    by_offset = every.select("place", F.explode(F.sequence("since", F.col("until") - 1)).alias("since")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("since", "place"))), lambda x: x["place"]).alias("ranks"))
    return by_offset.scalar(), ordered.scalar(), ordered.select(first.alias("first")).scalar()


def _joined(runs):
    """Runs of day numbers, sorted by their start, with those that touch or overlap made one."""
    def add(held, x):
        last = F.element_at(held, -1)
        touches = (F.size(held) > 0) & (x["a"] <= F.get(held, F.size(held) - 1)["b"] + 1)
        longer = F.concat(F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0))),
                          F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when(touches, longer).otherwise(F.concat(held, F.array(x)))

    return F.aggregate(runs, F.array().cast("array<struct<a:int,b:int>>"), add)


def merge_spans(held: DataFrame, calendar: DataFrame, seen: DataFrame) -> DataFrame:
    """Span sets after more sightings: (job_id, spans, changed) from the spans of each job so far, the days captured so
    far (``snapshot_date``) and new sightings (job_id, snapshot_date). The history is not read.

    Days may come late, in pieces and again; a sighting is never taken back. A new day splits the spans that lie across
    it of jobs that it does not show; a late one joins spans that only it parts. Only jobs with ``changed`` need writing:
    for a day after all others, those that it shows. A job's array has as many spans as gaps in the calendar at most.
    """
    new = seen.select("snapshot_date").distinct()
    ranks, days, first = _ranks(calendar.select("snapshot_date").unionByName(new))
    added = new.join(calendar.select("snapshot_date").distinct(), "snapshot_date", "left_anti").agg(
        F.array_sort(F.collect_set("snapshot_date"))).scalar()
    batch = seen.groupBy("job_id").agg(F.array_sort(F.collect_set("snapshot_date")).alias("_seen"))
    both = held.select("job_id", "spans").join(batch, "job_id", "full_outer").select(
        "job_id", F.coalesce("spans", F.array().cast(_RUN)).alias("spans"), F.coalesce("_seen", F.array().cast("array<date>")).alias("_seen"),
        ranks.alias("_ranks"), days.alias("_days"), first.alias("_first"), added.alias("_added"))

    def rank(day):
        return F.get("_ranks", F.date_diff(day, F.col("_first")))

    def across(span):
        return F.filter("_added", lambda d: (d > span["span_start"]) & (d < span["span_end"]))

    def pieces(span):
        cuts = F.transform(across(span), rank)
        starts = F.concat(F.array(rank(span["span_start"])), F.transform(cuts, lambda c: c + 1))
        ends = F.concat(F.transform(cuts, lambda c: c - 1), F.array(rank(span["span_end"])))
        return F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] <= x["b"])

    points = F.transform("_seen", lambda d: F.struct(rank(d).alias("a"), rank(d).alias("b")))
    runs = _joined(F.array_sort(F.concat(F.flatten(F.transform("spans", pieces)), points)))
    merged = F.transform(runs, lambda x: F.struct(F.get("_days", x["a"]).alias("span_start"), F.get("_days", x["b"]).alias("span_end")))
    touched = (F.size("_seen") > 0) | F.exists("spans", lambda s: F.size(across(s)) > 0)
    return both.select("job_id", "spans", F.when(touched, merged).otherwise(F.col("spans")).alias("_merged")).select(
        "job_id", F.col("_merged").alias("spans"), (F.col("spans") != F.col("_merged")).alias("changed"))


def spans_as_rows(held: DataFrame, calendar: DataFrame) -> DataFrame:
    """The rows of ``active_spans`` from span sets; a job is seen on every captured day of a span."""
    ranks, _, first = _ranks(calendar)
    each = held.select("job_id", F.inline("spans")).select("*", ranks.alias("_ranks"), first.alias("_first"))

    def rank(day):
        return F.get("_ranks", F.date_diff(day, "_first"))

    return each.select("job_id", "span_start", "span_end", (rank("span_end") - rank("span_start") + 1).cast("bigint").alias("days_seen"))
