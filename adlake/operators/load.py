"""Keyed merges of one day's batch into the history tables."""

from pyspark.sql import Column, DataFrame, functions as F

from adlake.functions.keys import technology_key


def last_per_key(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """L4: the last copy per key, as an aggregate: copies are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_last"))
    return best.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def first_per_key(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("_first"))
    return best.select(*keys, *[F.col("_first")[c].alias(c) for c in rest])


def merge_postings(old: DataFrame, batch: DataFrame, now: Column, complete: bool = True) -> DataFrame:
    """L2, L3, L8, L9 for one day or many: the new posting state, with ``change`` and ``copies`` per posting.

    ``batch`` holds job_id, title, company_name, url, snapshot_date and seq, copies included. Known postings keep
    their text, a new one takes that of its first copy; first and last day stretch in both directions, so days may
    come late. A ``complete`` batch holds all ads of its newest day: a posting without an ad there expires, unless
    the store already knows a later day. Otherwise what was last seen before the newest day expires. An empty batch
    expires nothing.
    """
    seen = batch.groupBy("job_id").agg(
        F.min_by(F.struct("title", "company_name", "url"), F.struct("snapshot_date", "seq")).alias("_ad"),
        F.count(F.lit(1)).alias("copies"), F.min("snapshot_date").alias("_from"), F.max("snapshot_date").alias("_to"))
    stored = old.withColumn("_was_active", F.col("is_active"))
    newest_old, newest_batch = old.agg(F.max("last_seen_date")).scalar(), batch.agg(F.max("snapshot_date")).scalar()
    known, hit = F.col("_was_active").isNotNull(), F.col("copies").isNotNull()
    last_seen = F.greatest("last_seen_date", "_to")
    if complete:
        late = newest_batch.isNull() | F.coalesce(newest_old > newest_batch, F.lit(False))
        is_active = F.when(late, F.coalesce("_was_active", F.lit(False))).otherwise(F.coalesce(F.col("_to") == newest_batch, F.lit(False)))
    else:
        is_active = last_seen == F.greatest(newest_old, newest_batch)
    merged = stored.join(seen, "job_id", "full_outer").withColumns({"_last": last_seen, "_now": is_active})
    return merged.select(
        "job_id",
        *[F.coalesce(c, F.col("_ad")[c]).alias(c) for c in ("title", "company_name", "url")],
        F.least("first_seen_date", "_from").alias("first_seen_date"),
        F.col("_last").alias("last_seen_date"),
        F.col("_now").alias("is_active"),
        F.when(known, F.col("created_at")).otherwise(now).alias("created_at"),
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(~known, "new").when(hit, "updated").when(F.col("_was_active") & ~F.col("_now"), "expired").otherwise("kept").alias("change"),
        F.coalesce("copies", F.lit(0)).cast("bigint").alias("copies"),
    )


def expired(old: DataFrame, batch_keys: DataFrame) -> DataFrame:
    """L8 alone: active postings that the batch does not hold."""
    return old.filter("is_active").join(batch_keys.select("job_id"), "job_id", "left_anti")


def replace_by_key(old_day: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The day's rows with batch rows in place of old ones of the same key."""
    return old_day.join(batch.select(*keys), keys, "left_anti").unionByName(batch)


def insert_or_ignore(old_day: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The day's rows plus batch rows whose key is not there yet."""
    return old_day.unionByName(batch.join(old_day.select(*keys), keys, "left_anti"))


def new_technologies(dimension: DataFrame, named: DataFrame, seq: str) -> DataFrame:
    """Names the dimension lacks, with the category of their first occurrence."""
    first = named.groupBy("name").agg(F.min_by("category", seq).alias("category"))
    return first.join(dimension.select("name"), "name", "left_anti").select(
        technology_key(F.col("name")).alias("technology_id"), "name", "category")


def technology_links(named: DataFrame, dimension: DataFrame) -> DataFrame:
    """Distinct (job, technology, day) links; the key comes from the dimension."""
    return named.select("job_id", "name", "snapshot_date").distinct().join(dimension.select("technology_id", "name"), "name").select(
        "job_id", "technology_id", F.lit(None).cast("string").alias("proficiency_level"), "snapshot_date")


def load_statistics(postings: DataFrame, technologies_new: Column, errors: Column) -> DataFrame:
    """L3, L12 out of the merged postings: further copies of a new key count as updates."""
    return postings.agg(
        F.coalesce(F.count_if(F.col("change") == "new"), F.lit(0)).alias("jobs_new"),
        F.coalesce(F.sum("copies") - F.count_if(F.col("change") == "new"), F.lit(0)).alias("jobs_updated"),
        F.coalesce(F.count_if(F.col("change") == "expired"), F.lit(0)).alias("jobs_expired"),
    ).withColumns({"technologies_new": technologies_new, "errors": errors})


def without_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Drop all rows of the given jobs."""
    return table.join(keys.select("job_id"), "job_id", "left_anti")
