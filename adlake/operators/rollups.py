"""Mergeable summaries per day: exact bitmaps of jobs and quantile sketches of pay.

Counts of distinct jobs and quantiles do not add up over days; bitmaps and sketches do. A load writes them for its days,
and any range of days or coarser grouping is answered from them without reading links, snapshots or pay again.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

# Documented by the sketch: normalised rank error of a single quantile at 99 % for this k.
KLL_K, KLL_ERROR = 400, 0.007


def job_numbers(jobs: DataFrame, parts: int = 1024) -> DataFrame:
    """(job_id, number): dense numbers from 0 for distinct jobs; a pure function of the set, so it needs no writing.

    Bitmaps hold 32768 numbers each and are dense only if the numbers are. Jobs are numbered within hash parts, each
    on from where the parts before it end.
    """
    keyed = jobs.select("job_id").distinct().withColumn("_part", F.pmod(F.xxhash64("job_id"), F.lit(parts)))
    sizes = keyed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begin = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_begin"))  # one row per part
    place = F.row_number().over(Window.partitionBy("_part").orderBy("job_id")) - 1
    return keyed.withColumn("_place", place).join(begin, "_part").select("job_id", (F.col("_begin") + F.col("_place")).cast("long").alias("number"))


def job_bitmaps(rows: DataFrame, by: list[str | Column], number: str = "number") -> DataFrame:
    """Per group and block of numbers, the bitmap of the jobs in it."""
    return rows.groupBy(*by, F.bitmap_bucket_number(number).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("jobs"))


def merged_bitmaps(bitmaps: DataFrame, by: list[str | Column]) -> DataFrame:
    """The same for coarser groups: fewer columns, or expressions of them."""
    return bitmaps.groupBy(*by, "block").agg(F.bitmap_or_agg("jobs").alias("jobs"))


def distinct_jobs(bitmaps: DataFrame, by: list[str | Column]) -> DataFrame:
    """The exact number of distinct jobs per group, as job_count."""
    merged = merged_bitmaps(bitmaps, by)
    return merged.groupBy(*[c for c in merged.columns if c not in ("block", "jobs")]).agg(F.sum(F.bitmap_count("jobs")).alias("job_count"))


def technology_bitmaps(t) -> DataFrame:
    """M6's daily roll-up: jobs per technology and day."""
    numbered = t["job_technologies"].select("job_id", "technology_id", "snapshot_date").join(job_numbers(t["job_postings"]), "job_id")
    return job_bitmaps(numbered, ["technology_id", "snapshot_date"])


def place_bitmaps(t) -> DataFrame:
    """M7's and A22's daily roll-up: jobs per day, type, city and region."""
    numbered = t["job_snapshots"].select("job_id", "snapshot_date", "location_type", "city", "region").join(job_numbers(t["job_postings"]), "job_id")
    return job_bitmaps(numbered, ["snapshot_date", "location_type", "city", "region"])


def pay_sketches(salaries: DataFrame, by: list[str | Column], amount: str = "salary_avg", k: int = KLL_K) -> DataFrame:
    """Per group the sketch of an amount, with its count and exact bounds."""
    return salaries.groupBy(*by).agg(
        F.kll_sketch_agg_double(amount, k).alias("sketch"), F.count(amount).alias("n"), F.min(amount).alias("least"), F.max(amount).alias("most"))


def merged_sketches(sketches: DataFrame, by: list[str | Column]) -> DataFrame:
    return sketches.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def sketched_quantiles(sketches: DataFrame, ranks: dict[str, float]) -> DataFrame:
    """The sketches' groups with one column per named rank; the true rank is off by KLL_ERROR at most, at 99 %."""
    return sketches.withColumns({n: F.kll_sketch_get_quantile_double("sketch", F.lit(r)) for n, r in ranks.items()}).drop("sketch")
