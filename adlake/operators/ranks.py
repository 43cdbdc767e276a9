"""Exact order statistics without gathering a group in one task.

``median`` and ``percentile`` keep every distinct value of a group in one buffer. Here a group is reduced to
(value, count) rows before the shuffle and cut into slices of neighbouring values. Slice totals tell which
slices hold the wanted ranks. Such a slice with very many values is split once more by its own range of values, and only
the parts that hold a wanted rank are sorted, each in a task of its own.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_PER_OCTAVE = 1024
# Distinct values that one task sorts, if they are spread evenly over their slice.
_SORTED = 50_000


def _slice(value: Column) -> Column:
    """A non-decreasing function of the value with a bounded range; nulls come first.

    Any such function gives exact answers. A slice spans less than a thousandth of the value.
    """
    size = F.log2(F.abs(value) + 1)
    place = F.floor(size * _PER_OCTAVE) * F.signum(value).cast("int")
    return F.coalesce(place, F.lit(-(2 ** 40)))


def _at_ranks(df: DataFrame, keys: list[str], value: str, ranks) -> DataFrame:
    """Per group: _n, mean, low, high and ``_at``, a map from wanted 0-based ascending rank to value.

    ``ranks`` makes the array of wanted ranks out of the row count column.
    """
    v, n = F.col(value), F.col("_n")
    counts = df.withColumn("_slice", _slice(v)).groupBy(*keys, "_slice", value).agg(F.count(F.lit(1)).alias("_n"))
    slices = counts.groupBy(*keys, "_slice").agg(
        F.sum("_n").alias("_size"), F.sum(v * n).alias("_sum"), F.sum(F.when(v.isNotNull(), n)).alias("_values"),
        F.min(v).alias("_low"), F.max(v).alias("_high"), F.count(F.lit(1)).alias("_kinds"))
    # One row per slice of a group, so these windows stay small however large the group is.
    group = W.partitionBy(*keys)
    before = group.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    wanted = (
        slices.select(
            *keys, "_slice", "_size", "_low", "_high", "_kinds", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
            F.sum("_size").over(group).alias("n"),
            (F.sum("_sum").over(group) / F.sum("_values").over(group)).alias("mean"),
            F.min("_low").over(group).alias("low"), F.max("_high").over(group).alias("high"))
        .withColumn("_ranks", ranks(F.col("n")))
        .withColumn("_wanted", F.filter(
            "_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_size"))))
        .filter(F.size("_wanted") > 0).drop("_size", "_ranks"))
    n_parts = F.ceil(F.col("_kinds") / _SORTED)
    share = F.try_divide(v - F.col("_low"), F.col("_high") - F.col("_low"))
    part = F.coalesce(F.least(F.floor(share * n_parts), n_parts - 1), F.lit(0))
    inner = W.partitionBy(*keys, "_slice", "_part")
    ahead = W.partitionBy(*keys, "_slice").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    rows = counts.join(wanted, [*keys, "_slice"]).withColumn("_part", part)
    parts = rows.groupBy(*keys, "_slice", "_part").agg(F.sum("_n").alias("_held")).select(
        *keys, "_slice", "_part", "_held", F.coalesce(F.sum("_held").over(ahead), F.lit(0)).alias("_ahead"))
    inside = inner.orderBy(v.asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    first = F.col("_before") + F.col("_ahead")
    picked = (
        rows.join(parts, [*keys, "_slice", "_part"])
        .filter(F.exists("_wanted", lambda r: (r >= first) & (r < first + F.col("_held"))))
        .withColumn("_end", first + F.sum("_n").over(inside))
        .withColumn("_rank", F.explode(F.filter("_wanted", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - n)))))
    # A handful of rows per group: one per wanted rank.
    return picked.groupBy(*keys).agg(
        F.map_from_entries(F.collect_set(F.struct("_rank", v.alias("v")))).alias("_at"),
        *[F.first(c).alias(c) for c in ("n", "mean", "low", "high")])


def summary(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Per group: n, mean, low, high and one linearly interpolated quantile per entry of probs; nulls ignored.

    Groups without values are absent; without keys the result has one row, or none.
    """
    def position(p: float, n: Column) -> Column:
        return F.lit(p).cast("double") * (n - 1)

    def ranks(n: Column) -> Column:
        ends = [end for p in probs.values() for end in (F.floor(position(p, n)), F.ceil(position(p, n)))]
        return F.array_distinct(F.array(*ends))

    def interpolate(p: float) -> Column:
        pos = position(p, F.col("n"))
        low, high = F.col("_at")[F.floor(pos)], F.col("_at")[F.ceil(pos)]
        return low + (high - low) * (pos - F.floor(pos))

    found = _at_ranks(df.filter(F.col(value).isNotNull()), keys, value, ranks)
    found = found if keys else found.filter("n IS NOT NULL")
    return found.select(*keys, "n", "mean", "low", "high", *[interpolate(p).alias(name) for name, p in probs.items()])


def upper_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """M2: the element at offset n/2 (integer division) of the ascending order, nulls first and counted."""
    middle = F.floor(F.col("n") / 2)
    found = _at_ranks(df, keys, value, lambda n: F.array(F.floor(n / 2)))
    return found.select(*keys, F.col("_at")[middle].alias(out))
