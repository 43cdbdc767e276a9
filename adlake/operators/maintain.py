"""Retention and integrity reports (R1-R4); compaction (R5) is in sources.store."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from adlake import fixed_values as fv, schema


def cutoff(as_of: Column, days: int = fv.RETENTION_DAYS) -> Column:
    return F.date_sub(as_of.cast("date"), days)


def retained(table: DataFrame, as_of: Column, days: int = fv.RETENTION_DAYS) -> DataFrame:
    """Rows of the last ``days`` days; a filter on the partition column."""
    return table.filter(F.col("snapshot_date") >= cutoff(as_of, days))


def foreign_key_violations(tables: dict[str, DataFrame], foreign_keys=None) -> DataFrame:
    """R2: (table_name, column_name, key_value, rows) of child keys without a parent.

    Children are counted per key before the join, so a key held by very many rows is one row there.
    """
    reports = []
    for child, column, parent, parent_column in foreign_keys or schema.FOREIGN_KEYS:
        keys = tables[child].filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key")).agg(
            F.count(F.lit(1)).alias("rows"))
        known = tables[parent].select(F.col(parent_column).alias("_key"))
        reports.append(keys.join(known, "_key", "left_anti").select(
            F.lit(child).alias("table_name"), F.lit(column).alias("column_name"),
            F.col("_key").cast("string").alias("key_value"), "rows"))
    return reduce(DataFrame.unionByName, reports)


def duplicate_keys(table: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Keys held by more than one row."""
    keys = keys or schema.UNIQUE_KEYS[name]
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(
        F.lit(name).alias("table_name"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key_value"),
        "rows")


def null_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, nulls) for every NOT NULL column, one scan per table."""
    reports = []
    for name, columns in schema.NOT_NULL.items():
        if name in tables:
            wide = tables[name].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
            reports.append(wide.unpivot([], columns, "column_name", "nulls").select(
                F.lit(name).alias("table_name"), "column_name", "nulls"))
    return reduce(DataFrame.unionByName, reports)
