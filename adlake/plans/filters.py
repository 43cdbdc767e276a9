"""Shared filters (F7-F12) and date presets."""

from pyspark.sql import Column, DataFrame, functions as F

PRESETS = {"Last 7 days": 7, "Last 30 days": 30, "Last 90 days": 90, "All time": None}


def active(postings: DataFrame) -> DataFrame:
    """F7."""
    return postings.filter("is_active")


def in_range(df: DataFrame, date_from=None, date_to=None, column: str = "snapshot_date") -> DataFrame:
    """F8: inclusive on both ends, each end optional; prunes date partitions."""
    if date_from is not None:
        df = df.filter(F.col(column) >= _date(date_from))
    if date_to is not None:
        df = df.filter(F.col(column) <= _date(date_to))
    return df


def preset_range(name: str, as_of) -> tuple[Column | None, Column | None]:
    """start and end of a named range that ends on as_of."""
    days = PRESETS[name]
    if days is None:
        return None, None
    return F.date_sub(_date(as_of), days), _date(as_of)


def in_pln(pay: DataFrame) -> DataFrame:
    """F10."""
    return pay.filter(F.col("currency") == "PLN")


def _date(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("date")


def top(df: DataFrame, n: int, by: str, *names: str) -> DataFrame:
    """Largest n by a measure; the names break ties."""
    return df.orderBy(F.desc(by), *names).limit(n)
