"""Pay text to numbers."""

from pyspark.sql import Column, DataFrame, functions as F

from adlake import fixed_values as fv
from adlake.functions.text import any_of


def _packed(text: Column) -> Column:
    return F.translate(text, "  ", "")


def _numbers(packed: Column) -> tuple[Column, Column]:
    """The first two digit runs; a single run counts twice. Each is cut out by its own short search."""
    first = F.nullif(F.regexp_extract(packed, "([0-9]+)", 1), F.lit("")).cast("double")
    second = F.nullif(F.regexp_extract(packed, "[0-9]+[^0-9]+([0-9]+)", 1), F.lit("")).cast("double")
    return first, F.coalesce(second, first)


def _fields(packed: Column, a: Column, b: Column, b2b_words: list[str]) -> dict[str, Column]:
    lowered, given = F.lower(packed), a.isNotNull()
    currency = (
        F.when(any_of(packed, fv.EURO_MARKS), "EUR").when(any_of(packed, fv.DOLLAR_MARKS), "USD").otherwise(fv.DEFAULT_CURRENCY))
    period = (
        F.when(packed.contains(fv.HOURLY_MARK) | any_of(lowered, fv.HOURLY_WORDS), "hourly")
        .when(packed.contains(fv.ANNUAL_MARK) | any_of(lowered, fv.ANNUAL_WORDS), "annual").otherwise("monthly"))
    return {
        "currency": F.when(given, currency),
        "salary_min": F.least(a, b),
        "salary_max": F.greatest(a, b),
        "salary_avg": (a + b) / F.lit(2.0).cast("double"),
        "period": F.when(given, period),
        "is_b2b": F.when(given, any_of(lowered, b2b_words)),
    }


def parse_pay(text: Column, b2b_words: list[str] = fv.B2B_WORDS) -> Column:
    """N1-N4 as one struct, null when the text has no digits.

    The b2b word list is a parameter because 'net' also hits 'netto' in ads for employment contracts.
    """
    packed = _packed(text)
    a, b = _numbers(packed)
    return F.when(a.isNotNull(), F.struct(*[c.alias(n) for n, c in _fields(packed, a, b, b2b_words).items()]))


def with_pay(df: DataFrame, text: str, b2b_words: list[str] = fv.B2B_WORDS) -> DataFrame:
    """N1-N4 as columns of a frame, all null when the text has no digits.

    The fields leave through ``inline``, so that a later filter on one of them is not pushed below the parsing
    and does not parse the text again.
    """
    packed, a, b = F.col("_packed"), F.col("_a"), F.col("_b")
    first, second = _numbers(packed)
    step = df.withColumn("_packed", _packed(F.col(text))).withColumns({"_a": first, "_b": second})
    fields = F.struct(*[c.alias(n) for n, c in _fields(packed, a, b, b2b_words).items()])
    return step.select(*df.columns, F.inline(F.array(fields)))
