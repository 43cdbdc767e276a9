"""Raw ads to checked records."""

from pyspark.sql import Column, DataFrame, functions as F

from adlake import fixed_values as fv
from adlake.functions.text import clean_text

REQUIRED = ["job_id", "title", "company_name", "url"]


def _given(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def reject_reason() -> Column:
    """F1 and F2 as one column: why a raw ad is refused, null when it is fine.

    Length tests look at cleaned text; text that cleans to nothing is refused like text that is too short.
    """
    return _reason(clean_text(F.col("title")), clean_text(F.col("company_name")))


def _reason(title: Column, company: Column) -> Column:
    reason = None
    for name in REQUIRED:
        missing = F.lit(f"missing {name}")
        reason = F.when(~_given(name), missing) if reason is None else reason.when(~_given(name), missing)
    return (
        reason.when(F.coalesce(F.length(title), F.lit(0)) < 3, "title too short")
        .when(F.coalesce(F.length(company), F.lit(0)) < 2, "company too short")
        .when(~F.col("url").startswith("http"), "bad url")
    )


def with_reason(raw: DataFrame) -> DataFrame:
    # In steps, so that each text is cleaned once per row and not once per test of it.
    step = raw.withColumns({"_title": clean_text(F.col("title")), "_company": clean_text(F.col("company_name"))})
    return step.withColumn("reason", _reason(F.col("_title"), F.col("_company"))).drop("_title", "_company")


def accepted(raw: DataFrame) -> DataFrame:
    return with_reason(raw).filter("reason IS NULL").drop("reason")


def quarantined(raw: DataFrame) -> DataFrame:
    return with_reason(raw).filter("reason IS NOT NULL")


def reject_counts(raw: DataFrame) -> DataFrame:
    """rows per reason; 'accepted' for the good ones."""
    return with_reason(raw).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(
        F.count(F.lit(1)).alias("rows"))


def records(raw: DataFrame, run_date: Column, judged: bool = False) -> DataFrame:
    """accepted raw ads as posting / snapshot / salary structs and a technology array.

    ``judged`` says that ``raw`` holds accepted ads alone, which are then not judged again. A ``seq`` column, where present, is kept: it orders copies of one ad inside a batch.
    """
    carried = [c for c in ("seq",) if c in raw.columns]
    cleaned = raw if judged else accepted(raw)
    return cleaned.select(
        *carried,
        F.struct(
            "job_id",
            clean_text(F.col("title")).alias("title"),
            clean_text(F.col("company_name")).alias("company_name"),
            "url",
            run_date.cast("date").alias("first_seen_date"),
            run_date.cast("date").alias("last_seen_date"),
            F.lit(True).alias("is_active"),
        ).alias("job_posting"),
        F.struct(
            clean_text(F.col("description")).alias("description"),
            clean_text(F.col("requirements")).alias("requirements"),
            "location", "seniority", "employment_type",
        ).alias("snapshot"),
        F.struct(F.col("salary").alias("salary_text")).alias("salary"),
        F.coalesce("technologies", F.array().cast("array<string>")).alias("technologies"),
    )


def only_listed(df: DataFrame, **lists: list[str]) -> DataFrame:
    """keep rows whose column value is listed; an empty list keeps all."""
    for column, values in lists.items():
        if values:
            df = df.filter(F.col(column).isin(list(values)))
    return df


def without_fields(raw: DataFrame, skills=True, salary=True, description=True, requirements=True) -> DataFrame:
    """F16: blank the fields that are switched off."""
    off = {
        "technologies": (skills, F.array().cast("array<string>")),
        "salary": (salary, F.lit(None).cast("string")),
        "description": (description, F.lit(None).cast("string")),
        "requirements": (requirements, F.lit(None).cast("string")),
    }
    return raw.withColumns({name: blank for name, (on, blank) in off.items() if not on})
