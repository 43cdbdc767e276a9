"""Location text to type, city and region."""

from pyspark.sql import Column, DataFrame, functions as F

from adlake import fixed_values as fv
from adlake.functions.text import any_of, first_inside, literal_rows


def city_list(pairs: list[tuple[str, str]] = fv.CITY_REGIONS) -> Column:
    """The ordered city lookup as an array literal."""
    return literal_rows([{"key": city.lower(), "city": city, "region": region} for city, region in pairs])


def city_list_from(lookup: DataFrame, order: str, city: str, region: str) -> Column:
    """The same array out of a fixed-size lookup table, read once by a scalar subquery."""
    rows = F.array_sort(F.collect_list(F.struct(
        F.col(order).alias("pos"), F.lower(F.col(city)).alias("key"),
        F.col(city).alias("city"), F.col(region).alias("region"),
    )))
    return lookup.agg(rows.alias("cities")).scalar()


def with_place(df: DataFrame, text: str, cities: Column | None = None) -> DataFrame:
    """Add location_type, city, region, country. First city in lookup order wins, not first in the text."""
    low = F.lower(F.col(text))
    hit = first_inside(low, F.col("_cities"))
    # In steps, so that the lookup runs once per row and not once per derived column.
    step = df.withColumn("_cities", city_list() if cities is None else cities).withColumn("_place", hit)
    return place_columns(step, low).drop("_cities", "_place")


def place_columns(df: DataFrame, low: Column) -> DataFrame:
    """The four columns of N5 out of ``_place`` (city, region; null where none was found) and the lower-cased text."""
    has_city = F.col("_place").isNotNull()
    return df.withColumn("_remote", F.coalesce(any_of(low, fv.REMOTE_WORDS), F.lit(False))).withColumns({
        "location_type": F.when(F.col("_remote") & has_city, "hybrid")
        .when(F.col("_remote"), "remote").when(has_city, "office"),
        "city": F.col("_place.city"),
        "region": F.col("_place.region"),
        "country": F.lit(fv.DEFAULT_COUNTRY),
    }).drop("_remote")
