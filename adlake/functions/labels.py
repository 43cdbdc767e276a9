"""Technology categories and seniority levels."""

from pyspark.sql import Column, functions as F

from adlake import fixed_values as fv
from adlake.functions.text import any_of, bound, literal_rows


def technology_category(name: Column, categories=None) -> Column:
    """Exact name first, then the first listed name contained in it, else 'other'.

    Apply to distinct names: the technology dimension does.
    """
    pairs = [(n.lower(), c) for c, names in (categories or fv.TECHNOLOGY_CATEGORIES) for n in names]
    listed = literal_rows([{"key": n, "category": c} for n, c in pairs])

    def decide(low: Column) -> Column:
        # An exact name is also contained, so it is looked for among the few names that are.
        return bound(F.filter(listed, lambda p: low.contains(p["key"])), lambda hits: F.coalesce(
            F.get(F.filter(hits, lambda p: p["key"] == low), F.lit(0))["category"], F.get(hits, F.lit(0))["category"]))

    return F.when(name.isNotNull(), F.coalesce(bound(F.lower(name), decide), F.lit(fv.OTHER_CATEGORY)))


def seniority_level(text: Column) -> Column:
    """N7 (and N8 when given a title): senior words, then junior words, else mid."""
    low = F.lower(text)
    return F.when(any_of(low, fv.SENIOR_WORDS), "senior").when(any_of(low, fv.JUNIOR_ENTRY_WORDS), "junior").otherwise("mid")


def detect_seniority(heading: Column, body: Column) -> Column:
    """X11: the heading decides if it can, else the page text, else mid."""
    top, low = F.lower(heading), F.lower(body)
    return (
        F.when(any_of(top, fv.SENIOR_WORDS), "senior")
        .when(any_of(top, fv.JUNIOR_WORDS), "junior")
        .when(any_of(top, fv.MID_WORDS), "mid")
        .when(any_of(low, fv.BODY_SENIOR_WORDS), "senior")
        .when(any_of(low, fv.BODY_JUNIOR_WORDS), "junior")
        .otherwise("mid")
    )
