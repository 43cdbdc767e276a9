"""Ad keys out of URLs (X2, F6) and surrogate keys."""

from pyspark.sql import Column, functions as F

from adlake import fixed_values as fv


def _slug(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, fv.SLUG_IN_URL, 1), F.lit(""))


def _short_md5(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 16)


def job_key_from_url(url: Column) -> Column:
    """The slug after /job/, else 16 hex digits of the URL's MD5."""
    return F.coalesce(_slug(url), _short_md5(url))


def job_key(job_id: Column, url: Column, title: Column, company: Column) -> Column:
    """given id, else URL slug, else 16 hex digits of MD5(url_title_company) with nulls as empty."""
    blank = F.lit("")
    parts = [F.coalesce(c, blank) for c in (url, title, company)]
    return F.coalesce(F.nullif(job_id, blank), _slug(url), _short_md5(F.concat_ws("_", *parts)))


def technology_key(name: Column) -> Column:
    """Surrogate key that every task computes alike, so no central counter is needed."""
    return F.xxhash64(name)
