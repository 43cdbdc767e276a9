"""Captured pages to raw ads."""

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from adlake import fixed_values as fv
from adlake.functions import keys, labels, text
from adlake.operators import detail_page, page_outline

# The helper travels with the job, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(detail_page)

_NOT_SHOWN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>"
_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
_PAY_IN_TEXT = "(?U)" + fv.PAY_IN_TEXT


def visible(html: Column) -> Column:
    return F.regexp_replace(html, _NOT_SHOWN, "")


def plain(markup: Column) -> Column:
    """Markup without tags; the predefined entities decoded, which in text may lack their semicolon."""
    out = F.regexp_replace(markup, "<[^>]*>", "")
    for entity, char in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "'"), ("&amp;?", "&")):
        out = F.regexp_replace(out, entity, char)
    return out


def site_of(url: Column) -> Column:
    return F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)


def absolute(href: Column, base: Column) -> Column:
    """Resolve against a site root: full, scheme-relative, rooted and relative links."""
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]+:)", 1), href))
        .when(href.startswith("/"), F.concat(base, href))
        .otherwise(F.concat(base, F.lit("/"), href))
    )


def page_links(pages: DataFrame, marker: str = fv.LINK_MARKER, base: Column | None = None) -> DataFrame:
    """(page_id, position, url) of ad links in page order, each once per page.

    Every selector of the contract asks for an anchor whose href holds the marker, so one pass suffices. Links
    are resolved against ``base``, by default the site the page came from.
    """
    base = site_of(F.col("url")) if base is None else base
    raw = F.regexp_extract_all(visible(F.col("html")), F.lit(_HREF), F.lit(1))
    hrefs = F.transform(raw, lambda h: F.replace(F.regexp_replace(h, "^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&")))
    wanted = F.filter(hrefs, lambda h: h.contains(marker))
    urls = F.array_distinct(F.transform(wanted, lambda h: absolute(h, F.col("_base"))))
    return (
        pages.select("page_id", base.alias("_base"), "html").withColumn("_urls", urls)
        .select("page_id", F.posexplode("_urls").alias("position", "url"))
    )


def unique_urls(links: DataFrame) -> DataFrame:
    """Each ad URL once over all pages."""
    return links.select("url").distinct()


def capped(urls: DataFrame, max_jobs: int | None = None) -> DataFrame:
    """The caller's cap on a run's ads, made repeatable by taking them in URL order; none without a number."""
    return urls if max_jobs is None else urls.orderBy("url").limit(max_jobs)


def has_next_page(html: Column) -> Column:
    """Some pagination test has a first hit that is not disabled."""
    shown = visible(html)
    disabled = r"""(?is)^<[^>]*\sdisabled\s*=\s*("[^"]+"|'[^']+'|[^\s"'>]+)"""

    def first_tag(pattern: str) -> Column:
        return F.regexp_extract(shown, pattern, 0)

    by_attribute = [
        r"""(?is)<a\s(?:[^>]*\s)?rel\s*=\s*(?:"next"|'next'|next(?=[\s>]))[^>]*""",
        r"""(?is)<a\s(?:[^>]*\s)?class\s*=\s*(?:"(?:[^"]*\s)?next[\s"]|'(?:[^']*\s)?next[\s']|next[\s>])[^>]*""",
        r"""(?is)<a\s(?:[^>]*\s)?aria-label\s*=\s*(?:"[^"]*next|'[^']*next)[^>]*""",
        r"""(?is)<button\s(?:[^>]*\s)?class\s*=\s*(?:"(?:[^"]*\s)?next[\s"]|'(?:[^']*\s)?next[\s']|next[\s>])[^>]*""",
    ]
    # Class and label values are case-sensitive, tag and attribute names are not.
    by_attribute = [p.replace("next", "(?-i:next)") for p in by_attribute]
    anchors = F.regexp_extract_all(shown, F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0))

    def first_with(word: str) -> Column:
        return F.coalesce(F.get(F.filter(anchors, lambda a: plain(a).contains(word)), F.lit(0)), F.lit(""))

    hits = [first_tag(p) for p in by_attribute] + [first_with("Next"), first_with("Następna")]
    out = F.lit(False)
    for hit in hits:
        out = out | ((hit != "") & ~hit.rlike(disabled))
    return F.coalesce(out, F.lit(False))


def page_heading(html: Column) -> Column:
    """Text of the first h1: pieces stripped and joined without a separator."""
    inner = F.regexp_extract(visible(html), r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1)
    return plain(F.regexp_replace(inner, r"(?U)^\s+|\s+$|\s*(<[^>]*>)\s*", "$1"))


def page_title(html: Column) -> Column:
    """X3 for pages whose title is an h1; X13 covers the class tests as well."""
    heading = page_heading(html)
    return F.when(F.length(heading) > 5, heading).otherwise(F.lit(fv.DEFAULT_TITLE))


def page_walk(most_rows: int = 256, most_text: int = 1 << 20):
    """Field texts of batches of pages, given on after so many pages or so much markup: what a worker holds does not grow with a batch."""
    names = detail_page.FIELDS
    read = detail_page.read_fields

    def parse(batches):
        import pyarrow as pa

        kinds = [pa.list_(pa.string()) if n == "tags" else pa.string() for n in names]
        for batch in batches:
            html, low = batch.column(2), 0
            while low < batch.num_rows:
                rows, size, high = [], 0, low
                while high < batch.num_rows and high - low < most_rows and size < most_text:
                    page = html[high].as_py()
                    rows.append(read(page))
                    size, high = size + len(page or ""), high + 1
                fields = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), *fields],
                                                 names=["page_id", "url", *names])
                low = high

    return parse


def field_texts(pages: DataFrame, python: bool = True) -> DataFrame:
    """Parse each page once into field texts (X3-X9 before defaults).

    ``python=False`` reads the pages by column functions, for executors without Python; the rows are the same and the walk
    takes about a quarter of its time.
    """
    if not python:
        # A number of its own, since AQE would join partitions by their bytes and pages are few bytes for much work.
        parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return page_outline.read_fields(pages.select("page_id", "url", "html").repartition(parts, "page_id"))
    names = detail_page.FIELDS
    kinds = ", ".join(f"{n} {'array<string>' if n == 'tags' else 'string'}" for n in names)
    # A small file is one partition; the walk is worth a shuffle of the pages.
    spread = pages.select("page_id", "url", "html").repartition("page_id")
    return spread.mapInArrow(page_walk(), f"page_id bigint, url string, {kinds}")


def parse_details(pages: DataFrame, keywords: list[str] = fv.TECHNOLOGY_KEYWORDS, max_text: int | None = None,
                  max_technologies: int | None = None, python: bool = True) -> DataFrame:
    """One raw ad per page. Only the markup walk is Python, and not that with ``python=False``; rules on the texts are columns.

    Texts and technologies are whole unless the caller gives a limit.
    """
    def text_of(name: str) -> Column:
        return F.col(name) if max_text is None else F.substring(name, 1, max_text).alias(name)

    found = F.regexp_extract(F.col("page_text"), _PAY_IN_TEXT, 0)
    tags = F.when(F.size("tags") > 0, F.col("tags")).otherwise(text.find_keywords(F.col("page_text"), keywords))
    return field_texts(pages.filter("html <> ''"), python).select(
        "page_id",
        "url",
        keys.job_key_from_url(F.col("url")).alias("job_id"),
        F.coalesce("title", F.lit(fv.DEFAULT_TITLE)).alias("title"),
        F.coalesce("company_name", F.lit(fv.DEFAULT_COMPANY)).alias("company_name"),
        text_of("description"),
        text_of("requirements"),
        F.coalesce("salary", F.nullif(found, F.lit(""))).alias("salary"),
        "location",
        (tags if max_technologies is None else F.slice(tags, 1, max_technologies)).alias("technologies"),
        labels.detect_seniority(F.col("heading"), F.col("page_text")).alias("seniority"),
        text.employment_type(F.col("page_text")).alias("employment_type"),
    )


def listing_prefix(listing: DataFrame, run: str, page: str, stop: Column, max_pages: int | None = None) -> DataFrame:
    """A run's pages up to and including its first stop page, and not beyond the caller's max_pages.

    ``page`` is any column that orders a run's pages. The first stop per run is a plain minimum, so a run with very
    many pages is never sorted in one task.
    """
    listing = listing if max_pages is None else listing.filter(F.col(page) <= max_pages)
    first_stop = listing.groupBy(run).agg(F.min(F.when(stop, F.col(page))).alias("_stop"))
    return (
        listing.join(first_stop, run)
        .filter(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop"))).drop("_stop")
    )


def harvested_pages(listing: DataFrame, max_pages: int | None = None) -> DataFrame:
    """X15 on (run_id, page, n_links, has_next): a page without links ends the run and is itself left out."""
    stop = (F.col("n_links") == 0) | ~F.col("has_next")
    return listing_prefix(listing, "run_id", "page", stop, max_pages).filter("n_links > 0")


def capture_statistics(listing: DataFrame, details: DataFrame, ads: DataFrame) -> DataFrame:
    """Listing pages used, links found, ads parsed and pages that gave no ad, as one row."""
    used = listing.agg(
        F.count(F.lit(1)).alias("pages_scraped"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("jobs_found"))
    parsed = ads.agg(F.count(F.lit(1))).scalar()
    given = details.filter("html <> ''").agg(F.count(F.lit(1))).scalar()
    return used.withColumn("jobs_scraped", parsed).withColumn("errors", given - F.col("jobs_scraped"))
