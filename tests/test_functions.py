import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from adlake import fixed_values as fv
from adlake.functions import keys, labels, pay, place, text


def apply(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x")).alias("y")).collect()]


PAY = [
    (None, None), ("", None), ("do uzgodnienia", None),
    ("12000 PLN", ("PLN", 12000.0, 12000.0, 12000.0, "monthly", False)),
    ("12000 PLN (B2B)", ("PLN", 2.0, 12000.0, 6001.0, "monthly", True)),
    ("20000 - 15000 EUR", ("EUR", 15000.0, 20000.0, 17500.0, "monthly", False)),
    ('23 000  – 26 000PLN+ VAT (B2B) miesięcznieoblicz "na rękę"', ("PLN", 23000.0, 26000.0, 24500.0, "monthly", True)),
    ("13 200  – 16 500PLNbrutto miesięcznie (UoP)oblicz netto", ("PLN", 13200.0, 16500.0, 14850.0, "monthly", True)),
    ("100 - 150 PLN/h", ("PLN", 100.0, 150.0, 125.0, "hourly", False)),
    ("120-150 PLN godz.", ("PLN", 120.0, 150.0, 135.0, "hourly", False)),
    ("200000 - 250000 PLN/rok", ("PLN", 200000.0, 250000.0, 225000.0, "annual", False)),
    ("5000 - 7000 €", ("EUR", 5000.0, 7000.0, 6000.0, "monthly", False)),
    ("$90 - $120 /h", ("USD", 90.0, 120.0, 105.0, "hourly", False)),
]


def test_pay(spark):
    got = apply(spark, [t for t, _ in PAY], pay.parse_pay)
    assert [None if r is None else tuple(r) for r in got] == [want for _, want in PAY]


def test_pay_columns_agree_with_struct(spark):
    df = spark.createDataFrame([(t,) for t, _ in PAY], "x string")
    rows = pay.with_pay(df, "x").select("x", "currency", "salary_min", "salary_max", "salary_avg", "period", "is_b2b").collect()
    want = {t: w or (None,) * 6 for t, w in PAY}
    assert {r.x: tuple(r)[1:] for r in rows} == want


def test_b2b_words_are_a_parameter(spark):
    got = apply(spark, ["13200 - 16500 PLN oblicz netto"], lambda c: pay.parse_pay(c, ["b2b"])["is_b2b"])
    assert got == [False]


PLACES = [
    ("Hybrydowo+1", None, None, None), ("Lokalizacje:Krakow", None, None, None),
    ("Lokalizacje:Warszawa", "office", "Warszawa", "Mazowieckie"), ("Kraków, Warszawa", "office", "Warszawa", "Mazowieckie"),
    ("Warszawa / Zdalnie", "hybrid", "Warszawa", "Mazowieckie"), ("Praca zdalna", "remote", None, None),
    ("REMOTELY from ŁÓDŹ", "hybrid", "Łódź", "Łódzkie"), (None, None, None, None), ("", None, None, None),
]


def test_places(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PLACES)], "i int, x string")
    rows = place.with_place(df, "x").orderBy("i").collect()
    assert [(r.x, r.location_type, r.city, r.region) for r in rows] == PLACES
    assert {r.country for r in rows} == {"Poland"}


def test_categories(spark):
    names = ["Python", "Docker", "Spark", "MongoDB Atlas", "Kafka", "PYTHON 3", "mongodb", None]
    want = ["language", "tool", "language", "language", "other", "language", "database", None]
    assert apply(spark, names, labels.technology_category) == want


def test_seniority(spark):
    words = [None, "", "Starszy", "Team Leader", "Entry level", "Regular", "Młodszy programista"]
    assert apply(spark, words, labels.seniority_level) == ["mid", "mid", "senior", "senior", "junior", "mid", "junior"]


def test_detected_seniority(spark):
    df = spark.createDataFrame([(0, "Regular Dev", "senior team"), (1, "Dev", "a junior role"), (2, "Dev", "x"),
                                (3, "Junior", "senior"), (4, "Entry", "")], "i int, h string, b string")
    got = df.orderBy("i").select(labels.detect_seniority(F.col("h"), F.col("b"))).collect()
    assert [r[0] for r in got] == ["mid", "junior", "mid", "junior", "mid"]


def test_keywords_with_odd_boundaries(spark):
    texts = ["use C# now", "in ASP.NET", "éGo", "Go!", "JAVA, JavaScript", None, "KKubernetes Kubernetes"]
    found = apply(spark, texts, lambda c: text.find_keywords(c, ["C#", ".NET", "ASP.NET", "Go", "Java", "Kubernetes"]))
    assert found == [[], [".NET", "ASP.NET"], [], ["Go"], ["Java"], [], ["Kubernetes"]] or found[5] is None
    assert found[:5] == [[], [".NET", "ASP.NET"], [], ["Go"], ["Java"]] and found[6] == ["Kubernetes"]


def test_clean_text(spark):
    got = apply(spark, ["  a  b\n", " \n ", "a \u0000 b", None, "", " x \x1cy "], text.clean_text)
    assert got == ["a b", None, "a  b", None, None, "x y"]


def test_truncation(spark):
    got = apply(spark, ["a  b", "x" * 12, None, ""], lambda c: text.truncate_description(c, 10))
    assert got == ["a b", "x" * 10 + "...", None, None]


def test_employment(spark):
    words = ["B2B contract", "Pełny etat", "część etatu", "umowa o pracę", "other", None]
    assert apply(spark, words, text.employment_type) == ["b2b", "full-time", "part-time", "contract", None, None]


def test_keys(spark):
    urls = ["https://h/pl/job/abc-1?x=1", "https://h/other"]
    assert apply(spark, urls, keys.job_key_from_url) == ["abc-1", hashlib.md5(b"https://h/other").hexdigest()[:16]]
    none = F.lit(None).cast("string")
    got = apply(spark, urls, lambda u: keys.job_key(none, u, F.lit("t"), F.lit("c")))
    assert got == ["abc-1", hashlib.md5(b"https://h/other_t_c").hexdigest()[:16]]
    assert apply(spark, urls, lambda u: keys.job_key(F.lit("id"), u, F.lit("t"), F.lit("c"))) == ["id", "id"]


def test_formats(spark):
    row = spark.range(1).select(
        text.pln(F.lit(12345.5)), text.pln(F.lit(2.5)), text.pln(F.lit(None).cast("double")),
        text.percent(F.lit(1), F.lit(0)), text.percent(F.lit(1), F.lit(8)), text.title_case(F.lit("remote"))).first()
    assert tuple(row) == ("12,346 PLN", "2 PLN", "N/A", None, 12.5, "Remote")


# --- plain statements of the rules, compared on arbitrary text ----------------

def said_clean(value):
    value = re.sub(r"\s+", " ", (value or "").strip()).replace("\x00", "")
    return value or None


def said_pay(value):
    packed = (value or "").replace(" ", "").replace("\xa0", "")
    runs = [float(r) for r in re.findall("[0-9]+", packed)][:2]
    return (min(runs), max(runs)) if runs else None


def said_city(value):
    low = (value or "").lower()
    return next((city for city, _ in fv.CITY_REGIONS if city.lower() in low), None)


PIECES = st.sampled_from(
    ["12", "7 000", "-", "–", " ", " ", "\n", "\t", "PLN", "EUR", "€", "netto", "/h", "Warszawa", "KRAKÓW", "łódź",
     "Remote", "a", "é", "_", "\x00", " ", "\x1f", "Go", "C#", ".NET", "ASP"])
TEXTS = st.lists(st.lists(PIECES, max_size=8).map("".join), min_size=40, max_size=60)
RELAXED = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@RELAXED
@given(TEXTS)
def test_clean_rule(spark, values):
    assert apply(spark, values, text.clean_text) == [said_clean(v) for v in values]


@RELAXED
@given(TEXTS)
def test_pay_rule(spark, values):
    got = apply(spark, values, pay.parse_pay)
    assert [None if r is None else (r.salary_min, r.salary_max) for r in got] == [said_pay(v) for v in values]


@RELAXED
@given(TEXTS)
def test_city_rule(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    assert [r.city for r in place.with_place(df, "x").orderBy("i").collect()] == [said_city(v) for v in values]


@RELAXED
@given(TEXTS)
def test_keyword_rule(spark, values):
    listed = ["C#", ".NET", "ASP.NET", "Go", "a"]
    want = [[k for k in listed if re.search(r"\b" + re.escape(k) + r"\b", v, re.IGNORECASE)] for v in values]
    assert apply(spark, values, lambda c: text.find_keywords(c, listed)) == want


if __name__ == "__main__":
    pytest.main([__file__])
