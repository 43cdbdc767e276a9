"""Roll-ups that merge over days, and lookups of any size as joins."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from adlake import fixed_values as fv
from adlake.functions.labels import technology_category
from adlake.functions.place import with_place
from adlake.functions.text import find_keywords
from adlake.operators import lookup, rollups
from ads_for_tests import D1

WORDS = ["oak", "elm", "ash", "bay", "fir", "yew", "a", "ix", "ö", "st.", "x y", "-"]


def named(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randrange(1, 4))) for _ in range(n)]


def test_numbers_are_dense_and_stable(spark):
    jobs = spark.createDataFrame([(f"j{i % 500}",) for i in range(700)], "job_id string")
    rows = {r.job_id: r.number for r in rollups.job_numbers(jobs, parts=7).collect()}
    assert sorted(rows.values()) == list(range(500))
    assert rows == {r.job_id: r.number for r in rollups.job_numbers(jobs.repartition(9), parts=7).collect()}


def test_distinct_jobs_over_any_range(spark):
    rng = random.Random(3)
    seen = [(rng.randrange(70_000), D1 + timedelta(days=rng.randrange(12)), rng.choice("ab")) for _ in range(6000)]
    daily = rollups.job_bitmaps(spark.createDataFrame(seen, "number bigint, day date, kind string"), ["day", "kind"]).cache()
    for first, last in ((0, 3), (2, 11), (5, 5)):
        part = daily.where(F.col("day").between(D1 + timedelta(days=first), D1 + timedelta(days=last)))
        inside = [(n, k) for n, d, k in seen if first <= (d - D1).days <= last]
        assert {r.kind: r.job_count for r in rollups.distinct_jobs(part, ["kind"]).collect()} == {k: len({n for n, x in inside if x == k}) for k in "ab"}
        assert rollups.distinct_jobs(part, [F.lit(1).alias("all")]).first().job_count == len({n for n, _ in inside})
    daily.unpersist()


def test_sketches_merge_within_their_bound(spark):
    rng = random.Random(6)
    pay = [(i % 30, float(int(rng.lognormvariate(9, 1)))) for i in range(60_000)]
    daily = rollups.pay_sketches(spark.createDataFrame(pay, "day int, salary_avg double"), ["day"])
    got = rollups.sketched_quantiles(rollups.merged_sketches(daily, [F.lit(1).alias("all")]), {"q1": 0.25, "q2": 0.5, "q9": 0.99}).first()
    values = sorted(v for _, v in pay)
    assert (got.n, got.least, got.most) == (len(values), values[0], values[-1])
    for q, rank in (("q1", 0.25), ("q2", 0.5), ("q9", 0.99)):
        below, upto = sum(v < got[q] for v in values) / len(values), sum(v <= got[q] for v in values) / len(values)
        assert below - 2 * rollups.KLL_ERROR <= rank <= upto + 2 * rollups.KLL_ERROR


def test_place_lookup_as_a_table(spark):
    listed = list(dict.fromkeys(named(1, 60)))
    cities = [(f"{c.title()} town {i}" if i % 3 else c.title(), f"r{i}") for i, c in enumerate(listed)]
    texts = [None, "", "Remote", "zdalnie, " + cities[0][0]] + [f"near {t}, remote" if i % 4 == 0 else t.upper() for i, t in enumerate(named(2, 200))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, place string").repartition(3)
    table = spark.createDataFrame([(i, c, r) for i, (c, r) in enumerate(cities)], "pos int, city string, region string")
    got = lookup.with_place_from(df, "place", table, "pos", "city", "region")
    from adlake.functions.place import city_list
    assert sorted(got.collect()) == sorted(with_place(df, "place", city_list(cities)).select(*got.columns).collect())


def test_hundred_thousand_lookup_rows(spark):
    table = spark.range(100_000).select("id", F.concat(F.lit("City "), F.conv(F.lpad(F.col("id").cast("string"), 6, "0"), 10, 36), F.lit(".")).alias("city"), F.lit("r").alias("region"))
    rows = spark.range(0, 100_000, 997).select(F.col("id").alias("want"), F.concat(F.lit("Remote / CITY "), F.conv(F.lpad(F.col("id").cast("string"), 6, "0"), 10, 36), F.lit(".")).alias("text"))
    got = lookup.with_place_from(rows, "text", table, "id", "city", "region")
    assert got.where(F.col("location_type") != "hybrid").count() == 0 and got.count() == 101
    plan = got._jdf.queryExecution().toString()
    assert "from_json" not in plan and "collect_list" not in plan


def test_category_lookup_as_a_table(spark):
    listed = [(n, c) for c, names in fv.TECHNOLOGY_CATEGORIES for n in names]
    names = [None, "", "React Native", "PostgreSQL", "sql", "Go", "MongoDB Atlas", "nothing"] + [n.upper() + x for n, _ in listed for x in ("", " 2")]
    df = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    table = spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(listed)], "pos int, name string, category string")
    want = df.withColumn("category", technology_category(F.col("name")))
    assert sorted(lookup.categorised_from(df, table).collect(), key=str) == sorted(want.collect(), key=str)


@pytest.mark.parametrize("many", [0, 10_000])
def test_keyword_lookup_as_a_table(spark, many):
    words = ["C++", "C", "c#", ".NET", "Node.js", "R", "oak elm", "st.", "*", "Ö", "_x", "K8s", "oak", "++", "Java", "java"] + [f"w{i}" for i in range(many)]
    texts = ["", None, "c++ and C# or .net", "I use.NET, node.js", "node js R", "oak elm; oak  elm", "the st. x", "a*b", "ö K8S _x x_x", "java JAVA ++i", "w17 w9999 w10000"] + named(9, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    table = spark.createDataFrame(list(enumerate(words)), "pos int, keyword string")
    got = {r.id: r.keywords for r in lookup.keywords_from(docs, "id", "text", table).collect()}
    few = words[:16] + ["w17", "w9999"] * bool(many)
    want = {r.id: r.k for r in docs.select("id", find_keywords(F.col("text"), few).alias("k")).collect() if r.k}
    assert got == want


def test_keys_of_many_rows_and_shared_prefixes_meet_few_candidates(spark):
    """A key's rows are one before the join, and keys that share their short grams do not all meet every text."""
    keys = spark.range(3000).select(F.format_string("customer#%09d", "id").alias("key"))
    texts = spark.range(0, 3000, 100).select(F.format_string("customer#%09d / remote", "id").alias("text"))
    joined = lookup.contained_keys(texts, keys).where("true")
    assert joined.count() == 30
    plan = joined._jdf.queryExecution().toString()
    assert "Broadcast" not in plan
    grams = texts.select("text", F.explode(F.flatten(F.array(*[lookup._grams(F.col("text"), n) for n in lookup._sizes(lookup.GRAM)]))).alias("g"))
    # The largest gram that all of a key's neighbours lack: hundreds of keys shared a text's three-letter grams.
    met = grams.join(keys.select("key", F.explode(lookup._grams(F.col("key"), lookup.GRAM)).alias("g")).groupBy("g").agg(F.count("key").alias("n")), "g")
    assert met.groupBy("text").agg(F.min("n").alias("n")).agg(F.max("n")).first()[0] == 1
    table = spark.range(4000).select(F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, "oak").otherwise("elm").alias("name"), F.col("id").cast("string").alias("category"))
    names = spark.createDataFrame([("oak",), ("elms",), ("fir",), (None,)], "name string")
    found = lookup.categorised_from(names, table)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("oak", "0"), ("elms", "1"), ("fir", fv.OTHER_CATEGORY), (None, None)], key=str)
    assert "first" in found._jdf.queryExecution().analyzed().toString()
