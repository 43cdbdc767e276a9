"""The star schema of orders, line items and events read as a job-market history.

A customer is an ad, a month of orders is a capture day (the newest may hold few ads), the parts of an order are its technologies. Pay,
location and level are first written as free text and then parsed like captured ads.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adlake import schema
from adlake.functions.keys import technology_key
from adlake.functions.labels import seniority_level
from adlake.functions.pay import with_pay
from adlake.functions.place import city_list_from, with_place

# Schemas found in the file footers; naming them saves a footer job per later read.
_SCHEMAS: dict = {}

_LEVEL_WORDS = {"F": "Senior", "O": "Regular", "P": "Junior"}


class StarHistory:
    """The seven tables, each derived when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._start = spark, folder, None

    def read(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def latest(self) -> Column:
        """The newest month, found by a subquery over that one column when the query runs."""
        return self.read("orders").agg(F.trunc(F.max("o_orderdate").cast("date"), "MONTH")).scalar()

    def recent(self, days: int) -> "StarHistory":
        """The same postings, with the dated tables cut to months from ``days`` before the newest one on.

        The cut is a plain value on the order date itself: a scan skips by values, not by subqueries. One date is
        read for it, from the one column.
        """
        out = StarHistory(self.spark, self.folder)
        month = F.trunc(F.max("o_orderdate").cast("date"), "MONTH")
        found = self.read("orders").agg(month.alias("latest"), F.trunc(F.date_sub(month, days), "MONTH").alias("start")).first()
        out._start = F.lit(found.start).cast("timestamp_ntz")
        out.__dict__.update(latest=F.lit(found.latest).cast("date"), job_postings=self.job_postings)
        return out

    @cached_property
    def monthly_orders(self) -> DataFrame:
        """Every order with its month, copies per ad and month included."""
        orders = self.read("orders") if self._start is None else self.read("orders").filter(F.col("o_orderdate") >= self._start)
        return orders.withColumn("snapshot_date", F.trunc(F.col("o_orderdate").cast("date"), "MONTH"))

    @cached_property
    def kept_orders(self) -> DataFrame:
        """The order that stands for an ad in a month: the largest key. Copies combine before the shuffle."""
        best = self.monthly_orders.groupBy("o_custkey", "snapshot_date").agg(
            F.max(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority")).alias("o"))
        return best.select("o_custkey", "snapshot_date", "o.*", _job_id().alias("job_id"))

    def postings_of(self, orders: DataFrame, latest: Column) -> DataFrame:
        """The posting state after the days of ``orders``: text of the first day, active if seen on the last."""
        spans = orders.groupBy("o_custkey").agg(
            F.min("snapshot_date").alias("first_seen_date"), F.max("snapshot_date").alias("last_seen_date"),
            F.min_by("o_orderstatus", F.struct("snapshot_date", "o_orderkey")).alias("o_orderstatus"))
        never = F.lit(None).cast("timestamp")
        return self.with_ad_text(spans).select(
            "job_id", "title", "company_name", "url", "first_seen_date", "last_seen_date",
            (F.col("last_seen_date") == latest).alias("is_active"),
            never.alias("created_at"), never.alias("updated_at"))

    def with_ad_text(self, rows: DataFrame) -> DataFrame:
        customer = self.read("customer").select("c_custkey", "c_name", "c_mktsegment")
        return rows.join(customer, rows.o_custkey == customer.c_custkey).withColumns({
            "job_id": _job_id(),
            "title": F.concat_ws(" ", _level_word(F.col("o_orderstatus")), "c_mktsegment", F.lit("Developer")),
            "company_name": F.col("c_name"),
            "url": F.concat(F.lit("https://jobs.example/job/"), _job_id()),
        })

    @cached_property
    def job_postings(self) -> DataFrame:
        return self.postings_of(self.kept_orders, self.latest)

    @cached_property
    def cities(self) -> Column:
        """25 nations and 5 regions at any scale."""
        nation, region = self.read("nation"), self.read("region")
        lookup = nation.join(region, nation.n_regionkey == region.r_regionkey)
        return city_list_from(lookup, "n_nationkey", "n_name", "r_name")

    def with_location(self, orders: DataFrame) -> DataFrame:
        customer = self.read("customer").select("c_custkey", "c_nationkey")
        nation = self.read("nation").select("n_nationkey", "n_name")
        first = F.substring("o_orderpriority", 1, 1)
        text = (
            F.when(first == "1", F.lit("Remote")).when(first == "2", F.concat(F.col("n_name"), F.lit(" / Remote")))
            .when(first.isin("3", "4"), F.col("n_name")))
        joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
            nation, F.col("c_nationkey") == nation.n_nationkey)
        return joined.withColumn("location_text", text)

    def snapshots_of(self, orders: DataFrame) -> DataFrame:
        nothing = F.lit(None).cast("string")
        return with_place(self.with_location(orders), "location_text", self.cities).select(
            "job_id", "snapshot_date", nothing.alias("description"), nothing.alias("requirements"), "location_type",
            "city", "region", "country", seniority_level(_level_word(F.col("o_orderstatus"))).alias("seniority_level"),
            nothing.alias("employment_type"))

    @cached_property
    def job_snapshots(self) -> DataFrame:
        return self.snapshots_of(self.kept_orders)

    @cached_property
    def salary_texts(self) -> DataFrame:
        """Pay text of the kept orders that have lines."""
        lines = self.read("lineitem")
        if self._start is not None:  # few orders: their lines only
            lines = lines.join(self.kept_orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
        lines = lines.groupBy("l_orderkey").agg(
            F.floor(F.min("l_extendedprice")).alias("low"), F.floor(F.max("l_extendedprice")).alias("high"))
        currency = F.when(F.col("o_orderpriority").startswith("5"), "EUR").otherwise("PLN")
        amount = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(
            F.concat_ws(" - ", "low", "high"))
        orders = self.kept_orders
        return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
            "job_id", "snapshot_date", F.concat_ws(" ", amount, currency).alias("salary_text"))

    @cached_property
    def salaries(self) -> DataFrame:
        return with_pay(self.salary_texts, "salary_text").drop("salary_text").filter("salary_min IS NOT NULL")

    @cached_property
    def technologies(self) -> DataFrame:
        return self.read("part").groupBy(F.col("p_name").alias("name")).agg(
            F.min_by("p_type", "p_partkey").alias("category")).select(
            technology_key(F.col("name")).alias("technology_id"), "name", "category")

    def links_of(self, orders: DataFrame) -> DataFrame:
        """Distinct technologies per ad and day; the orders come last, so that the lines are shuffled to their
        order once and the copies of a part within an ad and day combine there."""
        lines = self.read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        part = self.read("part").select("p_partkey", technology_key(F.col("p_name")).alias("technology_id"))
        named = lines.join(part, lines.l_partkey == part.p_partkey).select("l_orderkey", "technology_id", "l_linenumber")
        return (
            named.join(orders.select("o_orderkey", "o_custkey", "snapshot_date"), F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("o_custkey", "snapshot_date", "technology_id").agg(F.min("l_linenumber").alias("first_line"))
            .select(_job_id().alias("job_id"), "technology_id",
                    F.when(F.col("first_line") == 1, "required").alias("proficiency_level"), "snapshot_date"))

    @cached_property
    def job_technologies(self) -> DataFrame:
        return self.links_of(self.kept_orders)

    @cached_property
    def daily_metrics(self) -> DataFrame:
        from adlake.operators.metrics import metrics_by_date

        return metrics_by_date(self.job_postings, self.job_snapshots, self.salaries)

    @cached_property
    def scrape_runs(self) -> DataFrame:
        def kind(name):
            return F.count_if(F.col("event_type") == name)

        return self.read("events").groupBy(F.col("ts").cast("date").alias("day")).agg(
            F.max("ts").cast("timestamp").alias("run_date"), F.count(F.lit(1)).alias("jobs_found"),
            kind("signup").alias("jobs_new"), kind("view").alias("jobs_updated"), kind("error").alias("jobs_expired"),
            F.when(kind("error") > kind("purchase"), "failed").otherwise("success").alias("status"),
            F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("double").alias("duration_seconds"),
        ).drop("day")

    @cached_property
    def listing(self) -> DataFrame:
        """Events as listing pages: run = user, place = time order, stop = an error event."""
        return self.read("events").select(
            F.col("user_id").alias("run_id"), F.struct("ts", "event_id").alias("place"), (F.col("event_type") == "error").alias("stop"))

    def all(self) -> dict[str, DataFrame]:
        return {name: self[name] for name in schema.TABLES}


def _job_id() -> Column:
    return F.concat(F.lit("job-"), F.col("o_custkey").cast("string"))


def _level_word(status: Column) -> Column:
    out = None
    for code, word in _LEVEL_WORDS.items():
        out = F.when(status == code, word) if out is None else out.when(status == code, word)
    return out


def raw_ads(t: StarHistory) -> DataFrame:
    """Every order as a captured ad with its month as snapshot_date, for loads into a store; ``seq`` is the order's key."""
    part = t.read("part").select("p_partkey", "p_name")
    lines = t.read("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice").join(part, F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.groupBy("l_orderkey").agg(  # seven lines an order at most
        F.floor(F.min("l_extendedprice")).alias("low"), F.floor(F.max("l_extendedprice")).alias("high"), F.collect_set("p_name").alias("technologies"))
    amount = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws(" - ", "low", "high"))
    currency = F.when(F.col("o_orderpriority").startswith("5"), "EUR").otherwise("PLN")
    values = {
        "salary": F.when(F.col("low").isNotNull(), F.concat_ws(" ", amount, currency)), "location": F.col("location_text"),
        "technologies": F.coalesce("technologies", F.array().cast("array<string>")), "seniority": _level_word(F.col("o_orderstatus"))}
    # The lines meet the orders while these are narrow; the customers' texts come last, both by the same key.
    orders = t.monthly_orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "snapshot_date")
    held = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    joined = t.with_location(t.with_ad_text(held).drop("c_custkey", "c_name", "c_mktsegment"))
    named = ("job_id", "title", "company_name", "url")
    columns = [(F.col(f.name) if f.name in named else values.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema.RAW]
    return joined.select(*columns, "snapshot_date", F.col("o_orderkey").alias("seq"))
