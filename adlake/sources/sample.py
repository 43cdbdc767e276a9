"""Synthetic ads for trials at any size (S10): every field is a function of the ad's number, the seed and a profile."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Profile:
    """What the ads are drawn from. Earlier entries of a list are drawn more often, by ``skew`` (1: all alike)."""

    # Level: (share of ads, median monthly pay, log spread of pay).
    levels: dict = field(default_factory=lambda: {"junior": (0.2, 6400, 0.12), "mid": (0.5, 12300, 0.15), "senior": (0.3, 21500, 0.18)})
    companies: tuple = ("Heron and Sons", "Marsh Atlas", "Tadpole Lab", "Otter Works", "Reedbed Systems", "Kingfisher Data", "Lockgate")
    skills: tuple = ("Kafka", "Rust", "Scala", "Airflow", "Kotlin", "SQLite", "Swift", "Cassandra", "Svelte", "Julia", "Neo4j", "Rails", "Jira",
                     "Laravel", "Vagrant", "Confluence", "Linode", "Heroku")
    places: tuple = ("Gdynia", "Łódź", "Lublin", "Toruń", "Rzeszów", "Sopot", "Bydgoszcz", "Remote", "Gdynia, remote", "Łódź, hybrid")
    contracts: tuple = ("permanent", "B2B", "contract of mandate")
    currencies: tuple = ("PLN", "PLN", "PLN", "EUR")
    fewest_skills: int = 3
    most_skills: int = 6
    pay_width: float = 0.25  # the upper end of pay is at most so much above the lower
    skew: float = 1.7


class _Ad:
    """Draws in [0, 1) that depend on the ad, the seed and a name alone, not on partitions."""

    def __init__(self, seed: int):
        self.seed = seed

    def draw(self, name: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(name), F.col("id")), F.lit(1 << 40)) / float(1 << 40)

    def one_of(self, name: str, values: tuple, skew: float = 1.0) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.pow(self.draw(name), F.lit(skew)) * len(values)) + 1).cast("int"))

    def some_of(self, name: str, values: tuple, number: Column, skew: float) -> Column:
        """Distinct values by weighted keys: the least of draw / weight come first."""
        keyed = [F.struct((self.draw(f"{name} {v}") * (i + 1) ** (skew - 1)).alias("key"), F.lit(v).alias("value")) for i, v in enumerate(values)]
        return F.transform(F.slice(F.array_sort(F.array(*keyed)), F.lit(1), number), lambda s: s["value"])

    def level(self, levels: dict) -> Column:
        """The level whose share of [0, 1) holds the draw, with its pay."""
        out, upto = None, sum(share for share, _, _ in levels.values())
        for name, (share, median, spread) in reversed(levels.items()):
            row = F.struct(F.lit(name).alias("name"), F.lit(float(median)).alias("median"), F.lit(float(spread)).alias("spread"))
            out = row if out is None else F.when(self.draw("level") < upto, row).otherwise(out)
            upto -= share
        return out


def sample_ads(spark: SparkSession, num_jobs: int = 50, num_days: int = 7, as_of: str = "2026-01-07", seed: int = 42, profile: Profile = Profile()) -> DataFrame:
    """Raw ads, each on one of the ``num_days`` + 1 days up to ``as_of``; made where the tasks run, the same at any layout."""
    ad, p = _Ad(seed), profile
    # A sum of three draws is nearly normal; pay is the level's median times its exponential, in steps of 100.
    normal = (ad.draw("pay 1") + ad.draw("pay 2") + ad.draw("pay 3") - 1.5) * 2
    low = F.round(F.col("level.median") * F.exp(normal * F.col("level.spread")) / 100) * 100
    high = F.round(F.col("low") * (1 + p.pay_width * ad.draw("width")) / 100) * 100
    number = F.lit(p.fewest_skills) + F.floor(ad.draw("skills") * (p.most_skills - p.fewest_skills + 1)).cast("int")
    drawn = spark.range(num_jobs).withColumns({
        "seniority": ad.level(p.levels)["name"], "level": ad.level(p.levels), "company_name": ad.one_of("company", p.companies, p.skew),
        "technologies": ad.some_of("skill", p.skills, number, p.skew), "location": ad.one_of("place", p.places, p.skew),
        "employment_type": ad.one_of("contract", p.contracts, p.skew), "currency": ad.one_of("currency", p.currencies),
        "snapshot_date": F.date_sub(F.lit(as_of).cast("date"), F.floor(ad.draw("day") * (num_days + 1)).cast("int")),
    }).withColumn("low", low).withColumn("high", high)
    amount = [F.col(c).cast("bigint").cast("string") for c in ("low", "high")]
    job_id = F.format_string("ad-%d-%d", F.lit(seed), "id")
    return drawn.select(
        job_id.alias("job_id"), F.format_string("%s %s at the %s desk", F.initcap("seniority"), F.get("technologies", F.lit(0)), F.lower(F.col("technologies")[1])).alias("title"),
        "company_name", F.concat(F.lit("https://ads.example/"), job_id).alias("url"),
        F.concat(F.lit("You keep our "), F.array_join("technologies", ", "), F.lit(" in order.")).alias("description"),
        F.concat(F.lit("Years spent with "), F.element_at("technologies", -1), F.lit(" help.")).alias("requirements"),
        F.concat(amount[0], F.lit(" - "), amount[1], F.lit(" "), F.col("currency")).alias("salary"),
        "location", "technologies", "seniority", "employment_type", "snapshot_date", F.col("id").alias("seq"))
