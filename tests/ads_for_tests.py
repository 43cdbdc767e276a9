"""Invented ads, days and small helpers that several tests share."""

from datetime import date

from adlake import schema


def ad(job_id, title="Keeper of Otters", company="Otter Works", salary=None, location=None, technologies=(),
       seniority="mid", url=None, employment_type=None, description=None):
    return {
        "url": url or f"https://jobs.example/pl/job/{job_id}", "job_id": job_id, "title": title,
        "company_name": company, "description": description, "requirements": None, "salary": salary, "location": location,
        "technologies": list(technologies), "seniority": seniority, "employment_type": employment_type,
    }


THREE_ADS = [
    ad("otter-keeper-4411", "Lead Otter Engineer", "Heron and Sons", "21000 - 26500 PLN", "Gdynia, remote",
       ["Rust", "Kafka", "Redis", "Terraform"], "senior"),
    ad("pond-mapper-87", "Pond Mapping Analyst", "Marsh Atlas", "9 400 - 11 800 PLN", "Łódź", ["SQL Server", "R", "Git"], "mid"),
    ad("frog-counter-5", "Frog Counting Trainee", "Tadpole Lab", "5100 - 5900 PLN", "remotely", ["Swift", "Kotlin"], "junior"),
]


def raw_frame(spark, ads):
    return spark.createDataFrame(ads, schema.RAW)


def table(spark, name, rows):
    return spark.createDataFrame(rows, schema.TABLES[name])


def rows_of(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


D1, D2, D3 = date(2026, 1, 5), date(2026, 1, 6), date(2026, 1, 7)
