"""Job pages made of customers, so that every page field has values known from the tables."""

from pyspark.sql import DataFrame, functions as F

PLACES = ["Kraków", "Gdynia", "remote", "Łódź, remote"]
HEADINGS = {"BUILDING": "Senior ", "MACHINERY": "Junior ", "AUTOMOBILE": "Mid "}
CONTRACTS = {"FURNITURE": "part-time", "MACHINERY": "B2B or contract", "BUILDING": "pełny etat", "HOUSEHOLD": "umowa"}
NEXT = {"FURNITURE": '<a href="?p=2" rel="next">2</a>', "HOUSEHOLD": '<a class="next" disabled="disabled">2</a>',
        "BUILDING": "<a href='?p=2'>Następna</a>"}


def job_pages(t) -> DataFrame:
    """(page_id, url, html): unclosed paragraphs and cells, copies of tags, pay in or out of an element."""
    def by_segment(values: dict):
        out = F.lit("")
        for segment, value in values.items():
            out = F.when(F.col("c_mktsegment") == segment, value).otherwise(out)
        return out

    nation = t.read("nation").select("n_nationkey", "n_name", "n_regionkey")
    rows = t.read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    low = F.floor(F.abs("c_acctbal"))
    pay = F.concat_ws(" ", low, F.lit("-"), low + 500)
    place = F.coalesce(F.get(F.array(*map(F.lit, PLACES)), F.col("n_regionkey").cast("int")), F.col("n_name"))
    tagged = F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD")
    html = F.concat(
        F.lit("<html><head><title>Ad</title></head><body><h1>"), by_segment(HEADINGS), F.col("c_name"), F.lit(" desk</h1>"),
        F.when(F.col("c_mktsegment") != "AUTOMOBILE", F.concat(F.lit('<p class="company">'), "c_name")).otherwise(""),
        F.lit('<div class="job-description"><p>Work with '), "n_name", F.lit("</p><p>and "), "c_mktsegment",
        F.lit('</p></div><ul class="requirements"><li>'), "c_mktsegment", F.lit("<li>"), "n_name", F.lit("</ul><table><tr>"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit('<td class="salary">'), pay, F.lit(" PLN")))
        .otherwise(F.concat(F.lit("<td>Pay "), pay, F.lit(" EUR a month"))),
        F.lit('<td class="location">'), place, F.lit("</table>"),
        F.when(tagged, F.concat(F.lit('<i class="skill">Rust</i><i class="skill">'), "n_name", F.lit('</i><i class="skill">Rust</i>')))
        .otherwise("<p>Needs Docker, C++ skills, python and Go.</p>"),
        F.lit("<p>"), by_segment(CONTRACTS), F.lit("</p>"), by_segment(NEXT), F.lit("</body></html>"))
    url = F.concat(F.lit("https://jobs.example/job/job-"), F.col("c_custkey").cast("string"), F.lit("?from=list"))
    return rows.select(F.col("c_custkey").alias("page_id"), url.alias("url"), html.alias("html"))


SQL = """
WITH pages_of AS (
  SELECT c_custkey, c_name, c_mktsegment AS segment, n_name, c_acctbal, CAST(floor(abs(c_acctbal)) AS BIGINT) AS low,
    coalesce(['Kraków', 'Gdynia', 'remote', 'Łódź, remote'][n_regionkey + 1], n_name) AS place
  FROM customer JOIN nation ON n_nationkey = c_nationkey
),
ads AS (
  SELECT c_custkey AS page_id, 'https://jobs.example/job/job-' || c_custkey || '?from=list' AS url, 'job-' || c_custkey AS job_id,
    CASE segment WHEN 'BUILDING' THEN 'Senior ' WHEN 'MACHINERY' THEN 'Junior ' WHEN 'AUTOMOBILE' THEN 'Mid ' ELSE '' END
      || c_name || ' desk' AS title,
    CASE WHEN segment = 'AUTOMOBILE' THEN 'Unknown Company' ELSE c_name END AS company_name,
    'Work with ' || n_name || chr(10) || 'and ' || segment AS description, segment || chr(10) || n_name AS requirements,
    low || ' - ' || (low + 500) || CASE WHEN c_acctbal >= 0 THEN ' PLN' ELSE ' EUR' END AS salary, place AS location,
    CASE WHEN segment IN ('BUILDING', 'HOUSEHOLD') THEN 'Rust,' || n_name ELSE 'Python,Go,Docker' END AS technologies,
    CASE segment WHEN 'BUILDING' THEN 'senior' WHEN 'MACHINERY' THEN 'junior' ELSE 'mid' END AS seniority,
    CASE segment WHEN 'FURNITURE' THEN 'part-time' WHEN 'MACHINERY' THEN 'b2b' WHEN 'BUILDING' THEN 'full-time'
      WHEN 'HOUSEHOLD' THEN 'contract' END AS employment_type,
    segment IN ('FURNITURE', 'BUILDING') AS has_next, low, c_acctbal
  FROM pages_of
)
"""
