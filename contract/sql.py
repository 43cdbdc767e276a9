"""Independent SQL for the registered queries, over the same tables."""

from adlake import fixed_values as fv
from contract.job_pages import SQL as JOB_PAGES
from contract.registry import ONE_JOB, PAIR_NAME, PROSE_WORDS, TREND_DAYS, TREND_NAMES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _contains_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_text(w)})" for w in words) + ")"


def _pay(text: str) -> str:
    """Columns currency .. is_b2b out of a text column, by splitting all digit runs."""
    packed = f"replace(replace({text}, ' ', ''), chr(160), '')"
    runs = f"regexp_extract_all({packed}, '[0-9]+')"
    first = f"CAST({runs}[1] AS DOUBLE)"
    second = f"CAST(coalesce({runs}[2], {runs}[1]) AS DOUBLE)"
    given = f"len({runs}) > 0"
    return f"""
      CASE WHEN NOT ({given}) THEN NULL
           WHEN contains({packed}, 'EUR') OR contains({packed}, '€') THEN 'EUR'
           WHEN contains({packed}, 'USD') OR contains({packed}, '$') THEN 'USD' ELSE 'PLN' END AS currency,
      least({first}, {second}) AS salary_min, greatest({first}, {second}) AS salary_max,
      ({first} + {second}) / 2.0::DOUBLE AS salary_avg,
      CASE WHEN NOT ({given}) THEN NULL
           WHEN contains({packed}, '/h') OR contains(lower({packed}), 'godz') OR contains(lower({packed}), 'hour') THEN 'hourly'
           WHEN contains({packed}, '/rok') OR contains(lower({packed}), 'annual') OR contains(lower({packed}), 'yearly') THEN 'annual'
           ELSE 'monthly' END AS period,
      CASE WHEN {given} THEN {_contains_any(f"lower({packed})", fv.B2B_WORDS)} END AS is_b2b"""


def _level(text: str) -> str:
    return (f"CASE WHEN {_contains_any(f'lower({text})', fv.SENIOR_WORDS)} THEN 'senior' "
            f"WHEN {_contains_any(f'lower({text})', fv.JUNIOR_ENTRY_WORDS)} THEN 'junior' ELSE 'mid' END")


_WORD = "CASE {0} WHEN 'F' THEN 'Senior' WHEN 'O' THEN 'Regular' WHEN 'P' THEN 'Junior' END"
_SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]+"

_HISTORY = f"""
WITH monthly AS (
  SELECT o.*, CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot_date, 'job-' || o_custkey AS job_id
  FROM orders o
),
last_day AS (SELECT max(snapshot_date) AS d FROM monthly),
kept AS (
  SELECT * FROM monthly QUALIFY row_number() OVER (PARTITION BY job_id, snapshot_date ORDER BY o_orderkey DESC) = 1
),
job_postings AS (
  SELECT k.job_id, {_WORD.format('k.o_orderstatus')} || ' ' || c_mktsegment || ' Developer' AS title,
    c_name AS company_name, 'https://jobs.example/job/' || k.job_id AS url, k.first_seen_date, k.last_seen_date,
    k.last_seen_date = (SELECT d FROM last_day) AS is_active
  FROM (SELECT *, min(snapshot_date) OVER w AS first_seen_date, max(snapshot_date) OVER w AS last_seen_date
        FROM kept WINDOW w AS (PARTITION BY job_id)) k
  JOIN customer ON c_custkey = k.o_custkey WHERE k.snapshot_date = k.first_seen_date
),
lookup AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
located AS (
  SELECT k.*, CASE left(o_orderpriority, 1) WHEN '1' THEN 'Remote' WHEN '2' THEN n_name || ' / Remote'
    WHEN '3' THEN n_name WHEN '4' THEN n_name END AS location_text
  FROM kept k JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
),
places AS (
  SELECT t.location_text, arg_min(n_name, n_nationkey) AS city, arg_min(r_name, n_nationkey) AS region
  FROM (SELECT DISTINCT location_text FROM located) t JOIN lookup ON contains(lower(t.location_text), lower(n_name)) GROUP BY 1
),
job_snapshots AS (
  SELECT l.job_id, l.snapshot_date, l.location_text,
    CASE WHEN coalesce({_contains_any('lower(l.location_text)', fv.REMOTE_WORDS)}, false)
         THEN CASE WHEN p.city IS NULL THEN 'remote' ELSE 'hybrid' END
         WHEN p.city IS NOT NULL THEN 'office' END AS location_type,
    p.city, p.region, 'Poland' AS country, {_level(_WORD.format('l.o_orderstatus'))} AS seniority_level,
    CAST(NULL AS VARCHAR) AS employment_type
  FROM located l LEFT JOIN places p ON p.location_text = l.location_text
),
pay_texts AS (
  SELECT k.job_id, k.snapshot_date,
    CASE WHEN low = high THEN CAST(low AS VARCHAR) ELSE low || ' - ' || high END
      || CASE WHEN left(o_orderpriority, 1) = '5' THEN ' EUR' ELSE ' PLN' END AS salary_text
  FROM kept k JOIN (SELECT l_orderkey, CAST(floor(min(l_extendedprice)) AS BIGINT) AS low,
                           CAST(floor(max(l_extendedprice)) AS BIGINT) AS high FROM lineitem GROUP BY 1)
    ON l_orderkey = o_orderkey
),
parsed_pay AS (SELECT job_id, snapshot_date, salary_text, {_pay('salary_text')} FROM pay_texts),
salaries AS (SELECT * FROM parsed_pay WHERE salary_min IS NOT NULL),
technologies AS (SELECT p_name AS name, arg_min(p_type, p_partkey) AS category FROM part GROUP BY 1),
job_technologies AS (
  SELECT job_id, snapshot_date, p_name AS name, CASE WHEN min(l_linenumber) = 1 THEN 'required' END AS proficiency_level
  FROM kept JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3
),
scrape_runs AS (
  SELECT max(ts) AS run_date, count(*) AS jobs_found, count(*) FILTER (event_type = 'signup') AS jobs_new,
    count(*) FILTER (event_type = 'view') AS jobs_updated, count(*) FILTER (event_type = 'error') AS jobs_expired,
    CASE WHEN count(*) FILTER (event_type = 'error') > count(*) FILTER (event_type = 'purchase')
         THEN 'failed' ELSE 'success' END AS status
  FROM events GROUP BY CAST(ts AS DATE)
),
active_links AS (SELECT j.* FROM job_technologies j JOIN job_postings p USING (job_id) WHERE p.is_active),
pln AS (
  SELECT s.*, p.title, n.seniority_level, n.city FROM salaries s JOIN job_postings p USING (job_id)
  JOIN job_snapshots n ON n.job_id = s.job_id AND n.snapshot_date = s.snapshot_date
  WHERE p.is_active AND s.currency = 'PLN'
),
tech AS (
  SELECT t.name AS technology, t.category, a.snapshot_date, count(DISTINCT a.job_id) AS job_count
  FROM active_links a JOIN technologies t USING (name) GROUP BY 1, 2, 3
),
loc AS (
  SELECT s.snapshot_date, s.location_type, s.city, s.region, count(DISTINCT p.job_id) AS job_count
  FROM job_snapshots s JOIN job_postings p USING (job_id) WHERE p.is_active GROUP BY 1, 2, 3, 4
),
m8 AS (
  SELECT t.name AS technology, t.category, count(DISTINCT a.job_id) AS job_count, avg(s.salary_avg) AS avg_salary,
    min(s.salary_min) AS min_salary, max(s.salary_max) AS max_salary
  FROM technologies t JOIN active_links a USING (name)
  JOIN salaries s ON s.job_id = a.job_id AND s.snapshot_date = a.snapshot_date
  WHERE s.currency = 'PLN' GROUP BY 1, 2 HAVING count(DISTINCT a.job_id) >= 2
  ORDER BY job_count DESC, technology LIMIT 20
),
m4 AS (
  SELECT p.job_id, p.title, p.company_name, p.url, p.first_seen_date, p.last_seen_date, n.snapshot_date,
    n.location_type, n.city, n.region, n.seniority_level, n.employment_type, s.salary_min, s.salary_max, s.salary_avg,
    s.currency, s.period, s.is_b2b
  FROM job_postings p LEFT JOIN job_snapshots n ON n.job_id = p.job_id
  LEFT JOIN salaries s ON s.job_id = p.job_id AND s.snapshot_date = n.snapshot_date WHERE p.is_active
),
boxes AS (SELECT n.seniority_level, n.location_type, s.salary_avg FROM job_postings p
  JOIN job_snapshots n ON n.job_id = p.job_id JOIN salaries s ON s.job_id = n.job_id AND s.snapshot_date = n.snapshot_date
  WHERE p.is_active),
metrics AS (
  SELECT d.snapshot_date AS metric_date,
    (SELECT count(*) FROM job_postings WHERE is_active) AS total_jobs,
    {", ".join(f"(SELECT count(*) FROM job_snapshots n JOIN job_postings p USING (job_id) WHERE p.is_active AND n.snapshot_date = d.snapshot_date AND n.location_type = '{k}') AS {k}_jobs" for k in ("remote", "office", "hybrid"))},
    (SELECT avg(s.salary_avg) FROM salaries s JOIN job_postings p USING (job_id)
      WHERE p.is_active AND s.snapshot_date = d.snapshot_date) AS avg_salary_pln,
    (SELECT list_sort(list(s.salary_avg))[count(*) // 2 + 1] FROM salaries s
      WHERE s.snapshot_date = d.snapshot_date) AS median_salary_pln
  FROM (SELECT DISTINCT snapshot_date FROM job_snapshots) d
),
old_postings AS (
  SELECT k.job_id, {_WORD.format('k.o_orderstatus')} || ' ' || c_mktsegment || ' Developer' AS title, c_name AS company_name,
    'https://jobs.example/job/' || k.job_id AS url, k.first_seen_date, k.last_seen_date,
    k.last_seen_date = (SELECT max(snapshot_date) FROM kept, last_day WHERE snapshot_date < d) AS is_active
  FROM (SELECT kept.*, min(snapshot_date) OVER w AS first_seen_date, max(snapshot_date) OVER w AS last_seen_date
        FROM kept, last_day WHERE snapshot_date < d WINDOW w AS (PARTITION BY job_id)) k
  JOIN customer ON c_custkey = k.o_custkey WHERE k.snapshot_date = k.first_seen_date
),
batch AS (SELECT monthly.* FROM monthly, last_day WHERE snapshot_date = d),
batch_first AS (
  SELECT b.job_id, count(*) OVER (PARTITION BY b.job_id) AS copies, c_name,
    {_WORD.format('o_orderstatus')} || ' ' || c_mktsegment || ' Developer' AS title
  FROM batch b JOIN customer ON c_custkey = o_custkey
  QUALIFY row_number() OVER (PARTITION BY b.job_id ORDER BY o_orderkey) = 1
),
merged AS (
  SELECT coalesce(o.job_id, b.job_id) AS job_id, coalesce(o.title, b.title) AS title,
    coalesce(o.company_name, b.c_name) AS company_name,
    'https://jobs.example/job/' || coalesce(o.job_id, b.job_id) AS url,
    coalesce(o.first_seen_date, d) AS first_seen_date,
    CASE WHEN b.job_id IS NULL THEN o.last_seen_date ELSE d END AS last_seen_date,
    b.job_id IS NOT NULL AS is_active,
    CASE WHEN o.job_id IS NULL THEN 'new' WHEN b.job_id IS NOT NULL THEN 'updated'
         WHEN o.is_active THEN 'expired' ELSE 'kept' END AS change,
    coalesce(b.copies, 0) AS copies
  FROM old_postings o FULL JOIN batch_first b ON b.job_id = o.job_id, last_day
),
backfilled AS (
  SELECT 'job-' || o_custkey AS job_id, arg_min(o_orderstatus, (snapshot_date, o_orderkey)) AS status, max(c_mktsegment) AS segment,
    max(c_name) AS company_name, min(snapshot_date) AS first_seen_date, max(snapshot_date) AS last_seen_date
  FROM monthly JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey
),
day_metrics AS (
  SELECT n.snapshot_date AS metric_date, count(DISTINCT n.job_id) AS total_jobs,
    count(*) FILTER (location_type = 'remote') AS remote_jobs, count(*) FILTER (location_type = 'office') AS office_jobs,
    count(*) FILTER (location_type = 'hybrid') AS hybrid_jobs, avg(s.salary_avg) AS avg_salary_pln,
    (SELECT list_sort(list(x.salary_avg))[count(*) // 2 + 1] FROM salaries x WHERE x.snapshot_date = n.snapshot_date) AS median_salary_pln
  FROM job_snapshots n LEFT JOIN salaries s ON s.job_id = n.job_id AND s.snapshot_date = n.snapshot_date GROUP BY n.snapshot_date
),
judged AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS job_id, CASE WHEN coalesce(d.text, '') = '' THEN 'missing title'
    WHEN coalesce(d.source, '') = '' AND coalesce(l.toxic, 0) <> 1 THEN 'missing company_name' WHEN l.quality IS NULL THEN 'missing url'
    WHEN length(trim(d.text)) < 3 THEN 'title too short' WHEN l.toxic = 1 THEN 'company too short'
    WHEN l.quality = 0 THEN 'bad url' ELSE 'accepted' END AS reason
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
),
islands AS (
  SELECT job_id, snapshot_date, n - row_number() OVER (PARTITION BY job_id ORDER BY snapshot_date) AS island
  FROM job_snapshots JOIN (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) AS n
                           FROM (SELECT DISTINCT snapshot_date FROM job_snapshots)) USING (snapshot_date)
),
spans AS (
  SELECT job_id, min(snapshot_date) AS span_start, max(snapshot_date) AS span_end, count(*) AS days_seen
  FROM islands GROUP BY job_id, island
)
"""

_PLN_TEXT = "coalesce(format('{{:,}}', CAST(round_even({0}, 0) AS BIGINT)) || ' PLN', 'N/A')"
_THOUSANDS = "format('{{:,}}', CAST(round_even({0}, 0) AS BIGINT))"
_DAY = "CAST(snapshot_date AS VARCHAR) AS snapshot_date"
_ROUND_PAY = "round(salary_min, 4) AS salary_min, round(salary_max, 4) AS salary_max, round(salary_avg, 4) AS salary_avg"
_TOP_TECH = "(SELECT technology FROM tech GROUP BY 1 ORDER BY sum(job_count) DESC, technology LIMIT {0})"
_M4 = f"""job_id, title, company_name, url, CAST(first_seen_date AS VARCHAR) AS first_seen_date,
  CAST(last_seen_date AS VARCHAR) AS last_seen_date, {_DAY}, location_type, city, region, seniority_level,
  employment_type, {_ROUND_PAY}, currency, period, is_b2b"""
_M8 = """technology, category, job_count, round(avg_salary, 4) AS avg_salary, round(min_salary, 4) AS min_salary,
  round(max_salary, 4) AS max_salary"""
_FIVE = """count(*) AS count, round(min(salary_avg), 4) AS min_salary, round(quantile_cont(salary_avg, 0.25), 4) AS q1,
  round(median(salary_avg), 4) AS median, round(quantile_cont(salary_avg, 0.75), 4) AS q3, round(max(salary_avg), 4) AS max_salary"""
_METRICS = """CAST(metric_date AS VARCHAR) AS metric_date, total_jobs, remote_jobs, office_jobs, hybrid_jobs,
  round(avg_salary_pln, 4) AS avg_salary_pln, round(median_salary_pln, 4) AS median_salary_pln"""
_POSTING = """job_id, title, company_name, url, CAST(first_seen_date AS VARCHAR) AS first_seen_date,
  CAST(last_seen_date AS VARCHAR) AS last_seen_date, is_active"""
_KPI = {
    "total_jobs": "(SELECT count(*) FROM job_postings WHERE is_active)",
    "avg_salary": """round(coalesce((SELECT avg(salary_avg) FROM salaries JOIN job_postings USING (job_id)
      WHERE is_active AND currency = 'PLN' AND snapshot_date = (SELECT max(snapshot_date) FROM salaries)), 0::DOUBLE), 4)""",
    "remote_pct": """round(coalesce((SELECT count(*) FILTER (location_type = 'remote') * 100.0::DOUBLE / nullif(count(*), 0)
      FROM job_snapshots JOIN job_postings USING (job_id)
      WHERE is_active AND snapshot_date = (SELECT max(snapshot_date) FROM job_snapshots)), 0::DOUBLE), 4)""",
    "top_technology": """coalesce((SELECT name FROM active_links
      WHERE snapshot_date = (SELECT max(snapshot_date) FROM job_technologies)
      GROUP BY name ORDER BY count(*) DESC, name LIMIT 1), 'N/A')""",
}
_NAMES = ", ".join(map(_text, TREND_NAMES))

_BY_HISTORY = {
    "salary_by_technology": f"SELECT {_M8} FROM m8",
    "active_jobs": f"SELECT {_M4} FROM m4",
    "active_jobs_in_range": f"SELECT {_M4} FROM m4, last_day WHERE snapshot_date BETWEEN d - 90 AND d",
    "salary_data": f"SELECT {_DAY}, {_ROUND_PAY}, currency, is_b2b, title, seniority_level, city FROM pln",
    "technology_data": f"SELECT technology, category, {_DAY}, job_count FROM tech",
    "location_data": f"SELECT {_DAY}, location_type, city, region, job_count FROM loc",
    "kpi_total": f"SELECT {_KPI['total_jobs']} AS total_jobs",
    "kpi_average_salary": f"SELECT {_KPI['avg_salary']} AS avg_salary",
    "kpi_remote_share": f"SELECT {_KPI['remote_pct']} AS remote_pct",
    "kpi_top_technology": f"SELECT {_KPI['top_technology']} AS top_technology",
    "kpi_metrics": "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in _KPI.items()),
    "technology_trends": f"""SELECT technology, {_DAY}, job_count FROM tech, last_day
      WHERE technology IN ({_NAMES}) AND snapshot_date >= d - {TREND_DAYS}""",
    "last_run": """SELECT strftime(run_date, '%Y-%m-%d %H:%M:%S') AS last_update, jobs_found, jobs_new, status
      FROM scrape_runs ORDER BY run_date DESC LIMIT 1""",
    "last_success": """SELECT strftime(max(run_date), '%Y-%m-%d %H:%M:%S') AS run_date FROM scrape_runs
      WHERE status = 'success'""",
    "table_counts": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS rows FROM {v}" for n, v in (
            ("job_postings", "job_postings"), ("job_snapshots", "job_snapshots"), ("salaries", "salaries"),
            ("technologies", "technologies"), ("job_technologies", "job_technologies"), ("daily_metrics", "metrics"),
            ("scrape_runs", "scrape_runs"))),
    "store_totals": """SELECT count(*) AS total_jobs, count(*) FILTER (is_active) AS active_jobs,
      (SELECT count(*) FROM technologies) AS technologies, (SELECT count(*) FROM job_snapshots) AS snapshots FROM job_postings""",
    "jobs_by_city_adhoc": """SELECT city, count(*) AS count FROM job_snapshots GROUP BY city
      ORDER BY count DESC, city NULLS FIRST LIMIT 10""",
    "avg_salary_by_tech_adhoc": """SELECT name, round(avg(salary_avg), 4) AS avg_salary, count(*) AS jobs
      FROM job_technologies JOIN salaries USING (job_id) GROUP BY name ORDER BY avg(salary_avg) DESC, name LIMIT 10""",
    "location_share": """SELECT location_type, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM job_snapshots), 4)
      AS percentage FROM job_snapshots GROUP BY 1""",
    "tech_trend_7d": f"""SELECT name, {_DAY}, count(*) AS job_count FROM job_technologies, last_day
      WHERE snapshot_date >= d - 7 GROUP BY name, job_technologies.snapshot_date""",
    "best_paid_jobs": """SELECT title, round(salary_avg, 4) AS salary_avg, city FROM (
      SELECT p.title, s.salary_avg, n.city FROM job_postings p JOIN job_snapshots n ON n.job_id = p.job_id
      JOIN salaries s ON s.job_id = p.job_id WHERE p.is_active AND s.currency = 'PLN'
      ORDER BY s.salary_avg DESC, p.title, n.city NULLS FIRST LIMIT 10)""",
    "aggregate_preview": """SELECT count(DISTINCT p.job_id) AS total_jobs, round(avg(s.salary_avg), 4) AS avg_salary,
      count(CASE WHEN n.location_type = 'remote' THEN 1 END) AS remote_jobs,
      count(CASE WHEN n.location_type = 'office' THEN 1 END) AS office_jobs,
      count(CASE WHEN n.location_type = 'hybrid' THEN 1 END) AS hybrid_jobs
      FROM job_postings p LEFT JOIN job_snapshots n ON n.job_id = p.job_id LEFT JOIN salaries s ON s.job_id = p.job_id
      WHERE p.is_active""",
    "tech_popularity": """SELECT t.name, t.category, count(j.job_id) AS job_count,
      CAST(sum(CASE WHEN j.proficiency_level = 'required' THEN 1 ELSE 0 END) AS BIGINT) AS required_count
      FROM technologies t LEFT JOIN job_technologies j USING (name) GROUP BY 1, 2""",
    "job_technologies_of": f"""SELECT name, category, proficiency_level FROM job_technologies JOIN technologies USING (name)
      WHERE job_id = {_text(ONE_JOB)}""",
    "salary_histogram": """SELECT CAST(bin AS BIGINT) AS bin, round(any_value(low + bin * width), 4) AS bin_start,
      count(*) AS jobs, round(any_value(med), 4) AS median_salary FROM (
        SELECT *, (high - low) / 30 AS width,
          least(coalesce(floor((salary_avg - low) / nullif((high - low) / 30, 0)), 0), 29) AS bin
        FROM pln, (SELECT min(salary_avg) AS low, max(salary_avg) AS high, median(salary_avg) AS med FROM pln))
      GROUP BY bin""",
    "salary_by_top_technology": """SELECT technology, job_count, round(avg_salary, 4) AS avg_salary FROM m8
      ORDER BY job_count DESC, technology LIMIT 15""",
    "salary_trend": """SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, round(avg(salary_avg), 4) AS mean_salary,
      round(median(salary_avg), 4) AS median_salary, count(salary_avg) AS count FROM pln GROUP BY pln.snapshot_date
      HAVING count(salary_avg) >= 5""",
    "salary_by_seniority": f"""SELECT seniority_level, {_FIVE}, CAST(list_position(['junior', 'mid', 'senior'], seniority_level)
      AS BIGINT) AS level_order FROM boxes WHERE seniority_level IN ('junior', 'mid', 'senior') GROUP BY 1""",
    "salary_by_location_type": f"SELECT location_type, {_FIVE} FROM boxes WHERE location_type IS NOT NULL GROUP BY 1",
    "salary_summary": " UNION ALL ".join(
        f"SELECT {i} AS position, '{label}' AS metric, {_THOUSANDS.format(f)} AS value_pln FROM pln" for i, (label, f) in enumerate((
            ("Mean", "avg(salary_avg)"), ("Median", "median(salary_avg)"), ("Min", "min(salary_avg)"),
            ("Max", "max(salary_avg)"), ("25th Percentile", "quantile_cont(salary_avg, 0.25)"),
            ("75th Percentile", "quantile_cont(salary_avg, 0.75)")), 1)),
    "top_technologies": """SELECT technology, CAST(sum(job_count) AS BIGINT) AS job_count FROM tech GROUP BY 1
      ORDER BY 2 DESC, 1 LIMIT 20""",
    "top_technology_trends": f"""SELECT technology, category, {_DAY}, job_count FROM tech
      WHERE technology IN {_TOP_TECH.format(10)}""",
    "technology_categories": """SELECT category, CAST(sum(job_count) AS BIGINT) AS job_count,
      round(sum(job_count)::DOUBLE / (SELECT sum(job_count) FROM tech WHERE category IS NOT NULL), 4) AS share
      FROM tech WHERE category IS NOT NULL GROUP BY 1""",
    "top_per_category": """SELECT category, technology, job_count, CAST(r AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY category ORDER BY job_count DESC, technology) AS r FROM (
        SELECT category, technology, CAST(sum(job_count) AS BIGINT) AS job_count FROM tech GROUP BY 1, 2)) WHERE r <= 5""",
    "co_occurrence": f"""SELECT b.name AS technology, t.category, count(DISTINCT b.job_id) AS job_count
      FROM job_technologies a JOIN job_technologies b ON a.job_id = b.job_id AND a.snapshot_date = b.snapshot_date
        AND a.name <> b.name JOIN technologies t ON t.name = b.name
      WHERE a.name = {_text(PAIR_NAME)} GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10""",
    "technology_summary": """SELECT technology, category, job_count, CAST(row_number() OVER (ORDER BY job_count DESC, technology)
      AS INTEGER) AS rank FROM (SELECT technology, category, CAST(sum(job_count) AS BIGINT) AS job_count FROM tech GROUP BY 1, 2)
      ORDER BY job_count DESC, technology LIMIT 20""",
    "demand_heatmap": f"""SELECT g.technology, CAST(g.snapshot_date AS VARCHAR) AS snapshot_date,
      round(coalesce(avg(h.job_count), 0::DOUBLE), 4) AS job_count
      FROM (SELECT * FROM (SELECT DISTINCT technology FROM tech WHERE technology IN {_TOP_TECH.format(15)}),
            (SELECT DISTINCT snapshot_date FROM tech WHERE technology IN {_TOP_TECH.format(15)})) g
      LEFT JOIN tech h ON h.technology = g.technology AND h.snapshot_date = g.snapshot_date
      GROUP BY g.technology, g.snapshot_date""",
    "city_top": """SELECT city, CAST(sum(job_count) AS BIGINT) AS job_count FROM loc WHERE city IS NOT NULL GROUP BY 1
      ORDER BY 2 DESC, 1 LIMIT 15""",
    "location_type_distribution": """SELECT location_type, upper(left(location_type, 1)) || substr(location_type, 2) AS label,
      CAST(sum(job_count) AS BIGINT) AS job_count,
      round(sum(job_count)::DOUBLE / (SELECT sum(job_count) FROM loc WHERE location_type IS NOT NULL), 4) AS share
      FROM loc WHERE location_type IS NOT NULL GROUP BY 1""",
    "location_type_trend": """SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, """ + ", ".join(
        f"CAST(coalesce(sum(job_count) FILTER (location_type = '{k}'), 0) AS BIGINT) AS {k}" for k in fv.LOCATION_TYPES)
        + " FROM loc WHERE location_type IS NOT NULL GROUP BY loc.snapshot_date",
    "regional_comparison": """SELECT region, CAST(sum(job_count) AS BIGINT) AS job_count FROM loc WHERE region IS NOT NULL
      GROUP BY 1""",
    "city_by_location_type": """SELECT city, location_type, CAST(sum(job_count) AS BIGINT) AS job_count FROM loc
      WHERE location_type IS NOT NULL AND city IN (SELECT city FROM loc WHERE city IS NOT NULL AND location_type IS NOT NULL
        GROUP BY 1 ORDER BY sum(job_count) DESC, city LIMIT 10) GROUP BY 1, 2""",
    "location_summary": """SELECT city, region, job_count, CAST(row_number() OVER (ORDER BY job_count DESC, city, region)
      AS INTEGER) AS rank FROM (SELECT city, region, CAST(sum(job_count) AS BIGINT) AS job_count FROM loc
      WHERE city IS NOT NULL AND region IS NOT NULL GROUP BY 1, 2) ORDER BY job_count DESC, city, region LIMIT 15""",
    "remote_share_trend": """SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, total_jobs, remote_jobs,
      round_even(remote_jobs::DOUBLE / total_jobs::DOUBLE * 100, 1) AS remote_pct FROM (
        SELECT snapshot_date, CAST(sum(job_count) AS BIGINT) AS total_jobs,
          CAST(coalesce(sum(job_count) FILTER (location_type = 'remote'), 0) AS BIGINT) AS remote_jobs
        FROM loc GROUP BY snapshot_date)""",
    "best_paying_technologies": """SELECT technology, round(avg_salary, 4) AS avg_salary, job_count FROM m8
      ORDER BY m8.avg_salary DESC, technology LIMIT 10""",
    "overview_counts": """SELECT (SELECT count(*) FROM pln) AS jobs_with_salary,
      (SELECT count(DISTINCT technology) FROM tech) AS technologies, (SELECT count(DISTINCT city) FROM loc) AS cities""",
    "recent_postings": f"""SELECT title, company_name, city, seniority_level, {_PLN_TEXT.format('salary_avg')} AS avg_salary,
      job_id, {_DAY} FROM (SELECT * FROM m4 ORDER BY first_seen_date DESC, job_id, snapshot_date LIMIT 20)""",
    "daily_metrics": f"SELECT {_METRICS}, total_jobs AS jobs_scraped FROM metrics",
    "daily_metrics_latest": f"""SELECT {_METRICS}, total_jobs AS jobs_scraped FROM metrics, last_day
      WHERE metrics.metric_date = d""",
    "recent_daily_metrics": f"""SELECT {_METRICS} FROM metrics, last_day WHERE metrics.metric_date >= d - {TREND_DAYS}""",
    "upper_median_by_date": f"""SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date,
      round(list_sort(list(salary_avg), 'ASC', 'NULLS FIRST')[count(*) // 2 + 1], 4) AS median_salary
      FROM salaries GROUP BY salaries.snapshot_date""",
    "parse_salary": f"SELECT job_id, {_DAY}, salary_text, {_ROUND_PAY}, currency, period, is_b2b FROM parsed_pay",
    "standardize_location": f"SELECT job_id, {_DAY}, location_text, location_type, city, region, country FROM job_snapshots",
    "normalize_seniority": f"""SELECT word, title, count(*) AS ads, {_level('word')} AS seniority_level,
      {_level('title')} AS title_level FROM (SELECT {_WORD.format('o_orderstatus')} AS word,
        {_WORD.format('o_orderstatus')} || ' ' || c_mktsegment || ' Developer' AS title
        FROM monthly JOIN customer ON c_custkey = o_custkey) GROUP BY word, title""",
    "job_key": """SELECT url, CASE WHEN slug <> '' THEN slug ELSE left(md5(url), 16) END AS url_key,
      CASE WHEN slug <> '' THEN slug ELSE left(md5(url || '_title_'), 16) END AS job_key
      FROM (SELECT url, regexp_extract(url, '/job/([^/?]+)', 1) AS slug
            FROM (SELECT url FROM pages UNION ALL SELECT url FROM job_postings))""",
    "posting_upsert": f"SELECT {_POSTING}, change, copies FROM merged",
    "load_statistics": """SELECT count(*) FILTER (change = 'new') AS jobs_new,
      CAST((SELECT count(*) FROM batch) - count(*) FILTER (change = 'new') AS BIGINT) AS jobs_updated,
      count(*) FILTER (change = 'expired') AS jobs_expired, (SELECT count(*) FROM technologies WHERE category = 'ECONOMY') AS technologies_new,
      (SELECT count(*) FROM judged WHERE reason <> 'accepted') AS errors FROM merged""",
    "load_with_rejects": """SELECT count(*) FILTER (a.job_id IS NOT NULL AND l.doc_id IS NULL) AS jobs_new,
      count(*) FILTER (a.job_id IS NOT NULL AND l.doc_id IS NOT NULL) AS jobs_updated,
      count(*) FILTER (a.job_id IS NULL AND l.doc_id IS NOT NULL) AS jobs_expired,
      (SELECT count(*) FROM judged WHERE reason <> 'accepted') AS errors
      FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 0) l ON l.doc_id = d.doc_id
      LEFT JOIN (SELECT job_id FROM judged WHERE reason = 'accepted') a ON a.job_id = CAST(d.doc_id AS VARCHAR)""",
    "late_day": """SELECT job_id, CAST(min(span_start) AS VARCHAR) AS first_seen_date, CAST(max(span_end) AS VARCHAR) AS last_seen_date,
      max(span_end) = (SELECT d FROM last_day) AS is_active FROM spans GROUP BY job_id""",
    "backfill_state": f"""SELECT job_id, {_WORD.format('status')} || ' ' || segment || ' Developer' AS title, company_name,
      'https://jobs.example/job/' || job_id AS url, CAST(first_seen_date AS VARCHAR) AS first_seen_date,
      CAST(last_seen_date AS VARCHAR) AS last_seen_date, last_seen_date = d AS is_active FROM backfilled, last_day""",
    "metrics_of_days": f"SELECT {_METRICS}, total_jobs AS jobs_scraped FROM day_metrics",
    "metrics_upsert": f"""SELECT {_METRICS.replace("total_jobs,", "total_jobs + CAST(metric_date = d AS BIGINT) AS total_jobs,")},
      total_jobs AS jobs_scraped FROM day_metrics, last_day""",
    "expire_jobs": """SELECT job_id, CAST(last_seen_date AS VARCHAR) AS last_seen_date FROM old_postings
      WHERE is_active AND job_id NOT IN (SELECT job_id FROM batch)""",
    "snapshot_upsert": f"""SELECT job_id, {_DAY}, location_type, city, region, country, seniority_level FROM job_snapshots""",
    "salary_upsert": f"""SELECT job_id, {_DAY}, CASE WHEN snapshot_date = d THEN salary_min + 1 ELSE salary_min END AS salary_min,
      salary_max FROM salaries, last_day""",
    "technology_dimension": """SELECT name, category FROM technologies WHERE category = 'ECONOMY'""",
    "technology_links": f"""SELECT job_id, {_DAY}, name, CASE WHEN coalesce(first_line, any_line) = 1 THEN 'required' END AS proficiency_level
      FROM (SELECT b.job_id, b.snapshot_date, p_name AS name, min(l_linenumber) AS any_line,
              min(l_linenumber) FILTER (b.o_orderkey = f.k) AS first_line
            FROM batch b JOIN (SELECT job_id, min(o_orderkey) AS k FROM batch GROUP BY 1) f ON f.job_id = b.job_id
            JOIN lineitem ON l_orderkey = b.o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)""",
    "delete_jobs": f"""SELECT {_DAY}, count(*) AS rows FROM job_snapshots JOIN job_postings USING (job_id) WHERE is_active
      GROUP BY job_snapshots.snapshot_date""",
    "retention": f"SELECT job_id, {_DAY}, city FROM job_snapshots, last_day WHERE snapshot_date >= d - 90",
    "fk_violations": " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, 'job_id' AS column_name, job_id AS key_value, count(*) AS rows FROM {t}
        WHERE job_id NOT IN (SELECT job_id FROM job_postings WHERE is_active) GROUP BY job_id"""
        for t in ("job_snapshots", "salaries", "job_technologies")) + """
        UNION ALL SELECT 'job_technologies', 'name', name, count(*) FROM job_technologies
        WHERE name IN (SELECT name FROM technologies WHERE category = 'ECONOMY') GROUP BY name""",
    "duplicate_keys": """SELECT 'job_snapshots' AS table_name, job_id || '|' || snapshot_date AS key_value, count(*) AS rows
      FROM monthly GROUP BY job_id, snapshot_date HAVING count(*) > 1""",
    "lifecycle_of_jobs": """SELECT job_id, CAST(min(span_start) AS VARCHAR) AS first_seen_date,
      CAST(max(span_end) AS VARCHAR) AS last_seen_date, CAST(sum(days_seen) AS BIGINT) AS days_seen, count(*) AS spans,
      max(span_end) = (SELECT d FROM last_day) AS is_active FROM spans GROUP BY job_id""",
    "active_spans": """SELECT job_id, CAST(span_start AS VARCHAR) AS span_start, CAST(span_end AS VARCHAR) AS span_end, days_seen
      FROM spans""",
    "merged_spans": """SELECT job_id, CAST(span_start AS VARCHAR) AS span_start, CAST(span_end AS VARCHAR) AS span_end, days_seen
      FROM spans""",
}


def _null_counts() -> str:
    from adlake.schema import NOT_NULL

    lost = {("job_postings", "url"): "(SELECT count(*) FROM job_postings WHERE NOT is_active)",
            ("job_snapshots", "snapshot_date"): "(SELECT count(*) FROM job_snapshots WHERE city IS NULL)"}
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, {lost.get((table, column), 'CAST(0 AS BIGINT)')} AS nulls"
        for table, columns in NOT_NULL.items() for column in columns)


_WORDCHAR = r"[\p{L}\p{N}_]"


def _keyword_pattern(word: str) -> str:
    import re

    def edge(char: str, at_end: bool) -> str:
        if char.isalnum() or char == "_":
            return (r"($|[^\p{L}\p{N}_])" if at_end else r"(^|[^\p{L}\p{N}_])")
        return _WORDCHAR

    return "(?i)" + edge(word[0], False) + re.escape(word) + edge(word[-1], True)


def _keywords(text: str, words: list[str]) -> str:
    tests = ", ".join(
        f"CASE WHEN regexp_matches({text}, {_text(_keyword_pattern(w))}) THEN {_text(w)} END" for w in words)
    return f"array_to_string(list_filter([{tests}], lambda w: w IS NOT NULL), ',')"


def _detect(heading: str, body: str) -> str:
    return f"""CASE WHEN {_contains_any(f'lower({heading})', fv.SENIOR_WORDS)} THEN 'senior'
      WHEN {_contains_any(f'lower({heading})', fv.JUNIOR_WORDS)} THEN 'junior'
      WHEN {_contains_any(f'lower({heading})', fv.MID_WORDS)} THEN 'mid'
      WHEN {_contains_any(f'lower({body})', fv.BODY_SENIOR_WORDS)} THEN 'senior'
      WHEN {_contains_any(f'lower({body})', fv.BODY_JUNIOR_WORDS)} THEN 'junior' ELSE 'mid' END"""


def _employment(text: str) -> str:
    return "CASE " + " ".join(
        f"WHEN {_contains_any(f'lower({text})', words)} THEN '{label}'" for label, words in fv.EMPLOYMENT_WORDS) + " END"


_LISTED = ", ".join(
    f"({i}, {_text(name.lower())}, '{category}')"
    for i, (name, category) in enumerate((n, c) for c, names in fv.TECHNOLOGY_CATEGORIES for n in names))

_PAGES = r"""
WITH shown AS (
  SELECT page_id, url, regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'gs') AS html FROM pages
),
links AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') || href AS url, min(i) AS i FROM (
    SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS i FROM (
      SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM shown))
  WHERE contains(href, '/') GROUP BY ALL
),
read AS (
  SELECT page_id, url, regexp_replace(regexp_replace(heading, '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS heading,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'),
      '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS body
  FROM (SELECT page_id, url, regexp_extract(html, '<h1>(.*?)</h1>', 1, 's') AS heading,
          regexp_replace(html, '<[^>]*>', '', 'g') AS body FROM shown)
)
"""

_RAW_ADS = """
WITH raw AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS job_id, d.text AS title, CASE WHEN l.toxic = 1 THEN 'x' ELSE d.source END AS company,
    CASE l.quality WHEN 1 THEN 'http' WHEN 0 THEN 'ftp' END AS url
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
),
judged AS (
  SELECT job_id, CASE WHEN coalesce(job_id, '') = '' THEN 'missing job_id' WHEN coalesce(title, '') = '' THEN 'missing title'
    WHEN coalesce(company, '') = '' THEN 'missing company_name' WHEN coalesce(url, '') = '' THEN 'missing url'
    WHEN length(trim(title)) < 3 THEN 'title too short' WHEN length(company) < 2 THEN 'company too short'
    WHEN NOT starts_with(url, 'http') THEN 'bad url' ELSE 'accepted' END AS reason FROM raw
)
"""

_OTHER = {
    "parse_salary_prose": f"""SELECT doc_id, salary_min, salary_max, salary_avg, currency, period, is_b2b
      FROM (SELECT doc_id, {_pay('text')} FROM documents) WHERE salary_min IS NOT NULL""",
    "categorize_technology": f"""WITH listed(pos, key, category) AS (VALUES {_LISTED}),
      names AS (SELECT DISTINCT name FROM (
        SELECT unnest(regexp_split_to_array(text, '[ \\n]')) AS name FROM documents UNION ALL SELECT p_name FROM part)
        WHERE name <> '')
      SELECT name, coalesce(arg_min(category, CASE WHEN key = lower(name) THEN pos - 1000 ELSE pos END), 'other') AS category
      FROM names LEFT JOIN listed ON contains(lower(name), key) GROUP BY name""",
    "detect_seniority": f"""SELECT doc_id, {_detect("split_part(text, chr(10), 1)", 'text')} AS seniority FROM documents""",
    "clean_text": f"""SELECT doc_id, nullif(replace(trim(regexp_replace(text, '{_SPACE}', ' ', 'g')), chr(0), ''), '') AS cleaned
      FROM documents""",
    "truncate_description": f"""SELECT doc_id, CASE WHEN length(c) > {fv.MAX_TEXT} THEN left(c, {fv.MAX_TEXT}) || '...' ELSE c END
      AS description FROM (SELECT doc_id, regexp_replace(nullif(text, ''), '{_SPACE}', ' ', 'g') AS c FROM documents)""",
    "keyword_extract": f"SELECT doc_id, {_keywords('text', PROSE_WORDS)} AS keywords FROM documents",
    "employment_type": f"SELECT doc_id, {_employment('text')} AS employment_type FROM documents",
    "validate_records": _RAW_ADS + "SELECT job_id, reason FROM judged",
    "reject_counts": _RAW_ADS + "SELECT reason, count(*) AS rows FROM judged GROUP BY 1",
    "page_links": _PAGES + """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS position,
      url FROM links""",
    "page_unique_urls": _PAGES + "SELECT DISTINCT url FROM links",
    "capped_urls": _PAGES + "SELECT DISTINCT url FROM links",
    "page_title": _PAGES + f"""SELECT page_id, CASE WHEN length(trim(heading)) > 5 THEN trim(heading)
      ELSE '{fv.DEFAULT_TITLE}' END AS title FROM read""",
    "next_page": _PAGES + r"""SELECT page_id, regexp_matches(html, 'rel="next"|class="next"|aria-label="[^"]*next|>(Next|Następna)</a>')
      AS has_next FROM shown""",
    "page_records": _PAGES + f"""SELECT page_id, url, left(md5(url), 16) AS job_id,
      CASE WHEN length(trim(heading)) > 5 THEN trim(heading) ELSE '{fv.DEFAULT_TITLE}' END AS title,
      '{fv.DEFAULT_COMPANY}' AS company_name, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS requirements,
      nullif(regexp_extract(body, '([0-9][0-9\\s]*-[0-9\\s]*[0-9])\\s*(PLN|zł|EUR)'), '') AS salary,
      CAST(NULL AS VARCHAR) AS location, {_keywords('body', PROSE_WORDS)} AS technologies,
      {_detect('heading', 'body')} AS seniority, {_employment('body')} AS employment_type FROM read""",
    "listing_prefix": """WITH listing AS (
        SELECT user_id AS run_id, event_id, event_type = 'error' AS stop,
          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page FROM events)
      SELECT run_id, CAST(page AS INTEGER) AS page, event_id, stop FROM (
        SELECT *, coalesce(max(CAST(stop AS INTEGER)) OVER (PARTITION BY run_id ORDER BY page
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM listing)
      WHERE stopped = 0""",
    "capture_statistics": _PAGES + """SELECT (SELECT count(*) FROM pages) AS pages_scraped,
      (SELECT count(*) FROM links) AS jobs_found, (SELECT count(*) FROM pages) AS jobs_scraped, CAST(0 AS BIGINT) AS errors""",
}


_BY_JOB_PAGES = {
    "job_page_records": """SELECT page_id, url, job_id, title, company_name, description, requirements, salary, location, technologies,
      seniority, employment_type FROM ads""",
    "job_next_page": "SELECT page_id, has_next FROM ads",
    "normalised_ads": """SELECT job_id, title, company_name, '2026-01-05' AS first_seen_date, '2026-01-05' AS snapshot_date, true AS is_active,
      replace(description, chr(10), ' ') AS description,
      CASE location WHEN 'Kraków' THEN 'office' WHEN 'Gdynia' THEN 'office' WHEN 'remote' THEN 'remote' WHEN 'Łódź, remote' THEN 'hybrid' END
        AS location_type,
      CASE location WHEN 'Kraków' THEN 'Kraków' WHEN 'Gdynia' THEN 'Gdynia' WHEN 'Łódź, remote' THEN 'Łódź' END AS city,
      CASE location WHEN 'Kraków' THEN 'Małopolskie' WHEN 'Gdynia' THEN 'Pomorskie' WHEN 'Łódź, remote' THEN 'Łódzkie' END AS region,
      'Poland' AS country, seniority AS seniority_level, employment_type, CASE WHEN c_acctbal >= 0 THEN 'PLN' ELSE 'EUR' END AS currency,
      CAST(low AS DOUBLE) AS salary_min, CAST(low + 500 AS DOUBLE) AS salary_max, 'monthly' AS period FROM ads""",
    "listed_ads": """SELECT job_id, CAST(NULL AS VARCHAR) AS salary, '' AS technologies, description FROM ads
      WHERE seniority IN ('senior', 'junior')""",
}
_BY_HISTORY |= {
    "null_counts": _null_counts(),
    "preset_jobs": f"""SELECT job_id, {_DAY}, city, round(salary_avg, 4) AS salary_avg FROM m4, last_day
      WHERE snapshot_date BETWEEN d - 30 AND d""",
    "dashboard_rows": " UNION ALL ".join(f"SELECT '{name}' AS frame, (SELECT count(*) FROM {source}) AS rows" for name, source in (
        ("jobs", "m4"), ("salary", "pln"), ("technology", "tech"), ("location", "loc"), ("salary_by_tech", "m8"),
        ("kpis", "(SELECT 1)"), ("scrape_info", "(SELECT * FROM scrape_runs LIMIT 1)"))),
}
_OTHER |= {
    "extracted_records": _RAW_ADS + """SELECT job_id, source AS company_name, '2026-01-05' AS first_seen_date, true AS is_active,
      lang AS location, CAST(0 AS INTEGER) AS n_technologies FROM judged JOIN documents ON CAST(doc_id AS VARCHAR) = job_id
      WHERE reason = 'accepted'""",
    "technology_rows": f"""WITH listed(pos, key, category) AS (VALUES {_LISTED}),
      rows AS (SELECT CAST(p_partkey AS VARCHAR) AS job_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, unnest(w) AS name
        FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))
      SELECT job_id, r.pos, name, coalesce(arg_min(category, CASE WHEN key = lower(name) THEN l.pos - 1000 ELSE l.pos END), 'other')
        AS category FROM rows r LEFT JOIN listed l ON contains(lower(name), key) GROUP BY job_id, r.pos, name""",
}

# A sketch's quantile has no equal in SQL; its true rank is to be within the bound, and n and the ends are exact.
_SKETCHED = """SELECT {0} AS span, count(*) AS n, round(min(salary_avg), 4) AS least, round(max(salary_avg), 4) AS most,
  true AS q1_within, true AS q2_within, true AS q3_within FROM salaries WHERE currency = 'PLN' GROUP BY 1"""
_BY_HISTORY |= {
    "technology_jobs_range": """SELECT t.name AS technology, t.category, count(DISTINCT job_id) AS job_count
      FROM job_technologies j JOIN technologies t USING (name), last_day WHERE snapshot_date > d - INTERVAL 12 MONTH GROUP BY 1, 2""",
    "technology_jobs_by_year": """SELECT category, CAST(year(snapshot_date) AS INTEGER) AS year, count(DISTINCT job_id) AS job_count
      FROM job_technologies JOIN technologies USING (name) GROUP BY 1, 2""",
    "place_jobs_rollup": """SELECT CAST(CAST(date_trunc('quarter', snapshot_date) AS DATE) AS VARCHAR) AS quarter, region, location_type,
        count(DISTINCT job_id) AS job_count, 'place' AS grain FROM job_snapshots GROUP BY 1, 2, 3
      UNION ALL SELECT CAST(CAST(date_trunc('quarter', snapshot_date) AS DATE) AS VARCHAR), NULL, NULL, count(DISTINCT job_id), 'all'
        FROM job_snapshots GROUP BY 1""",
    "pay_quartiles_sketched": _SKETCHED.format("CAST(year(snapshot_date) AS INTEGER)"),
    "median_pay_sketched": _SKETCHED.format("CAST(snapshot_date AS VARCHAR)"),
    "standardize_location_table": _BY_HISTORY["standardize_location"],
}
_OTHER |= {
    "company_in_text": r"""SELECT page_id, CASE WHEN c_name IS NULL THEN 'remote' ELSE 'hybrid' END AS location_type, c_name AS city, c_mktsegment AS region
      FROM pages LEFT JOIN customer ON c_name = 'Customer#' || lpad(regexp_extract(url, '([0-9]+)[^0-9]*$', 1), 9, '0')""",
    "technology_category_table": """WITH names AS (SELECT DISTINCT p_name AS name FROM part),
      listed AS (SELECT lower(substring(p_name, 2)) AS key, p_partkey AS pos, p_type AS category FROM part)
      SELECT name, coalesce(arg_min(category, CASE WHEN key = lower(name) THEN pos - 1000000000 ELSE pos END), 'other') AS category
      FROM names LEFT JOIN listed ON contains(lower(name), key) GROUP BY name""",
    "keyword_table": r"""WITH w AS (SELECT string_split(lower(text), ' ') AS w FROM benchmark),
      listed AS (SELECT DISTINCT keyword FROM (SELECT unnest(w) AS keyword FROM w UNION ALL SELECT array_to_string(w[1:2], ' ') FROM w
        UNION ALL SELECT array_to_string(w[-2:], ' ') FROM w) WHERE regexp_matches(keyword, '^[a-z]+( [a-z]+)?$')),
      words AS (SELECT doc_id, translate(text, 'İıſK', 'iisk') AS text,
        regexp_extract_all(lower(translate(text, 'İıſK', 'iisk')), '[\p{L}\p{N}_]+') AS w FROM documents),
      found AS (
        SELECT DISTINCT doc_id, keyword FROM (SELECT doc_id, unnest(w) AS keyword FROM words) JOIN listed USING (keyword)
        UNION ALL
        SELECT doc_id, keyword FROM words JOIN listed ON contains(keyword, ' ') AND contains(lower(text), keyword)
          AND regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])' || keyword || '($|[^\p{L}\p{N}_])'))
      SELECT doc_id, CAST(count(*) AS INTEGER) AS n, string_agg(keyword, ',' ORDER BY keyword) AS keywords
      FROM (SELECT DISTINCT * FROM found) GROUP BY 1""",
    "capture_array": r"""SELECT c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place,
        'job-' || c_custkey AS job_id, c_name AS company_name,
        'say "{x" \\ }, {' || c_mktsegment || '}' || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '"}' ELSE '{{' END AS title,
        'a},b' AS technologies, false AS broken FROM customer""",
    "run_log_stream": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) + count(*) FILTER (event_id % 10 = 0) AS n_rows, count(*) AS n_events,
        count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases,
        count(*) FILTER (event_type = 'error') AS errors, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events GROUP BY 1""",
}

# A store takes an ad's pay from the last of its copies that has any.
_ALL_PAID = "(SELECT DISTINCT job_id, snapshot_date FROM monthly JOIN lineitem ON l_orderkey = o_orderkey) paid"
# A store links an ad to the technologies of all of its copies of a day.
_ALL_LINKS = """(SELECT DISTINCT job_id, snapshot_date, p_name FROM monthly JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey) links"""
_BY_HISTORY |= {
    "store_active_jobs_range": f"""SELECT job_id, title, {_DAY}, location_type, city, seniority_level
      FROM m4, last_day WHERE snapshot_date >= d - INTERVAL 6 MONTH""",
    "store_technology_trend": f"""SELECT p_name AS technology, {_DAY}, count(DISTINCT job_id) AS job_count FROM {_ALL_LINKS} JOIN job_postings USING (job_id), last_day
      WHERE is_active AND snapshot_date >= d - INTERVAL 12 MONTH GROUP BY ALL""",
    "store_retention": " UNION ALL ".join(
        f"SELECT {_DAY}, count(*) AS rows, '{n}' AS table_name FROM {source}, last_day WHERE snapshot_date >= d - INTERVAL 400 DAY GROUP BY ALL"
        for n, source in (("job_snapshots", "job_snapshots"), ("salaries", _ALL_PAID), ("job_technologies", _ALL_LINKS))),
    "catalog_round_trip": """SELECT CAST(s.snapshot_date AS VARCHAR) AS snapshot_date, n.location_type, count(*) AS rows, round(max(s.salary_max), 4) AS most
      FROM salaries s JOIN job_snapshots n ON n.job_id = s.job_id AND n.snapshot_date = s.snapshot_date WHERE s.currency = 'PLN' GROUP BY 1, 2""",
    "dashboard_content": """SELECT 'jobs' AS frame, concat_ws('|', job_id, coalesce(CAST(snapshot_date AS VARCHAR), '')) AS key, round(CAST(salary_avg AS DOUBLE), 4) AS value FROM m4
      UNION ALL SELECT 'salary', concat_ws('|', title, CAST(snapshot_date AS VARCHAR), seniority_level), round(salary_avg, 4) FROM pln
      UNION ALL SELECT 'technology', concat_ws('|', technology, CAST(snapshot_date AS VARCHAR)), job_count FROM tech
      UNION ALL SELECT 'location', concat_ws('|', CAST(snapshot_date AS VARCHAR), location_type, city, region), job_count FROM loc
      UNION ALL SELECT 'salary_by_tech', technology, round(avg_salary, 4) FROM m8
      UNION ALL SELECT 'kpis', """ + _KPI["top_technology"] + ", " + _KPI["total_jobs"] + """
      UNION ALL (SELECT 'scrape_info', status, jobs_found FROM scrape_runs ORDER BY run_date DESC LIMIT 1)""",
}
_OTHER |= {"capped_run": _PAGES + "SELECT DISTINCT url FROM links ORDER BY url LIMIT 100"}


# The same rows from the form without a Python worker.
_BY_JOB_PAGES["job_page_outlines"] = _BY_JOB_PAGES["job_page_records"]
# And from bucketed tables.
_BY_HISTORY["bucketed_salaries"] = _BY_HISTORY["salary_by_technology"]


def sql_by_name() -> dict[str, str]:
    return {**{name: _HISTORY + sql for name, sql in _BY_HISTORY.items()},
            **{name: JOB_PAGES + sql for name, sql in _BY_JOB_PAGES.items()}, **_OTHER}
