"""Registered aggregates and trends."""

from datetime import date

from pyspark.sql import functions as F

from postmill.catalog.adapter import STAR_SQL, star, table
from postmill.operators import analytics, trends
from postmill.plans.trends import technology_trends

AS_OF = date(2001, 8, 1)
SINCE_SQL = "DATE '2001-05-04'"  # 90 days that end on AS_OF
EVENTS_AS_OF = date(2024, 1, 30)


def table_counts(spark, sf):
    orders, events = table(spark, sf, "orders"), table(spark, sf, "events")
    return analytics.table_counts(
        orders,
        orders.where("o_orderstatus <> 'P'"),
        table(spark, sf, "customer"),
        events.where("event_type = 'error'"),
    )


def average_posts_per_day(spark, sf):
    average = analytics.average_posts_per_day(star(spark, sf)["jobs_posts"])
    return average.select(F.round("average", 6).alias("average"))


def average_salary(spark, sf):
    return analytics.average_salary(star(spark, sf)["jobs"]).select(F.round("average", 4).alias("average"))


def top_technologies(spark, sf):
    s = star(spark, sf)
    return analytics.top_technologies(s["job_hard_skills"], s["hard_skills"])


def top_locations(spark, sf):
    s = star(spark, sf)
    return analytics.top_locations(s["jobs"], s["cities"])


def jobs_by_contract_type(spark, sf):
    s = star(spark, sf)
    return analytics.jobs_by_contract_type(s["jobs"], s["contract_types"])


def jobs_by_seniority(spark, sf):
    return analytics.jobs_by_seniority(star(spark, sf)["jobs"])


def _daily(spark, sf, skill=None):
    s = star(spark, sf)
    since, _ = trends.window_of(AS_OF, 90)
    return trends.daily_counts(
        s["jobs_posts"], s["jobs"], s["job_hard_skills"], s["hard_skills"], since, skill
    )


def daily_technology_counts(spark, sf):
    return _daily(spark, sf)


def daily_counts_of_one_technology(spark, sf):
    return _daily(spark, sf, " Small RING ")


def technology_totals(spark, sf):
    return trends.totals(_daily(spark, sf), limit=50)


def requested_technology_total(spark, sf):
    return trends.totals(_daily(spark, sf, "red widget"), skill="red widget")


def _trend(spark, sf, **options):
    s = star(spark, sf)
    return technology_trends(
        s["jobs_posts"], s["jobs"], s["job_hard_skills"], s["hard_skills"], AS_OF, **options
    )


def technology_trends_dense(spark, sf):
    return _trend(spark, sf, days=500, limit=4)


def technology_trends_requested(spark, sf):
    """A request for more than is allowed, brought within its limits first."""
    days, limit = trends.requested(days=500, limit=50)
    return _trend(spark, sf, days=days, limit=limit)


def technology_trends_packed(spark, sf):
    packed = trends.packed_series(_trend(spark, sf, days=90, limit=4))
    return packed.select("technology", "total", F.array_join("counts", ",").alias("counts"))


def trend_summary(spark, sf):
    return trends.summary(_trend(spark, sf, days=90, limit=4))


def trend_series_statistics(spark, sf):
    found = trends.series_statistics(_trend(spark, sf, days=90, limit=4))
    return found.withColumn("average", F.round("average", 6))


def event_trends(spark, sf):
    """Event types as technologies: five of them share all rows."""
    events = table(spark, sf, "events")
    mentions = events.select(
        F.col("event_id").alias("job_id"), F.xxhash64("event_type").alias("hard_skill_id")
    )
    kinds = events.select(F.xxhash64("event_type").alias("id"), F.col("event_type").alias("name")).distinct()
    posts = events.select(F.col("event_id").alias("id"), F.col("ts").alias("published_date"))
    return technology_trends(posts, posts, mentions, kinds, EVENTS_AS_OF, days=7, limit=3)


def _daily_sql(since=SINCE_SQL):
    return f"""
daily AS (
  SELECT CAST(o_orderdate AS DATE) AS period, p_name AS technology, count(*) AS count
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
  WHERE o_orderstatus <> 'P' AND o_orderdate >= {since}
  GROUP BY 1, 2
)"""


def _trend_sql(since=SINCE_SQL, limit=4):
    return f"""
{_daily_sql(since)},
kept AS (
  SELECT technology, CAST(sum(count) AS BIGINT) AS total FROM daily
  GROUP BY 1 ORDER BY total DESC, technology LIMIT {limit}
),
days AS (
  SELECT CAST(d AS DATE) AS period FROM generate_series({since}, DATE '2001-08-01', INTERVAL 1 DAY) t(d)
),
dense AS (
  SELECT k.technology, k.total, days.period, coalesce(daily.count, 0) AS count
  FROM kept k CROSS JOIN days
       LEFT JOIN daily ON daily.technology = k.technology AND daily.period = days.period
)"""


_DAILY_SQL, _TREND_SQL = _daily_sql(), _trend_sql()

QUERIES = [
    ("table_counts", table_counts, """
SELECT (SELECT count(*) FROM orders) AS total_jobs,
       (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS total_processed,
       (SELECT count(*) FROM customer) AS total_terms,
       (SELECT count(*) FROM events WHERE event_type = 'error') AS total_errors"""),
    ("average_posts_per_day", average_posts_per_day, """
SELECT round(avg(n), 6) AS average FROM (
  SELECT count(*) AS n FROM orders
  GROUP BY CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END)"""),
    ("average_salary", average_salary, f"WITH {STAR_SQL} SELECT round(avg(salary), 4) AS average FROM jobs"),
    ("top_technologies", top_technologies, """
SELECT p_name AS name, count(*) AS count FROM lineitem JOIN part ON p_partkey = l_partkey
GROUP BY 1 ORDER BY count DESC, name LIMIT 10"""),
    ("top_locations", top_locations, f"""
WITH {STAR_SQL} SELECT c.name, count(*) AS count FROM jobs j JOIN cities c ON j.city_id = c.id
GROUP BY 1 ORDER BY count DESC, name LIMIT 10"""),
    ("jobs_by_contract_type", jobs_by_contract_type,
     f"WITH {STAR_SQL} SELECT contract_type AS name, count(*) AS count FROM jobs GROUP BY 1"),
    ("jobs_by_seniority", jobs_by_seniority, f"""
WITH {STAR_SQL} SELECT seniority AS name, count(*) AS count FROM jobs WHERE seniority IS NOT NULL GROUP BY 1"""),
    ("daily_technology_counts", daily_technology_counts, f"WITH {_DAILY_SQL} SELECT * FROM daily"),
    ("daily_counts_of_one_technology", daily_counts_of_one_technology,
     f"WITH {_DAILY_SQL} SELECT * FROM daily WHERE technology = 'small ring'"),
    ("technology_totals", technology_totals, f"""
WITH {_DAILY_SQL} SELECT technology, CAST(sum(count) AS BIGINT) AS total FROM daily
GROUP BY 1 ORDER BY total DESC, technology LIMIT 50"""),
    ("requested_technology_total", requested_technology_total, f"""
WITH {_DAILY_SQL} SELECT technology, CAST(sum(count) AS BIGINT) AS total FROM daily
WHERE technology = 'red widget' GROUP BY 1"""),
    ("technology_trends_dense", technology_trends_dense, f"WITH {_trend_sql("DATE '2000-03-20'")} SELECT * FROM dense"),
    ("technology_trends_requested", technology_trends_requested, f"WITH {_trend_sql(limit=10)} SELECT * FROM dense"),
    ("technology_trends_packed", technology_trends_packed, f"""
WITH {_TREND_SQL} SELECT technology, total, string_agg(CAST(count AS VARCHAR), ',' ORDER BY period) AS counts
FROM dense GROUP BY 1, 2"""),
    ("trend_summary", trend_summary, f"""
WITH {_TREND_SQL},
by_day AS (SELECT period, sum(count) AS n FROM dense GROUP BY 1)
SELECT (SELECT min(period) FROM days) AS first_period, (SELECT max(period) FROM days) AS last_period,
       (SELECT period FROM by_day ORDER BY n DESC, period LIMIT 1) AS busiest_day,
       (SELECT CAST(max(n) AS BIGINT) FROM by_day) AS busiest_total,
       (SELECT count(*) FROM kept) AS technologies, (SELECT CAST(sum(total) AS BIGINT) FROM kept) AS overall_total,
       (SELECT greatest(1, max(count)) FROM dense) AS peak"""),
    ("trend_series_statistics", trend_series_statistics, f"""
WITH {_TREND_SQL},
last_day AS (SELECT technology, count AS latest FROM dense WHERE period = DATE '2001-08-01')
SELECT d.technology, total, count(*) FILTER (WHERE count > 0) AS active_days, latest, max(count) AS peak,
       round(total / 90.0, 6) AS average, CASE WHEN latest > 0 THEN DATE '2001-08-01' END AS latest_hit
FROM dense d JOIN last_day l ON d.technology = l.technology GROUP BY d.technology, total, latest"""),
    ("event_trends", event_trends, """
WITH daily AS (
  SELECT event_type AS technology, CAST(ts AS DATE) AS period, count(*) AS count FROM events
  WHERE ts >= DATE '2024-01-24' GROUP BY 1, 2),
kept AS (SELECT technology, CAST(sum(count) AS BIGINT) AS total FROM daily
         GROUP BY 1 ORDER BY total DESC, technology LIMIT 3),
days AS (SELECT CAST(d AS DATE) AS period
         FROM generate_series(DATE '2024-01-24', DATE '2024-01-30', INTERVAL 1 DAY) t(d))
SELECT k.technology, k.total, days.period, coalesce(daily.count, 0) AS count
FROM kept k CROSS JOIN days
     LEFT JOIN daily ON daily.technology = k.technology AND daily.period = days.period"""),
]
