"""Registered searches, pages, lookups and record projections."""

from pyspark.sql import functions as F

from postmill.catalog.adapter import POSTS_SQL, STAR_SQL, posts, star, table
from postmill.operators import listing
from postmill.sources import exports

_FOUND = ("id", "name", "career_page_name", "published_date", "city", "state", "workplace_type")


def _posts(spark, sf):
    return posts(spark, sf).select(*_FOUND)


def post_search(spark, sf):
    return listing.filter_posts(_posts(spark, sf), search=" grupo%OLD ")


def post_workplace_filter(spark, sf):
    found = listing.filter_posts(_posts(spark, sf), search="asia", workplace_type=" REMOTE ")
    return found.select("id", "state", "workplace_type")


def post_page_newest(spark, sf):
    return listing.page_of(_posts(spark, sf), listing.post_ordering("no such column"), page=3, page_size=50)


def post_page_by_workplace(spark, sf):
    """A request for more rows than are allowed, brought within its limits first."""
    page, size = listing.page_arguments(130, 500)
    return listing.page_of(_posts(spark, sf), listing.post_ordering("workplace_type", "ASC"), page, size)


def post_page_of_any_size(spark, sf):
    """The operator itself gives pages of the size it is asked for."""
    return listing.page_of(_posts(spark, sf), listing.post_ordering("workplace_type", "ASC"), 2, 500)


def post_page_at_depth(spark, sf):
    """A page far down, for which one range of the keys is sorted."""
    return listing.page_at_depth(_posts(spark, sf), "workplace_type", "asc", page=12, page_size=100)


def post_page_after_key(spark, sf):
    """Keyset page after post 40 in name order."""
    return listing.page_after(_posts(spark, sf), "name", "Vaga 40", 40, "asc", 25)


def post_page_metadata(spark, sf):
    found = listing.filter_posts(_posts(spark, sf), search="machinery")
    return listing.page_info(found, page=2, page_size=30)


def post_lookup(spark, sf):
    return listing.lookup(_posts(spark, sf), 17, "Job post")


def _named(spark, sf):
    s = star(spark, sf)
    return listing.with_location_names(s["jobs"], s["companies"], s["cities"], s["states"])


_NEEDLES = ("-medium", "customer#00000001", "cidade 8", "frica")
_JOB = ("id", "job_title", "salary", "company", "city", "state")


def job_search(spark, sf):
    return listing.filter_jobs(_named(spark, sf), search="CIDADE 6", location=" america ").select(*_JOB)


def job_search_by_column(spark, sf):
    """Texts that occur in one column each: title, company, city, state."""
    found = None
    for needle in _NEEDLES:
        rows = listing.filter_jobs(_named(spark, sf), search=needle).select(F.lit(needle).alias("needle"), *_JOB)
        found = rows if found is None else found.unionByName(rows)
    return found


def job_location(spark, sf):
    return listing.filter_jobs(_named(spark, sf), location=" eUrOpE ").select(*_JOB)


def job_page_by_location(spark, sf):
    return listing.page_of(_named(spark, sf), listing.job_ordering("location", "asc"), 2, 40).select(*_JOB)


def job_page_by_salary(spark, sf):
    return listing.page_of(_named(spark, sf), listing.job_ordering("salary", "desc"), 1, 60).select(*_JOB)


def _records(spark, sf):
    s = star(spark, sf)
    named = listing.with_names(s["jobs"], s["companies"], s["contract_types"], s["states"], s["cities"])
    return listing.with_skill_lists(named, s, s)


def job_names(spark, sf):
    s = star(spark, sf)
    named = listing.with_names(s["jobs"], s["companies"], s["contract_types"], s["states"], s["cities"])
    return named.select("id", "company", "contract_type", "state", "city")


def job_records(spark, sf):
    records = _records(spark, sf).select(*exports.JOB_RECORD_COLUMNS)
    return records.select(
        "id", "job_title", "extractor_type", "salary", "seniority", "years_experience",
        F.array_join("tech_stack", ", ").alias("tech_stack"), "company_id", "company", "contract_type",
        "state", "city",
        *[F.array_join(c, ", ").alias(c) for c in ("hard_skills", "soft_skills", "nice_to_have_skills")],
    )


def post_records(spark, sf):
    return exports.post_records(posts(spark, sf)).select(
        "id", "name", "published_date", "application_deadline", "is_remote_work", "disabilities", "skills"
    )


def _terms(spark, sf):
    """Customers as search terms."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("term"),
        (F.col("c_acctbal") > 0).alias("is_active"),
        F.when(F.col("c_nationkey") > 3, F.lit("2024-01-10 00:00:00.25").cast("timestamp_ntz")).alias("last_scraped_at"),
    )


def term_page(spark, sf):
    found = listing.filter_terms(_terms(spark, sf), search="00012", status="active")
    return listing.page_of(found, listing.term_ordering(), page=1, page_size=30).select("id", "term", "is_active")


def inactive_terms(spark, sf):
    return listing.filter_terms(_terms(spark, sf), include_inactive=False, status="inactive").select("id", "term")


def term_records(spark, sf):
    return exports.term_records(_terms(spark, sf))


def _errors(spark, sf):
    """Events as error rows."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", "scraper").otherwise("regex_extractor").alias("source"),
        F.concat(F.lit("Failed "), "event_type").alias("message"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("term"),
        F.lit(1).alias("page"),
        F.lit(20).alias("request_limit"),
        F.col("props").alias("payload"),
        F.col("ts").alias("created_at"),
    )


def error_page(spark, sf):
    found = listing.filter_errors(_errors(spark, sf), search="PURCH", source="regex_extractor")
    return listing.page_of(found, listing.error_ordering(), page=2, page_size=100).select("id", "message", "term")


def error_records(spark, sf):
    return exports.error_records(_errors(spark, sf))


_POST_COLUMNS = ", ".join(_FOUND)
_JOB_COLUMNS = ", ".join(_JOB)

QUERIES = [
    ("post_search", post_search, f"""
WITH {POSTS_SQL} SELECT {_POST_COLUMNS} FROM posts
WHERE name ILIKE '%grupo%OLD%' OR career_page_name ILIKE '%grupo%OLD%'
   OR city ILIKE '%grupo%OLD%' OR state ILIKE '%grupo%OLD%'"""),
    ("post_workplace_filter", post_workplace_filter, f"""
WITH {POSTS_SQL} SELECT id, state, workplace_type FROM posts
WHERE state = 'ASIA' AND lower(workplace_type) = 'remote'"""),
    ("post_page_newest", post_page_newest, f"""
WITH {POSTS_SQL} SELECT {_POST_COLUMNS} FROM posts
ORDER BY published_date DESC NULLS LAST, id DESC LIMIT 50 OFFSET 100"""),
    ("post_page_by_workplace", post_page_by_workplace, f"""
WITH {POSTS_SQL} SELECT {_POST_COLUMNS} FROM posts
ORDER BY workplace_type ASC NULLS LAST, id ASC LIMIT 100 OFFSET 12900"""),
    ("post_page_of_any_size", post_page_of_any_size, f"""
WITH {POSTS_SQL} SELECT {_POST_COLUMNS} FROM posts
ORDER BY workplace_type ASC NULLS LAST, id ASC LIMIT 500 OFFSET 500"""),
    ("post_page_at_depth", post_page_at_depth, f"""
WITH {POSTS_SQL} SELECT {_POST_COLUMNS} FROM posts
ORDER BY workplace_type ASC NULLS LAST, id ASC LIMIT 100 OFFSET 1100"""),
    ("post_page_after_key", post_page_after_key, f"""
WITH {POSTS_SQL} SELECT {_POST_COLUMNS} FROM posts WHERE name > 'Vaga 40' ORDER BY name, id LIMIT 25"""),
    ("post_page_metadata", post_page_metadata, f"""
WITH {POSTS_SQL}, n AS (SELECT count(*) AS n FROM posts WHERE career_page_name ILIKE '%machinery%')
SELECT 2 AS page, 30 AS page_size, n AS total_items, greatest(1, (n + 29) // 30) AS total_pages,
       2 < greatest(1, (n + 29) // 30) AS has_next, true AS has_prev FROM n"""),
    ("post_lookup", post_lookup, f"WITH {POSTS_SQL} SELECT {_POST_COLUMNS} FROM posts WHERE id = 17"),
    ("job_search", job_search, f"""
WITH {STAR_SQL} SELECT {_JOB_COLUMNS} FROM named
WHERE city = 'Cidade 6' AND (city ILIKE '%america%' OR state ILIKE '%america%')"""),
    ("job_search_by_column", job_search_by_column, f"""
WITH {STAR_SQL} SELECT needle, {_JOB_COLUMNS} FROM named, (VALUES {", ".join(f"('{n}')" for n in _NEEDLES)}) t(needle)
WHERE job_title ILIKE '%' || needle || '%' OR company ILIKE '%' || needle || '%'
   OR city ILIKE '%' || needle || '%' OR state ILIKE '%' || needle || '%'"""),
    ("job_location", job_location, f"""
WITH {STAR_SQL} SELECT {_JOB_COLUMNS} FROM named WHERE state = 'EUROPE'"""),
    ("job_page_by_location", job_page_by_location, f"""
WITH {STAR_SQL} SELECT {_JOB_COLUMNS} FROM named ORDER BY city ASC NULLS LAST, id ASC LIMIT 40 OFFSET 40"""),
    ("job_page_by_salary", job_page_by_salary, f"""
WITH {STAR_SQL} SELECT {_JOB_COLUMNS} FROM named ORDER BY salary DESC NULLS LAST, id DESC LIMIT 60"""),
    ("job_names", job_names, f"WITH {STAR_SQL} SELECT id, company, contract_type, state, city FROM named"),
    ("job_records", job_records, f"""
WITH {STAR_SQL},
hard AS (SELECT l_orderkey AS id, string_agg(p_name, ', ' ORDER BY p_name) AS names
         FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
soft AS (SELECT l_orderkey AS id, string_agg(s_name, ', ' ORDER BY s_name) AS names
         FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
nice AS (SELECT l_orderkey AS id, string_agg(p_brand, ', ' ORDER BY p_brand) AS names
         FROM lineitem JOIN part ON l_linenumber = p_partkey GROUP BY 1)
SELECT j.id, job_title, 'regex' AS extractor_type, salary, seniority, years_experience, tech_stack, company_id,
       company, contract_type, state, city, coalesce(hard.names, '') AS hard_skills,
       coalesce(soft.names, '') AS soft_skills, coalesce(nice.names, '') AS nice_to_have_skills
FROM named j LEFT JOIN hard ON hard.id = j.id LEFT JOIN soft ON soft.id = j.id LEFT JOIN nice ON nice.id = j.id"""),
    ("post_records", post_records, """
SELECT o_orderkey AS id, 'Vaga ' || o_orderkey AS name,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS published_date,
       strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') AS application_deadline,
       o_orderpriority = '1-URGENT' AS is_remote_work,
       CASE WHEN o_orderstatus = 'O' THEN o_orderkey % 2 = 0 END AS disabilities,
       '["' || o_orderpriority || '"]' AS skills
FROM orders"""),
    ("term_page", term_page, """
SELECT c_custkey AS id, c_name AS term, true AS is_active FROM customer
WHERE c_acctbal > 0 AND c_name LIKE '%00012%' ORDER BY c_custkey DESC LIMIT 30"""),
    ("inactive_terms", inactive_terms,
     "SELECT c_custkey AS id, c_name AS term FROM customer WHERE c_acctbal <= 0"),
    ("term_records", term_records, """
SELECT c_custkey AS id, c_name AS term, c_acctbal > 0 AS is_active,
       CASE WHEN c_nationkey > 3 THEN '2024-01-10T00:00:00.250000+00:00' END AS last_scraped_at FROM customer"""),
    ("error_page", error_page, """
SELECT event_id AS id, 'Failed ' || event_type AS message, 'user_' || user_id AS term FROM events
WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 100"""),
    ("error_records", error_records, """
SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'scraper' ELSE 'regex_extractor' END AS source,
       'Failed ' || event_type AS message, 'user_' || user_id AS term, 1 AS page, 20 AS request_limit,
       props AS payload,
       CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS created_at
FROM events"""),
]
