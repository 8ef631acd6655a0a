"""Registered ingest steps over landed pages."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill.catalog.adapter import table
from postmill.operators import ingest
from postmill.plans.ingest import new_posts
from postmill.session import scratch_path
from postmill.sources import deadletter, pages


def _listed(spark, sf):
    """Events as listed posts, newest first: 100 consecutive events per page number."""
    events = table(spark, sf, "events")
    age = events.agg(F.max("event_id")).scalar() - F.col("event_id")
    return events.select(
        F.col("event_type").alias("term"),
        (F.floor(age / 100) + 1).cast("int").alias("page"),
        (age % 100).cast("int").alias("position"),
        "event_id", "user_id", "ts", "value", "props",
    )


def page_documents(spark, sf):
    """One JSON document per page of a term; every seventh page number is damaged."""
    rows = _listed(spark, sf)
    skipped = F.col("event_id") % 50 == 7
    row = F.struct(
        F.when(F.col("event_id") % 40 != 3, F.col("event_id")).alias("id"),
        F.when(~skipped, F.col("user_id")).alias("companyId"),
        F.concat(F.lit("Vaga "), "event_id").alias("name"),
        F.lit("<p>Python</p>").alias("description"),
        F.col("user_id").alias("careerPageId"),
        F.concat(F.lit("Empresa "), "user_id").alias("careerPageName"),
        F.lit("logo").alias("careerPageLogo"),
        F.lit("https://jobs.example.com").alias("careerPageUrl"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("publishedDate"),
        (F.col("value") > 10).alias("isRemoteWork"),
        F.array(F.lit("código"), F.col("props")).alias("skills"),
        F.array().cast("array<string>").alias("badges"),
    )
    # null keys are left out, so a skipped company becomes an absent key
    packed = rows.groupBy("term", "page").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", row.alias("row")))), lambda r: r["row"]).alias("data")
    )
    whole = F.to_json(F.struct("term", "page", "data", F.struct(F.lit(40).alias("total")).alias("pagination")))
    bare = F.to_json(F.struct("term", "page"))
    broken = F.col("page") % 7
    return packed.select(
        F.when(broken == 0, F.substring(whole, 1, 60))
        .when(broken == 1, bare)
        .when(broken == 2, F.regexp_replace(bare, r"\}$", ', "data": "none"}'))
        .otherwise(whole)
        .alias("value")
    )


def uneven_pages(spark, sf):
    """Pages of every kind of user as a term, 40 events each, of which some are cut, without rows, or missing.

    The term decides which: the first, the second or the last page, or none.
    """
    events = table(spark, sf, "events").select((F.col("user_id") % 60).alias("kind"), "event_id", "ts")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("event_id"))) - 1
    rows = events.withColumn("place", place).withColumn("page", (F.floor(F.col("place") / 40) + 1).cast("int"))
    last = events.groupBy("kind").agg((F.floor((F.count("*") - 1) / 40) + 1).cast("int").alias("last"))
    row = F.struct(
        F.col("event_id").alias("id"), F.lit(1).alias("companyId"), F.lit("Vaga").alias("name"), F.lit("").alias("description"),
        F.lit(1).alias("careerPageId"), F.lit("a").alias("careerPageName"), F.lit("b").alias("careerPageLogo"),
        F.lit("c").alias("careerPageUrl"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("publishedDate"),
    )
    packed = rows.groupBy("kind", "page").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", row.alias("row")))), lambda r: r["row"]).alias("data")
    ).join(last, "kind")
    hit = F.when(F.col("kind") % 4 == 0, F.col("page") == 1).when(F.col("kind") % 4 == 1, F.col("page") == 2).when(
        F.col("kind") % 4 == 2, F.col("page") == F.col("last")).otherwise(False)
    damage = F.when(hit, F.floor(F.col("kind") / 4) % 3)
    term = F.concat(F.lit("user "), "kind").alias("term")
    whole = F.to_json(F.struct(term, "page", "data"))
    return packed.where(~damage.eqNullSafe(2)).select(
        F.when(damage == 0, F.substring(whole, 1, 60)).when(damage == 1, F.to_json(F.struct(term, "page"))).otherwise(whole).alias("value")
    )


def finished_terms(spark, sf):
    """Terms whose mark moves: a third of them reach a known post on one of their pages."""
    path = scratch_path(spark, "landing")
    uneven_pages(spark, sf).write.text(path)
    landed = pages.read_pages(spark, path)
    events = table(spark, sf, "events")
    newest = events.agg(F.max("ts").cast("timestamp_ntz")).scalar()
    kind = F.col("user_id") % 60
    terms = events.select(kind.alias("kind")).distinct().select(
        F.concat(F.lit("user "), "kind").alias("term"), F.when(F.col("kind") % 3 == 0, newest - F.expr("interval 10 days")).alias("last_scraped_at")
    )
    rows = pages.usable(pages.to_posts(pages.explode_pages(landed)))
    return ingest.finished_terms(pages.page_states(landed), ingest.first_old_positions(rows, terms))


def _landed(spark, sf):
    """Pages written as text and read back by the page source."""
    path = scratch_path(spark, "landing")
    page_documents(spark, sf).write.text(path)
    return pages.read_pages(spark, path)


def landed_rows(spark, sf):
    rows = pages.explode_pages(_landed(spark, sf))
    return rows.select("term", "page", "position", F.col("landed.name").alias("name"))


def malformed_pages(spark, sf):
    failures = pages.page_errors(_landed(spark, sf))
    # a cut document may or may not have given up its term and page
    known = F.col("message") != "invalid JSON in page"
    return failures.groupBy("message").agg(
        F.count("*").alias("n"), F.count(F.when(known, F.col("term"))).alias("with_term"),
        F.sum(F.when(known, F.col("page"))).alias("pages"), F.count("payload").alias("with_payload"),
    )


def strict_posts(spark, sf):
    posts = pages.usable(pages.to_posts(pages.explode_pages(_landed(spark, sf)), strict=True))
    return posts.select(
        "id", "company_id", "name", "career_page_name", "published_date", "is_remote_work", "skills", "badges", "city"
    )


def lenient_posts(spark, sf):
    posts = pages.usable(pages.to_posts(pages.explode_pages(_landed(spark, sf)), strict=False))
    return posts.select("id", "company_id", "name", "badges")


def rejected_rows(spark, sf):
    rejected = pages.rejected(pages.to_posts(pages.explode_pages(_landed(spark, sf)), strict=True))
    errors = deadletter.error_rows(rejected, "ingest", created_at=F.lit("2024-02-01").cast("timestamp_ntz"))
    return errors.select(
        "source", "message", "term", "page", "created_at", F.get_json_object("payload", "$.name").alias("name")
    )


def _terms(spark, sf):
    """Event types as terms with watermarks; one has none."""
    kinds = table(spark, sf, "events").select("event_type").distinct()
    mark = (
        F.when(F.col("event_type") == "click", "2024-01-11 06:00:00")
        .when(F.col("event_type") == "error", "2024-01-20 18:30:00")
        .when(F.col("event_type") == "view", "2024-01-29 00:00:00")
        .when(F.col("event_type") == "signup", "2025-01-01 00:00:00")
    )
    return kinds.select(
        F.length("event_type").cast("bigint").alias("id"), F.col("event_type").alias("term"),
        mark.cast("timestamp_ntz").alias("last_scraped_at"),
    )


def _dated(spark, sf):
    """Listed rows of which some are undated and some out of order."""
    return _listed(spark, sf).select(
        "term", "page", "position", F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 11 == 0, None)
        .when(F.col("event_id") % 997 == 0, F.expr("ts - interval 12 days"))
        .otherwise(F.col("ts")).alias("published_date"),
    )


def newer_prefix(spark, sf):
    return ingest.newer_prefix(_dated(spark, sf), _terms(spark, sf))


def term_outcomes(spark, sf):
    rows, terms = _dated(spark, sf), _terms(spark, sf)
    return ingest.term_outcomes(terms, ingest.newer_prefix(rows, terms), ingest.first_old_positions(rows, terms))


def _shared(spark, sf):
    """Line items as listed rows: an order is found by several terms."""
    lines = table(spark, sf, "lineitem")
    return lines.select(
        F.col("l_returnflag").alias("term"), F.col("l_linenumber").alias("page"),
        F.col("l_partkey").alias("position"), F.col("l_orderkey").alias("id"), "l_suppkey", "l_quantity",
    )


def _flags(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag").distinct().select(
        F.ascii("l_returnflag").cast("bigint").alias("id"), F.col("l_returnflag").alias("term"),
        F.lit(None).cast("timestamp_ntz").alias("last_scraped_at"),
    )


def first_per_id(spark, sf):
    """Ties on the whole order cannot be told apart, so only the order is shown."""
    return ingest.first_per_id(_shared(spark, sf), _flags(spark, sf)).select("id", "term", "page", "position")


def new_posts_of_run(spark, sf):
    """Cut, first per id, and not stored yet, in one run."""
    stored = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    rows = _shared(spark, sf).withColumn("published_date", F.lit(None).cast("timestamp_ntz"))
    return new_posts(rows, _flags(spark, sf), stored).select("id", "term", "page", "position")


def without_stored(spark, sf):
    stored = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return ingest.without_stored(rows, stored)


def active_terms(spark, sf):
    terms = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("term"), (F.col("c_acctbal") > 5000).alias("is_active")
    )
    return ingest.active_terms(terms)


def default_terms(spark, sf):
    """Default terms and their notice when no customer is active."""
    terms = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("term"), (F.col("c_acctbal") > 1e12).alias("is_active")
    )
    notice = ingest.fallback_error(terms).select(F.lit(0).cast("bigint").alias("id"), F.col("message").alias("term"))
    return ingest.active_terms(terms).unionByName(notice)


_LISTED_SQL = """
listed AS (SELECT event_type AS term, CAST((m - event_id) // 100 + 1 AS INTEGER) AS page,
  CAST((m - event_id) % 100 AS INTEGER) AS place, e.*
  FROM events e, (SELECT max(event_id) AS m FROM events))"""

_GOOD_SQL = f"""
{_LISTED_SQL},
good AS (SELECT *, row_number() OVER (PARTITION BY term, page ORDER BY place) - 1 AS position
         FROM listed WHERE page % 7 > 2)"""

_DATED_SQL = f"""
{_LISTED_SQL},
dated AS (SELECT term, page, place AS position, event_id AS id,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 997 = 0 THEN ts - INTERVAL 12 DAY ELSE ts END AS published_date
  FROM listed),
terms(term, mark) AS (VALUES ('click', TIMESTAMP '2024-01-11 06:00:00'), ('error', TIMESTAMP '2024-01-20 18:30:00'),
  ('view', TIMESTAMP '2024-01-29 00:00:00'), ('signup', TIMESTAMP '2025-01-01 00:00:00'), ('purchase', NULL)),
flagged AS (SELECT d.*, max(CASE WHEN published_date <= mark THEN 1 ELSE 0 END)
  OVER (PARTITION BY term ORDER BY page, position ROWS UNBOUNDED PRECEDING) AS reached
  FROM dated d JOIN terms USING (term))"""

_FIRST_SQL = """
SELECT id, term, page, position FROM (
  SELECT l_orderkey AS id, l_returnflag AS term, l_linenumber AS page, l_partkey AS position,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag DESC, l_linenumber, l_partkey) AS n
  FROM lineitem) WHERE n = 1"""

QUERIES = [
    ("landed_rows", landed_rows,
     f"WITH {_GOOD_SQL} SELECT term, page, CAST(position AS INTEGER) AS position, 'Vaga ' || event_id AS name FROM good"),
    ("malformed_pages", malformed_pages, f"""
WITH {_LISTED_SQL}, bad AS (SELECT DISTINCT term, page FROM listed WHERE page % 7 <= 2)
SELECT CASE WHEN page % 7 = 0 THEN 'invalid JSON in page' ELSE 'missing or invalid data list' END AS message,
       count(*) AS n, count(*) FILTER (WHERE page % 7 > 0) AS with_term,
       CAST(sum(CASE WHEN page % 7 > 0 THEN page END) AS BIGINT) AS pages, count(*) AS with_payload
FROM bad GROUP BY 1"""),
    ("strict_posts", strict_posts, f"""
WITH {_GOOD_SQL}
SELECT event_id AS id, user_id AS company_id, 'Vaga ' || event_id AS name, 'Empresa ' || user_id AS career_page_name,
       ts AS published_date, value > 10 AS is_remote_work,
       '["código","' || replace(props, '"', '\\"') || '"]' AS skills, CAST(NULL AS VARCHAR) AS badges,
       CAST(NULL AS VARCHAR) AS city
FROM good WHERE event_id % 50 <> 7 AND event_id % 40 <> 3"""),
    ("lenient_posts", lenient_posts, f"""
WITH {_GOOD_SQL}
SELECT event_id AS id, CASE WHEN event_id % 50 <> 7 THEN user_id END AS company_id, 'Vaga ' || event_id AS name,
       '[]' AS badges FROM good WHERE event_id % 40 <> 3"""),
    ("rejected_rows", rejected_rows, f"""
WITH {_GOOD_SQL}
SELECT 'ingest' AS source, array_to_string(list_filter([
    CASE WHEN event_id % 40 = 3 AND event_id % 50 = 7 THEN 'missing keys: id, companyId'
         WHEN event_id % 40 = 3 THEN 'missing keys: id' WHEN event_id % 50 = 7 THEN 'missing keys: companyId' END,
    CASE WHEN event_id % 40 = 3 THEN 'id is null' END], lambda x: x IS NOT NULL), '; ') AS message,
  term, page, TIMESTAMP '2024-02-01 00:00:00' AS created_at, 'Vaga ' || event_id AS name
FROM good WHERE event_id % 50 = 7 OR event_id % 40 = 3"""),
    ("finished_terms", finished_terms, """
WITH placed AS (
  SELECT user_id % 60 AS kind, ts, (row_number() OVER (PARTITION BY user_id % 60 ORDER BY event_id DESC) - 1) // 40 + 1 AS page FROM events
), listed AS (
  SELECT kind, page, max(page) OVER (PARTITION BY kind) AS last, min(ts) AS oldest FROM placed GROUP BY kind, page
), states AS (
  SELECT *, CASE WHEN (kind % 4 = 0 AND page = 1) OR (kind % 4 = 1 AND page = 2) OR (kind % 4 = 2 AND page = last)
                 THEN (kind // 4) % 3 ELSE -1 END AS damage
  FROM listed
), walked AS (
  SELECT *, max(CASE WHEN damage >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY kind ORDER BY page ROWS UNBOUNDED PRECEDING) AS over
  FROM states
), terms AS (
  SELECT kind, max(CASE WHEN kind % 3 = 0 AND over = 0 AND oldest <= (SELECT max(ts) FROM events) - INTERVAL 10 DAY THEN 1 ELSE 0 END) AS reached,
         coalesce(max(CASE WHEN over = 0 THEN page END), 0) AS pages, max(CASE WHEN damage = 1 THEN page END) AS wrong
  FROM walked GROUP BY kind HAVING count(*) > count(*) FILTER (WHERE damage = 2)
)
SELECT 'user ' || kind AS term FROM terms WHERE reached = 1 OR (pages >= 1 AND coalesce(wrong, 0) <> pages + 1)"""),
    ("newer_prefix", newer_prefix, f"""
WITH {_DATED_SQL} SELECT term, page, position, id, published_date FROM flagged WHERE reached = 0"""),
    ("term_outcomes", term_outcomes, f"""
WITH {_DATED_SQL} SELECT term, count(*) FILTER (WHERE reached = 0) AS inserted, max(reached) = 1 AS reached_old
FROM flagged GROUP BY 1"""),
    ("first_per_id", first_per_id, _FIRST_SQL),
    ("new_posts_of_run", new_posts_of_run,
     f"SELECT * FROM ({_FIRST_SQL}) WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"),
    ("without_stored", without_stored, """
SELECT doc_id AS id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""),
    ("active_terms", active_terms, "SELECT c_custkey AS id, c_name AS term FROM customer WHERE c_acctbal > 5000"),
    ("default_terms", default_terms, """
SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'Desenvolvedor'), (2, 'Engenheiro de software'), (3, 'Developer'),
  (4, 'software engineer'), (5, 'data science'), (6, 'Cientista de dados'), (7, 'Tech lead'),
  (0, 'No active search terms in DB; using DEFAULT_SEARCH_TERMS fallback.')) t(id, term)
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 1e12)"""),
]
