"""Registered extraction runs: star-schema load, upserts, custom extractors, dead letters."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill import schema
from postmill.catalog.adapter import POSTS_SQL, WITH_FEATURES, dealt, posts, table
from postmill.functions import responses, vocab
from postmill.operators import dimensions, ingest
from postmill.plans import extraction
from postmill.session import scratch_path, stage
from postmill.sources.tables import Store, empty_table


def _store(spark):
    return Store(spark, scratch_path(spark, "store"))


def _empty(spark):
    return {name: empty_table(spark, name) for name in extraction.WRITE_ORDER}


def _fields(spark, sf):
    # a scan of orders is cut by bytes, of which they have few: their texts would be taken apart in a part of the cores
    featured = extraction.with_text_features(posts(spark, sf, dealt))
    return stage(extraction.job_fields(featured, "regex"), "job-fields")


def pending_posts(spark, sf):
    """Posts without a job when every post of a finished order has one."""
    jobs = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return extraction.pending_posts(posts(spark, sf).select("id", "name"), jobs)


def first_pending_posts(spark, sf):
    jobs = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return extraction.pending_posts(posts(spark, sf).select("id", "name"), jobs, limit=100)


def loaded_jobs(spark, sf):
    """Jobs of a full load, with the keys resolved back to names."""
    new = extraction.star_tables(extraction.good_rows(_fields(spark, sf)), _empty(spark), stage)
    jobs = new["jobs"]
    for key, dimension in (
        ("company_id", "companies"), ("contract_type_id", "contract_types"),
        ("state_id", "states"), ("city_id", "cities"),
    ):
        names = new[dimension].select(F.col("id").alias(key), F.col("name").alias(f"{key}_name"))
        jobs = jobs.join(names, key, "left")
    return jobs.select(
        "id", "job_title", "extractor_type", "salary", "seniority", "years_experience",
        F.array_join("tech_stack", ", ").alias("tech_stack"), "company_id",
        F.col("company_id_name").alias("company"), F.col("contract_type_id_name").alias("contract_type"),
        F.col("state_id_name").alias("state"), F.col("city_id_name").alias("city"),
    )


def loaded_skill_counts(spark, sf):
    """Bridge rows per skill name of all three kinds."""
    new = extraction.star_tables(extraction.good_rows(_fields(spark, sf)), _empty(spark), stage)
    counts = None
    for kind, (bridge, skill_id, _) in schema.SKILL_KINDS.items():
        names = new[kind].select(F.col("id").alias(skill_id), "name")
        per_kind = (
            new[bridge].groupBy(skill_id).agg(F.count("*").alias("n")).join(names, skill_id)
            .select(F.lit(kind).alias("kind"), "name", "n")
        )
        counts = per_kind if counts is None else counts.unionByName(per_kind)
    return counts


def resolved_companies(spark, sf):
    """Companies of all posts; a third of them want one of five names."""
    stored = spark.createDataFrame([(1, "stored one"), (-7, "Grupo BUILDING")], schema.DIMENSION)
    return dimensions.new_companies(stored, posts(spark, sf).select("id", "company_id", "career_page_name"))


def resolved_cities(spark, sf):
    rows = posts(spark, sf).select("city", "state")
    states = dimensions.get_or_create(empty_table(spark, "states"), dimensions.state_names(rows))
    cities = dimensions.new_members(
        empty_table(spark, "cities"), dimensions.city_names(rows, states), ("name", "state_id")
    )
    return cities.join(states.select(F.col("id").alias("state_id"), F.col("name").alias("state")), "state_id").select(
        "name", "state"
    )


def upserted_names(spark, sf):
    """Part names on top of stored ones, whose ids are kept."""
    parts = table(spark, sf, "part")
    stored = parts.where("p_size > 25").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    merged = dimensions.get_or_create(stored.select("id", "name"), parts.select(F.col("p_name").alias("name")))
    kept = stored.select("id").withColumn("stored", F.lit(True))
    return merged.join(kept, "id", "left").select(
        "name", F.when(F.col("stored"), F.col("id")).alias("stored_id")
    )


def bridge_rows(spark, sf):
    """Distinct (order, part name) pairs from name lists with repeats."""
    parts = table(spark, sf, "part")
    lists = table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_orderkey").alias("job_id")
    ).agg(F.collect_list("p_name").alias("names"))
    names = parts.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return dimensions.bridge_rows(lists, names, "hard_skill_id")


def dear_salaries(spark, sf):
    """Salaries beyond 32 bits are stored like others."""
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit(1).cast("bigint").alias("company_id"), F.lit("Acme").alias("career_page_name"),
        F.repeat(F.lit("Vaga "), F.lit(60)).alias("name"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("city"),
        F.concat(F.lit("Oferta R$ 9.999."), F.floor("o_totalprice"), F.lit("000")).alias("description"),
    )
    fields = extraction.good_rows(extraction.job_fields(extraction.with_text_features(rows), "regex"))
    return fields.select("id", "salary")


_RESULT = T.StructType([T.StructField("job_title", T.StringType()), T.StructField("years_experience", T.IntegerType())])


def _counted_words(description: pd.Series) -> pd.DataFrame:
    """A user's extractor that gives up on texts with a bar."""
    if description.str.contains("|", regex=False).any():
        raise ValueError("bars are not supported")
    words = description.str.split()
    return pd.DataFrame({"job_title": words.map(lambda w: w[0] if w else "none"), "years_experience": words.map(len).astype("int32")})


def _described(spark, sf):
    """Documents as posts; every 17th has no description."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.lit(1).cast("bigint").alias("company_id"), F.lit("Acme").alias("career_page_name"),
        F.lit("Vaga").alias("name"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("city"),
        F.when(F.col("doc_id") % 17 != 0, F.col("text")).alias("description"),
    )


def failed_rows(spark, sf):
    """Error rows of an extractor that raises: one for each failing document, with its text."""
    featured = extraction.with_custom_features(_described(spark, sf), extraction.guarded(_counted_words, _RESULT))
    failures = extraction.failed_rows(extraction.job_fields(featured, "custom"))
    return failures.select("message", F.md5("payload").alias("digest"))


def failing_extractor(spark, sf):
    """Jobs and logged errors after two loads with an extractor that raises."""
    store = _store(spark)
    columns = [f.name for f in schema.POST.fields]
    rows = _described(spark, sf)
    store.append("jobs_posts", rows.select(*[
        F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.POST.fields
    ]).select(*columns))
    for _ in range(2):
        extraction.extract_and_load(store, extraction.guarded(_counted_words, _RESULT), "custom")
    loaded = store.read("jobs").select(F.lit("job").alias("kind"), "id", "job_title", "years_experience")
    errors = store.read("error_logs").select(
        F.lit("error").alias("kind"), F.regexp_extract("message", r"job (\d+)", 1).cast("bigint").alias("id"),
        F.col("source").alias("job_title"), F.length("payload").alias("years_experience"),
    )
    return loaded.unionByName(errors)


def _sized(description):
    """Features of a made-up model response that tells the length of the description."""
    return responses.response_features(
        F.concat(F.lit('{"job_title": "Dev", "hard_skills": ["sql", "SQL", "go"], "experiencia_anos": '),
                 F.length(description) % 9, F.lit("}"))
    )


def custom_column_extractor_of_documents(spark, sf):
    """Features of whole documents by column expressions."""
    fields = extraction.job_fields(extraction.with_custom_features(_described(spark, sf), _sized), "llm")
    return fields.select("id", "extractor_type", "years_experience", F.array_join("hard_skills", ", ").alias("hard_skills"), F.md5("description").alias("digest"))


def custom_column_extractor(spark, sf):
    """Features from model responses, built with column expressions only."""
    rows = posts(spark, sf).withColumn("description", F.col("name"))
    fields = extraction.job_fields(extraction.with_custom_features(rows, _sized), "llm")
    return fields.select(
        "id", "job_title", "extractor_type", "years_experience", "contract_type",
        F.array_join("hard_skills", ", ").alias("hard_skills"), F.array_join("tech_stack", ", ").alias("tech_stack"),
    )


def custom_pandas_extractor(spark, sf):
    """Features from a user's pandas UDF over whole documents."""
    result = T.StructType([
        T.StructField("job_title", T.StringType()),
        T.StructField("hard_skills", T.ArrayType(T.StringType())),
        T.StructField("years_experience", T.IntegerType()),
    ])

    def longest_words(description: pd.Series) -> pd.DataFrame:
        words = description.fillna("").str.split()
        return pd.DataFrame({
            "job_title": words.map(lambda w: w[0] if w else None),
            "hard_skills": words.map(lambda w: w[:2]),
            "years_experience": words.map(len).astype("int32"),
        })

    documents = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("description")
    )
    featured = extraction.with_custom_features(documents, F.pandas_udf(longest_words, result))
    return featured.select(
        "id", "features.job_title", "features.years_experience",
        F.size("features.hard_skills").alias("skills"),
        F.size(F.coalesce("features.contract_type", F.array().cast("array<string>"))).alias("contracts"),
    )


def repeated_load(spark, sf):
    """Row counts of a stored star schema after loading the same posts twice."""
    store = _store(spark)
    store.append("jobs_posts", posts(spark, sf))
    extraction.extract_and_load(store)
    extraction.extract_and_load(store)
    counts = None
    for name in extraction.WRITE_ORDER + ("error_logs",):
        one = store.read(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def seeded_terms(spark, sf):
    """Seed terms added to stored ones; a stored term keeps its row."""
    stored = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 100 == 1, F.concat(F.lit("SRE "), "c_custkey"))
        .when(F.col("c_custkey") == 0, "DevOps").otherwise(F.col("c_name")).alias("term"),
        (F.col("c_acctbal") > 0).alias("is_active"),
    )
    seeds = spark.createDataFrame([(t, True) for t in vocab.SEED_TERMS], "term string, is_active boolean")
    return dimensions.insert_if_absent(stored, seeds).select("term", "is_active")


def _changes(spark, sf):
    """All events as changes to customers used as terms: several per term, many after a deletion, some unknown."""
    kind = F.col("event_type")
    op = F.when(kind.isin("click", "view"), "update").when(kind == "error", "delete").otherwise("add")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), op.alias("op"),
        (F.col("user_id") * 20).alias("id"),
        F.when(op == "add", F.concat(F.lit("novo "), F.col("user_id"))).alias("term"),
        F.when(op == "update", F.col("value") > 10).alias("is_active"),
    )


def _terms(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("term"),
        (F.col("c_acctbal") > 0).alias("is_active"),
        F.lit(None).cast("timestamp_ntz").alias("last_scraped_at"),
    )


def changed_terms(spark, sf):
    return dimensions.apply_changes(_terms(spark, sf), _changes(spark, sf)).select("id", "term", "is_active")


def rejected_changes(spark, sf):
    """Every change that could not apply when its turn came."""
    return dimensions.rejected_changes(_terms(spark, sf), _changes(spark, sf))


def advanced_watermarks(spark, sf):
    finished = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("term")
    )
    run_at = F.lit("2024-02-01 12:00:00").cast("timestamp_ntz")
    return ingest.advance_watermarks(_terms(spark, sf), finished, run_at).select("id", "last_scraped_at")


_COMPANIES_SQL = """
firsts AS (SELECT company_id AS id, min(id) AS post_id, arg_min(career_page_name, id) AS wanted FROM posts GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY post_id) AS n FROM firsts {where})"""

_JOB_SQL = f"""
{WITH_FEATURES}, {_COMPANIES_SQL.format(where="")},
companies AS (SELECT id, CASE WHEN n = 1 THEN wanted ELSE wanted || ' (' || id || ')' END AS name FROM ranked)"""

_FOLD_SQL = """
RECURSIVE changes AS (
  SELECT event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN 'update' WHEN event_type = 'error' THEN 'delete' ELSE 'add' END AS op,
    user_id * 20 AS id, CASE WHEN event_type NOT IN ('click', 'view', 'error') THEN 'novo ' || user_id END AS term,
    value > 10 AS is_active, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n
  FROM events),
fold AS (
  SELECT i.id, 0 AS n, c_custkey IS NOT NULL AS alive, c_name AS term, c_acctbal > 0 AS active,
         NULL::BIGINT AS seq, NULL::VARCHAR AS op, NULL::VARCHAR AS given, NULL::VARCHAR AS failure
  FROM (SELECT DISTINCT id FROM changes) i LEFT JOIN customer ON c_custkey = i.id
  UNION ALL
  SELECT f.id, f.n + 1, CASE c.op WHEN 'add' THEN true WHEN 'delete' THEN false ELSE alive END,
         CASE WHEN c.op = 'add' AND NOT alive THEN c.term ELSE f.term END,
         CASE WHEN c.op = 'add' AND NOT alive THEN true WHEN c.op = 'update' AND alive THEN c.is_active ELSE active END,
         c.seq, c.op, c.term,
         CASE WHEN c.op = 'add' AND alive THEN 'Search term already stored'
              WHEN c.op <> 'add' AND NOT alive THEN 'Search term not found' END
  FROM fold f JOIN changes c ON c.id = f.id AND c.n = f.n + 1)"""

QUERIES = [
    ("pending_posts", pending_posts, f"WITH {POSTS_SQL} SELECT id, name FROM posts WHERE o_orderstatus <> 'F'"),
    ("first_pending_posts", first_pending_posts,
     f"WITH {POSTS_SQL} SELECT id, name FROM posts WHERE o_orderstatus <> 'F' ORDER BY id LIMIT 100"),
    ("loaded_jobs", loaded_jobs, f"""
{_JOB_SQL}
SELECT f.id, f.name AS job_title, 'regex' AS extractor_type, CAST(amount AS BIGINT) AS salary, seniority,
       CAST(years_experience AS INTEGER) AS years_experience,
       array_to_string(CASE WHEN len(stacks) > 0 THEN stacks ELSE hard END, ', ') AS tech_stack, company_id,
       c.name AS company, contract_type, state, CASE WHEN state IS NOT NULL THEN city END AS city
FROM features f JOIN companies c ON c.id = f.company_id"""),
    ("loaded_skill_counts", loaded_skill_counts, f"""
{WITH_FEATURES},
named AS (SELECT 'hard_skills' AS kind, unnest(hard) AS name FROM features
  UNION ALL SELECT 'soft_skills', unnest(soft) FROM features
  UNION ALL SELECT 'nice_to_have_skills', unnest(nice) FROM features)
SELECT kind, name, count(*) AS n FROM named GROUP BY 1, 2"""),
    ("resolved_companies", resolved_companies, f"""
WITH {POSTS_SQL}, {_COMPANIES_SQL.format(where="WHERE id <> 1")}
SELECT id, CASE WHEN n = 1 AND wanted <> 'Grupo BUILDING' THEN wanted ELSE wanted || ' (' || id || ')' END AS name
FROM ranked"""),
    ("resolved_cities", resolved_cities, f"""
WITH {POSTS_SQL} SELECT DISTINCT city AS name, state FROM posts WHERE city IS NOT NULL AND state IS NOT NULL"""),
    ("upserted_names", upserted_names, """
SELECT p_name AS name, min(p_partkey) FILTER (WHERE p_size > 25) AS stored_id FROM part GROUP BY 1"""),
    ("bridge_rows", bridge_rows, """
WITH names AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY 1)
SELECT DISTINCT l_orderkey AS job_id, id AS hard_skill_id
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN names USING (p_name)"""),
    ("dear_salaries", dear_salaries, """
SELECT o_orderkey AS id, CAST('9999' || CAST(floor(o_totalprice) AS BIGINT) || '000' AS BIGINT) AS salary FROM orders"""),
    ("failed_rows", failed_rows, """
SELECT 'Failed to process job ' || doc_id || ': ValueError: bars are not supported' AS message, md5(text) AS digest
FROM documents WHERE doc_id % 17 <> 0 AND contains(text, '|')"""),
    ("failing_extractor", failing_extractor, r"""
SELECT 'job' AS kind, doc_id AS id, coalesce(w[1], 'none') AS job_title, CAST(len(w) AS INTEGER) AS years_experience
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w
      FROM (SELECT doc_id, CASE WHEN doc_id % 17 <> 0 THEN text ELSE '' END AS text FROM documents) WHERE NOT contains(text, '|'))
UNION ALL SELECT 'error', doc_id, 'custom_extractor', CAST(length(text) AS INTEGER)
FROM documents WHERE doc_id % 17 <> 0 AND contains(text, '|')"""),
    ("custom_column_extractor_of_documents", custom_column_extractor_of_documents, """
SELECT doc_id AS id, 'llm' AS extractor_type, CAST(coalesce(length(said), 0) % 9 AS INTEGER) AS years_experience, 'sql, Go' AS hard_skills, md5(said) AS digest
FROM (SELECT doc_id, CASE WHEN doc_id % 17 <> 0 THEN text END AS said FROM documents)"""),
    ("custom_column_extractor", custom_column_extractor, """
SELECT o_orderkey AS id, 'Dev' AS job_title, 'llm' AS extractor_type,
       CAST(length('Vaga ' || o_orderkey) % 9 AS INTEGER) AS years_experience, 'CLT' AS contract_type,
       'sql, Go' AS hard_skills, 'sql, Go' AS tech_stack FROM orders"""),
    ("custom_pandas_extractor", custom_pandas_extractor, r"""
SELECT doc_id AS id, w[1] AS job_title, CAST(len(w) AS INTEGER) AS years_experience,
       CAST(least(2, len(w)) AS INTEGER) AS skills, 0 AS contracts
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)"""),
    ("repeated_load", repeated_load, f"""
{WITH_FEATURES}
SELECT 'jobs' AS name, count(*) AS n FROM features
UNION ALL SELECT 'companies', count(DISTINCT company_id) FROM features
UNION ALL SELECT 'states', count(DISTINCT state) FROM features
UNION ALL SELECT 'cities', count(*) FROM (SELECT DISTINCT state, city FROM features WHERE state IS NOT NULL AND city IS NOT NULL)
UNION ALL SELECT 'contract_types', count(DISTINCT contract_type) FROM features
UNION ALL SELECT 'hard_skills', count(DISTINCT s) FROM (SELECT unnest(hard) AS s FROM features)
UNION ALL SELECT 'soft_skills', count(DISTINCT s) FROM (SELECT unnest(soft) AS s FROM features)
UNION ALL SELECT 'nice_to_have_skills', count(DISTINCT s) FROM (SELECT unnest(nice) AS s FROM features)
UNION ALL SELECT 'job_hard_skills', CAST(sum(len(hard)) AS BIGINT) FROM features
UNION ALL SELECT 'job_soft_skills', CAST(sum(len(soft)) AS BIGINT) FROM features
UNION ALL SELECT 'job_nice_to_have_skills', CAST(sum(len(nice)) AS BIGINT) FROM features
UNION ALL SELECT 'error_logs', 0"""),
    ("seeded_terms", seeded_terms, f"""
SELECT CASE WHEN c_custkey % 100 = 1 THEN 'SRE ' || c_custkey WHEN c_custkey = 0 THEN 'DevOps' ELSE c_name END AS term,
       c_acctbal > 0 AS is_active FROM customer
UNION ALL SELECT term, true FROM (VALUES {", ".join(f"('{t}')" for t in vocab.SEED_TERMS if t != "DevOps")}) t(term)"""),
    ("changed_terms", changed_terms, f"""
WITH {_FOLD_SQL},
state AS (SELECT id, arg_max(alive, n) AS alive, arg_max(term, n) AS term, arg_max(active, n) AS active FROM fold GROUP BY 1)
SELECT c_custkey AS id, c_name AS term, c_acctbal > 0 AS is_active FROM customer WHERE c_custkey NOT IN (SELECT id FROM state)
UNION ALL SELECT id, term, active FROM state WHERE alive"""),
    ("rejected_changes", rejected_changes, f"""
WITH {_FOLD_SQL}
SELECT failure AS message, given AS term, '{{"op":"' || op || '","id":' || id || ',"seq":' || seq || '}}' AS payload
FROM fold WHERE failure IS NOT NULL"""),
    ("advanced_watermarks", advanced_watermarks, """
SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
  THEN TIMESTAMP '2024-02-01 12:00:00' END AS last_scraped_at FROM customer"""),
]
