"""Registered exports: files are written to the shared folder and read back as text."""

from pyspark.sql import functions as F
from pyspark.sql import Window

from postmill.catalog import labelling, listings
from postmill.catalog.adapter import POSTS_SQL, STAR_SQL, posts, table
from postmill.operators import labels
from postmill.session import scratch_path
from postmill.sources import deadletter, exports


def _lines(spark, path):
    return spark.read.text(path).select(F.col("value").alias("line"))


def post_csv(spark, sf):
    """Exported posts as CSV lines in file order, one header per part file removed."""
    path = scratch_path(spark, "posts-csv")
    rows = posts(spark, sf).withColumn("description", F.concat(F.lit('a "quoted", '), "name"))
    exports.write_csv(exports.post_csv_rows(rows), path)
    lines = spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("place", "line")
    ).where(~F.col("line").startswith("id,company_id") & (F.col("line") != ""))
    # one small row for each file gives its first line number
    counts = lines.groupBy("file").agg(F.count("*").alias("lines"))
    before = counts.select("file", (F.sum("lines").over(Window.orderBy("file")) - F.col("lines")).alias("before"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("place"))
    return lines.withColumn("place", place).join(before, "file").select((F.col("before") + F.col("place")).alias("n"), "line")


def post_csv_of_documents(spark, sf):
    """Posts with whole documents as descriptions, line breaks and quotes included, exported and read as CSV again."""
    path = scratch_path(spark, "document-posts-csv")
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("_text"))
    rows = posts(spark, sf).join(texts, "id").withColumn("description", F.concat("_text", F.lit('\n"fim"'))).drop("_text")
    exports.write_csv(exports.post_csv_rows(rows), path)
    read = spark.read.csv(path, header=True, multiLine=True, escape='"', lineSep="\n", schema=", ".join(f"{c} string" for c in exports.POST_CSV_COLUMNS))
    return read.select(F.col("id").cast("bigint").alias("id"), "name", F.md5("description").alias("digest"), "published_date", "city", "skills")


def job_csv(spark, sf):
    path = scratch_path(spark, "jobs-csv")
    exports.write_csv(exports.job_csv_rows(listings._records(spark, sf)), path)
    return _lines(spark, path).where(~F.col("line").startswith("id,job_title"))


def labelled_csv(spark, sf):
    """Labelled records through a CSV file with line breaks inside values."""
    path = scratch_path(spark, "labelled-csv")
    exports.write_csv(labelling._labelled(spark, sf), path)
    read = exports.read_labelled_csv(spark, path)
    return read.select("id", F.md5("description").alias("digest"), "hard_skills", "level", "contract_type")


def example_files(spark, sf):
    """Token examples written as JSON lines and read back."""
    path = scratch_path(spark, "examples")
    exports.write_examples(labels.training_examples(labelling._labelled(spark, sf)), path)
    read = spark.read.schema("id string, tokens array<string>, ner_tags array<string>").json(path)
    return read.select("id", F.size("tokens").alias("tokens"), F.md5(F.array_join("ner_tags", " ")).alias("digest"))


def entity_csv(spark, sf):
    path = scratch_path(spark, "entity-csv")
    exports.write_entity_csv(labelling.entity_features(spark, sf).select("post_id", "hard_skills", "salary"), path)
    return _lines(spark, path).where(~F.col("line").startswith("post_id,"))


def dead_letters(spark, sf):
    """Error events as error-log rows with a JSON payload."""
    failures = table(spark, sf, "events").where("event_type = 'error'").select(
        F.lit("Request failed").alias("message"),
        F.concat(F.lit("user "), "user_id").alias("term"),
        (F.col("event_id") % 30).cast("int").alias("page"),
        F.lit(20).alias("request_limit"),
        F.to_json(F.struct("event_id", "event_type")).alias("payload"),
        "ts",
    )
    path = scratch_path(spark, "errors")
    deadletter.error_rows(failures, "scraper", created_at=F.col("ts")).write.parquet(path)
    return spark.read.parquet(path).drop("id")


def record_documents(spark, sf):
    """Post records as JSON documents with explicit nulls."""
    records = listings.post_records(spark, sf).select("id", "published_date", "disabilities", "skills")
    return exports.as_json(records)


QUERIES = [
    ("post_csv", post_csv, f"""
WITH {POSTS_SQL}
SELECT row_number() OVER (ORDER BY published_date DESC NULLS FIRST, p.id DESC) AS n, p.id || ',' || company_id || ',' || name || ',"a ""quoted"", ' || name || '",' || career_page_name ||
  ',https://jobs.example.com/' || company_id || ',' || o_orderstatus || ',' ||
  strftime(published_date, '%Y-%m-%dT%H:%M:%S') || ',' || strftime(CAST(published_date AS DATE) + 30, '%Y-%m-%d') || ',' ||
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'True' ELSE 'False' END || ',' || coalesce(city, '') || ',' ||
  coalesce(state, '') || ',Brasil,,' || coalesce(workplace_type, '') || ',' ||
  CASE WHEN o_orderstatus <> 'O' THEN '' WHEN p.id % 2 = 0 THEN 'True' ELSE 'False' END ||
  ',"[""' || o_orderpriority || '""]",' AS line
FROM posts p"""),
    ("post_csv_of_documents", post_csv_of_documents, f"""
WITH {POSTS_SQL}
SELECT id, name, md5(text || chr(10) || '"fim"') AS digest, strftime(published_date, '%Y-%m-%dT%H:%M:%S') AS published_date,
       city, '["' || o_orderpriority || '"]' AS skills
FROM posts JOIN documents ON doc_id = id"""),
    ("job_csv", job_csv, f"""
WITH {STAR_SQL},
hard AS (SELECT l_orderkey AS id, string_agg(p_name, ', ' ORDER BY p_name) AS names, count(*) AS n
         FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
soft AS (SELECT l_orderkey AS id, string_agg(s_name, ', ' ORDER BY s_name) AS names
         FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
nice AS (SELECT l_orderkey AS id, string_agg(p_brand, ', ' ORDER BY p_brand) AS names
         FROM lineitem JOIN part ON l_linenumber = p_partkey GROUP BY 1),
quoted AS (SELECT j.*, CASE WHEN n > 1 THEN '"' || hard.names || '"' ELSE coalesce(hard.names, '') END AS h,
           CASE WHEN n > 1 THEN '"' || soft.names || '"' ELSE coalesce(soft.names, '') END AS s,
           CASE WHEN n > 1 THEN '"' || nice.names || '"' ELSE coalesce(nice.names, '') END AS c
  FROM named j LEFT JOIN hard ON hard.id = j.id LEFT JOIN soft ON soft.id = j.id LEFT JOIN nice ON nice.id = j.id)
SELECT id || ',' || job_title || ',' || coalesce(CAST(nullif(salary, 0) AS VARCHAR), '') || ',regex,' || company || ',' ||
  contract_type || ',' || coalesce(state, '') || ',' || coalesce(city, '') || ',' || h || ',' || s || ',' || c ||
  ',"' || tech_stack || '"' AS line FROM quoted"""),
    ("labelled_csv", labelled_csv, f"""
WITH {labelling._LABELLED_SQL}
SELECT CAST(l.doc_id AS VARCHAR) AS id, md5(replace(text, ',', '')) AS digest, h1 || ', ' || h2 AS hard_skills,
       nullif(lev, '') AS level, CAST(NULL AS VARCHAR) AS contract_type
FROM labelled l JOIN documents d ON d.doc_id = l.doc_id"""),
    ("example_files", example_files, f"""
WITH {labelling._TAGS_SQL}
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(tokens AS INTEGER) AS tokens, md5(tags) AS digest FROM tagged WHERE tagged > 0"""),
    ("entity_csv", entity_csv, """
WITH e AS (SELECT conv_id, turn, turn % 4 AS k, role || (length(text) % 5) AS word FROM conversations),
f AS (SELECT conv_id, coalesce(string_agg(DISTINCT CASE WHEN k < 2 THEN word END, ', ' ORDER BY CASE WHEN k < 2 THEN word END), '') AS hard,
        coalesce(arg_max(CASE WHEN k = 2 THEN word END, CASE WHEN k = 2 THEN turn END), '') AS salary FROM e GROUP BY 1)
SELECT conv_id || ',' || CASE WHEN contains(hard, ',') THEN '"' || hard || '"' ELSE hard END || ',' || salary AS line FROM f"""),
    ("dead_letters", dead_letters, """
SELECT 'scraper' AS source, 'Request failed' AS message, 'user ' || user_id AS term, CAST(event_id % 30 AS INTEGER) AS page,
       20 AS request_limit, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS payload, ts AS created_at
FROM events WHERE event_type = 'error'"""),
    ("record_documents", record_documents, """
SELECT '{"id":' || o_orderkey || ',"published_date":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","disabilities":' ||
  CASE WHEN o_orderstatus <> 'O' THEN 'null' WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END ||
  ',"skills":"[\\"' || o_orderpriority || '\\"]"}' AS value FROM orders""".replace("\\\\", "\\")),
]
