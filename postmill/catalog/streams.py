"""Registered streaming runs: drained with `availableNow` and compared with batch SQL."""

from pyspark.sql import functions as F

from postmill.catalog import ingesting
from postmill.catalog.adapter import WITH_FEATURES, posts, table
from postmill.plans.ingest import close_run
from postmill.session import scratch_path
from postmill.sources.tables import Store
from postmill.streaming import jobs


def _ingested(spark, sf, files, files_per_batch, settle_every=20):
    """Posts stored from landed pages; the run is drained and closed twice, the second time to no effect."""
    landing = scratch_path(spark, "landing")
    lines = ingesting.page_documents(spark, sf)
    (lines.repartition(files, F.xxhash64("value")) if files else lines).write.text(landing)
    store = Store(spark, scratch_path(spark, "store"))
    store.replace("search_terms", ingesting._terms(spark, sf).withColumn("is_active", F.lit(True)))
    checkpoint = scratch_path(spark, "checkpoint")
    for _ in range(2):
        jobs.ingest_stream(store, landing, checkpoint, "first", files_per_batch, settle_every).awaitTermination()
    close_run(store, "first")
    # another checkpoint folder: the same files are read again
    jobs.ingest_stream(store, landing, scratch_path(spark, "checkpoint"), "second").awaitTermination()
    close_run(store, "second")
    return store.read("jobs_posts").select("id", "name", "published_date")


def streamed_ingest(spark, sf):
    """Landed pages through the ingest stream."""
    return _ingested(spark, sf, None, 1000)


def streamed_ingest_small_batches(spark, sf):
    """Pages of one term scattered over files in no order, one file for each micro-batch."""
    return _ingested(spark, sf, 8, 1)


def settled_ingest(spark, sf):
    """Terms are settled after every batch of a run, and the rest is stored when it is closed."""
    return _ingested(spark, sf, 4, 1, settle_every=1)


def streamed_extraction(spark, sf):
    """New posts through the extraction stream; jobs per contract type and skill counts."""
    store = Store(spark, scratch_path(spark, "store"))
    store.append("jobs_posts", posts(spark, sf))
    jobs.extraction_stream(store, scratch_path(spark, "checkpoint")).awaitTermination()
    names = store.read("contract_types").select(F.col("id").alias("contract_type_id"), F.col("name"))
    return store.read("jobs").join(names, "contract_type_id").groupBy("name").agg(
        F.count("*").alias("n"), F.sum("salary").alias("salary")
    )


def streamed_daily_counts(spark, sf):
    """Event types as technologies, newest first in five batches, of which one is repeated."""
    source, counts = scratch_path(spark, "mentions"), scratch_path(spark, "daily")
    events = table(spark, sf, "events").select(
        F.col("ts").alias("published_date"), F.col("event_type").alias("technology"), "event_id"
    )
    age = F.floor((events.agg(F.max("event_id")).scalar() - F.col("event_id")) * 5 / (events.agg(F.max("event_id")).scalar() + 1))
    checkpoint, schema = scratch_path(spark, "checkpoint"), "published_date timestamp_ntz, technology string, event_id bigint"
    for part in range(5):
        events.where(age == part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.daily_count_stream(stream, counts, checkpoint).awaitTermination()
    jobs.add_daily_counts(events.where(age == 2), counts, 2)
    return jobs.live_daily_counts(spark, counts)


_INGESTED_SQL = f"""
WITH {ingesting._GOOD_SQL},
terms(term, mark) AS (VALUES ('click', TIMESTAMP '2024-01-11 06:00:00'), ('error', TIMESTAMP '2024-01-20 18:30:00'),
  ('view', TIMESTAMP '2024-01-29 00:00:00'), ('signup', TIMESTAMP '2025-01-01 00:00:00'), ('purchase', NULL)),
sound AS (SELECT g.*, max(CASE WHEN ts <= mark THEN 1 ELSE 0 END)
  OVER (PARTITION BY term ORDER BY page, position ROWS UNBOUNDED PRECEDING) AS reached
  FROM good g JOIN terms USING (term) WHERE event_id % 50 <> 7 AND event_id % 40 <> 3)
SELECT event_id AS id, 'Vaga ' || event_id AS name, ts AS published_date FROM sound WHERE reached = 0"""

QUERIES = [
    ("streamed_ingest", streamed_ingest, _INGESTED_SQL),
    ("streamed_ingest_small_batches", streamed_ingest_small_batches, _INGESTED_SQL),
    ("settled_ingest", settled_ingest, _INGESTED_SQL),
    ("streamed_extraction", streamed_extraction, f"""
{WITH_FEATURES} SELECT contract_type AS name, count(*) AS n, CAST(sum(amount) AS BIGINT) AS salary FROM features GROUP BY 1"""),
    ("streamed_daily_counts", streamed_daily_counts, """
SELECT CAST(ts AS DATE) AS period, event_type AS technology, count(*) AS count FROM events GROUP BY 1, 2"""),
]
