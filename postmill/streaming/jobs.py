"""Continuous ingest, incremental extraction and live daily counts.

No stream keeps operator state: the stored tables are the state, and a repeated
batch replaces itself, is known as merged, or adds no pending post.
"""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.plans.extraction import extract_and_load
from postmill.plans.ingest import add_pages, settle_run
from postmill.session import delete, folders
from postmill.sources import pages
from postmill.sources.tables import Store


def ingest_stream(
    store: Store, landing: str, checkpoint: str, run: str, files_per_batch: int = 1000, settle_every: int = 20, **trigger
):
    """Collect pages of a run as they land; `availableNow=True` drains and stops.

    Micro-batches add their pages to the run, under their checkpoint and batch id, so a
    repeated batch replaces itself and another stream replaces nothing. After every `settle_every` batches the posts of terms that no later
    page can change are stored. `close_run` then cuts, de-duplicates and
    stores over the whole run: batch sizes have no influence on what is stored.
    """
    own = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def batch(landed: DataFrame, batch_id: int) -> None:
        add_pages(store, run, landed, f"{own}-{batch_id}")
        if (batch_id + 1) % settle_every == 0:
            settle_run(store, run)

    landed = pages.stream_pages(store.spark, landing, files_per_batch)
    return (
        landed.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def extraction_stream(store: Store, checkpoint: str, extractor=None, extractor_type: str = "regex", **trigger):
    """Extract features of newly stored posts and load them."""
    posts = store.read("jobs_posts")

    def batch(new: DataFrame, batch_id: int) -> None:
        extract_and_load(store, extractor, extractor_type, posts=new)

    return (
        store.spark.readStream.schema(posts.schema)
        .parquet(store.path("jobs_posts"))
        .writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def daily_count_stream(mentions: DataFrame, counts: str, checkpoint: str, **trigger):
    """Count jobs per day and technology over a stream of (published_date, technology).

    Every micro-batch adds its own small counts under its batch id; a repeated
    batch replaces itself. No day is ever closed: back-filled posts count too.
    """

    return (
        mentions.writeStream.foreachBatch(lambda new, batch_id: add_daily_counts(new, counts, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


#: Batches that are kept apart before they are merged.
MERGE_EVERY = 64
_COUNTS = "period date, technology string, count bigint"


def _ids(spark: SparkSession, path: str, name: str) -> list[int]:
    """Values of the folders `name=` below a path, without reading their files."""
    return sorted(int(n.removeprefix(f"{name}=")) for n in folders(spark, path) if n.startswith(f"{name}="))


def _merged(spark: SparkSession, counts: str) -> list[int]:
    """Last batches of the complete merged counts; the last one holds all that came before."""
    return [n for n in _ids(spark, f"{counts}/merged", "until") if "_SUCCESS" in folders(spark, f"{counts}/merged/until={n}")]


def _sum(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("period", "technology").agg(F.sum("count").alias("count"))


def _parts(spark: SparkSession, counts: str) -> tuple[list[DataFrame], list[int]]:
    """The newest merged counts and the batches after them, and the ids of those."""
    until = _merged(spark, counts)[-1:]
    later = [n for n in _ids(spark, f"{counts}/batches", "batch") if not until or n > until[0]]
    paths = [f"{counts}/merged/until={n}" for n in until] + [f"{counts}/batches/batch={n}" for n in later]
    return [spark.read.schema(_COUNTS).parquet(*paths)] if paths else [], later


def add_daily_counts(new: DataFrame, counts: str, batch_id: int) -> None:
    """Write the counts of one batch in place of what the batch wrote before, and merge when many are apart.

    A batch that is already merged is left as it is: batches come in order, and a repeated one has the same rows.
    """
    spark = new.sparkSession
    if batch_id <= max(_merged(spark, counts), default=-1):
        return
    dated = new.where(F.col("published_date").isNotNull())
    added = dated.groupBy(F.to_date("published_date").alias("period"), "technology").agg(F.count("*").alias("count"))
    added.write.mode("overwrite").parquet(f"{counts}/batches/batch={batch_id}")
    if len(_ids(spark, f"{counts}/batches", "batch")) >= 2 * MERGE_EVERY:
        merge_daily_counts(spark, counts)


def merge_daily_counts(spark: SparkSession, counts: str) -> None:
    """Add all batches to the merged counts.

    The new counts count once complete; until then readers take the old ones. What the last but one merge
    replaced is deleted only now, so that who read it could end.
    """
    parts, later = _parts(spark, counts)
    if not later:
        return
    before = _merged(spark, counts)
    _sum(parts).coalesce(1).write.mode("overwrite").parquet(f"{counts}/merged/until={later[-1]}")
    for n in _ids(spark, f"{counts}/batches", "batch"):
        if before and n <= before[-1]:
            delete(spark, f"{counts}/batches/batch={n}")
    for n in before[:-1]:
        delete(spark, f"{counts}/merged/until={n}")


def live_daily_counts(spark: SparkSession, counts: str) -> DataFrame:
    """The counts so far: one row per day and technology."""
    parts, _ = _parts(spark, counts)
    return _sum(parts or [spark.createDataFrame([], _COUNTS)])
