"""One ingest run over landed pages: cut, de-duplicate, store, advance watermarks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.operators import ingest
from postmill.session import delete, folders, staging
from postmill.sources import deadletter, pages
from postmill.sources.tables import Store


def new_posts(rows: DataFrame, terms: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to store: before the watermark cut, first per id, not stored yet."""
    kept = ingest.first_per_id(ingest.newer_prefix(rows, terms), terms)
    return ingest.without_stored(kept, stored)


def ingest_pages(
    store: Store, landed: DataFrame, run_at=None, strict: bool = True, full: bool = False, run: str = ""
) -> None:
    """Store the new posts of the landed pages of one run.

    A run is all pages fetched between two moves of the watermarks: those are read
    before its first page counts and moved after its last. `full` ignores the
    watermarks (first population). Re-running the same pages adds nothing:
    stored ids are skipped, and errors are known by content and `run`.
    """
    run_at = deadletter.now_utc() if run_at is None else run_at
    terms = store.read("search_terms").where("is_active")
    marks = terms.withColumn("last_scraped_at", F.lit(None).cast("timestamp_ntz")) if full else terms
    with staging(store.spark) as stage:
        landed = stage(landed, "pages")
        # read by the cuts, the new posts, the errors and the finished terms: parsed once, and kept as landed only where refused
        posts = pages.to_posts(pages.explode_pages(landed), strict)
        posts = stage(posts.withColumn("raw", F.when(F.size("reasons") > 0, F.col("raw"))), "rows")
        rows = pages.usable(posts)
        fresh = stage(new_posts(rows, marks, store.read("jobs_posts")), "new-posts")
        page_failures = pages.page_errors(landed)
        failures = page_failures.unionByName(pages.rejected(posts))
        cuts = ingest.first_old_positions(rows, marks)
        finished = stage(ingest.finished_terms(pages.page_states(landed), cuts), "finished-terms")

        store.append("jobs_posts", fresh)
        store.log(deadletter.error_rows(failures, "ingest", run=run))
        store.replace("search_terms", ingest.advance_watermarks(store.read("search_terms"), finished, run_at))


def run_path(store: Store, run: str) -> str:
    return f"{store.path('ingest_runs')}/run={run}"


def add_pages(store: Store, run: str, landed: DataFrame, batch: str) -> None:
    """Keep the pages of one batch of an open run, in place of what the batch kept before."""
    landed.write.mode("overwrite").parquet(f"{run_path(store, run)}/batch={batch}")


def _open_batches(store: Store, run: str) -> list[str]:
    return [f"{run_path(store, run)}/{name}" for name in folders(store.spark, run_path(store, run)) if name.startswith("batch=")]


def settled_terms(states: DataFrame, cuts: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms whose posts no later page of the run can change.

    Such a term has reached a known post on pages without a gap, and so has each newer term: of a
    post that several terms list, the newest one's row is stored.
    """
    reached = ingest.page_stops(states).join(cuts, "term").where("cut.page < stop").select("term", F.lit(True).alias("reached"))
    told = terms.select("term", "id").join(reached, "term", "left")
    newest_open = told.where("reached is null").agg(F.max("id")).scalar()
    return told.where(F.col("reached") & (newest_open.isNull() | (F.col("id") > newest_open))).select("term")


def settle_run(store: Store, run: str, strict: bool = True) -> None:
    """Store what is certain of an open run: the posts of its settled terms. `close_run` adds the rest and moves the marks."""
    paths = _open_batches(store, run)
    if not paths:
        return
    landed = store.spark.read.schema(pages.RAW_PAGE).parquet(*paths)
    terms = store.read("search_terms").where("is_active")
    with staging(store.spark) as stage:
        rows = stage(pages.usable(pages.to_posts(pages.explode_pages(landed), strict)), "rows")
        settled = stage(settled_terms(pages.page_states(landed), ingest.first_old_positions(rows, terms), terms), "settled")
        certain = rows.join(settled, "term", "left_semi")
        store.append("jobs_posts", stage(new_posts(certain, terms, store.read("jobs_posts")), "new-posts"))


def close_run(store: Store, run: str, run_at=None, strict: bool = True, full: bool = False) -> None:
    """Store the posts of an open run and move the watermarks, once its last page has landed.

    The outcome is that of one batch over all its pages, however many batches
    brought them, in whatever order, and whether or not terms were settled on the way. Closing again after a failure is
    safe. Pages that land meanwhile stay open for the next time.
    """
    paths = _open_batches(store, run)
    if not paths:
        return
    ingest_pages(store, store.spark.read.schema(pages.RAW_PAGE).parquet(*paths), run_at, strict, full, run)
    for path in paths:
        delete(store.spark, path)
