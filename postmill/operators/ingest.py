"""High-water-mark cut, de-duplication and active terms for landed rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from postmill.functions import vocab


#: Parts that the rows of one term are dealt into where they are joined on it.
DEALS = 64


def _join_on_term(rows: DataFrame, per_term: DataFrame, how: str) -> DataFrame:
    """`rows` joined on the term with a small table.

    A few terms hold most rows, and a shuffle by term would bring all of one into one task. Its
    rows are dealt by their place, and the table has a copy for each part.
    """
    part = F.pmod(F.xxhash64("page", "position"), F.lit(DEALS)).cast("int")
    copies = per_term.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    return rows.withColumn("_part", part).join(copies, ["term", "_part"], how).drop("_part")


def first_old_positions(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Per term, the first (page, position) at or before the term's watermark.

    A minimum per term: it combines map-side, so a term that holds a third of
    all rows costs one partial value per task, where a window would sort the
    whole term in one.
    """
    marks = terms.select("term", "last_scraped_at")
    old = _join_on_term(rows, marks, "inner").where(F.col("published_date") <= F.col("last_scraped_at"))
    return old.groupBy("term").agg(F.min(F.struct("page", "position")).alias("cut"))


def newer_prefix(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows before the first old one of their term, in page order.

    Undated rows never stop a term; a term without watermark keeps everything.
    """
    cuts = first_old_positions(rows, terms)
    kept = _join_on_term(rows, cuts, "left").where(
        F.col("cut").isNull() | (F.struct("page", "position") < F.col("cut"))
    )
    return kept.drop("cut")


def first_per_id(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per post id: the one brought by the newest term, then page order.

    `row_number() = 1` is limited per task before the shuffle, so many copies of
    one post do not travel.
    """
    order = terms.select("term", F.col("id").alias("term_id"))
    first = Window.partitionBy("id").orderBy(F.desc("term_id"), "page", "position")
    return (
        _join_on_term(rows, order, "left")
        .withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .drop("_n", "term_id")
    )


def without_stored(rows: DataFrame, stored: DataFrame) -> DataFrame:
    return rows.join(stored.select("id"), "id", "left_anti")


def term_outcomes(terms: DataFrame, inserted: DataFrame, cuts: DataFrame) -> DataFrame:
    """Inserted rows per term and whether the term reached known posts."""
    counts = inserted.groupBy("term").agg(F.count("*").alias("inserted"))
    return (
        terms.select("term")
        .join(counts, "term", "left")
        .join(cuts, "term", "left")
        .select(
            "term",
            F.coalesce("inserted", F.lit(0)).alias("inserted"),
            F.col("cut").isNotNull().alias("reached_old"),
        )
    )


def active_terms(terms: DataFrame) -> DataFrame:
    """Active terms in id order, or the default terms when none is active."""
    spark = terms.sparkSession
    active = terms.where("is_active").select("id", "term")
    none_active = active.agg(F.count("*") == 0).scalar()
    defaults = spark.createDataFrame(
        [(i, t) for i, t in enumerate(vocab.DEFAULT_TERMS, 1)], "id bigint, term string"
    ).where(none_active)
    return active.unionByName(defaults).orderBy("id")


def fallback_error(terms: DataFrame) -> DataFrame:
    """One failure row when the default terms had to be used, else none."""
    counted = terms.agg(F.count_if("is_active").alias("n")).where("n = 0")
    return counted.select(
        F.lit("No active search terms in DB; using DEFAULT_SEARCH_TERMS fallback.").alias("message"),
        F.to_json(F.struct(F.array(*[F.lit(t) for t in vocab.DEFAULT_TERMS]).alias("default_terms"))).alias("payload"),
    )


def advance_watermarks(terms: DataFrame, finished: DataFrame, run_at) -> DataFrame:
    """Terms with `last_scraped_at` set to the run time where the term finished."""
    done = finished.select("term").distinct().withColumn("_done", F.lit(True))
    return (
        terms.join(done, "term", "left")
        .withColumn("last_scraped_at", F.when(F.col("_done"), run_at).otherwise(F.col("last_scraped_at")))
        .select(*terms.columns)
    )


def page_stops(pages: DataFrame) -> DataFrame:
    """Per term where its pages end: `stop`, the first page number from 1 on without a usable page, and its `kind`.

    `pages` has (term, page, state) rows; a page that landed more than once is as good as
    its best copy. The kind is 'wrong' where a page landed without a list of rows, 'lost' where its
    document is cut, and null where nothing landed. Islands of page numbers are found by an
    anti-join of each page with its successor, so that no term is sorted in one task.
    """
    rank = F.when(F.col("state") == "usable", 0).when(F.col("state") == "wrong", 1).otherwise(2)
    known = pages.where("term is not null and page is not null").groupBy("term", "page").agg(F.min(rank).alias("rank"))
    good = known.where("rank = 0").select("term", "page")
    # page 0 is good for every term, so that a term without a first page stops at 1
    good = good.unionByName(known.select("term", F.lit(0).alias("page")).distinct())
    ends = good.select("term", (F.col("page") + 1).alias("page")).join(good, ["term", "page"], "left_anti")
    stops = ends.groupBy("term").agg(F.min("page").alias("page"))
    kind = F.when(F.col("rank") == 1, "wrong").when(F.col("rank") == 2, "lost")
    return stops.join(known.where("rank > 0"), ["term", "page"], "left").select("term", F.col("page").alias("stop"), kind.alias("kind"))


def finished_terms(pages: DataFrame, cuts: DataFrame) -> DataFrame:
    """Terms whose watermark may move.

    Pages are taken in order from 1. A term is finished when it reaches a known post (`cuts`) on
    them, or when they end after the first: with the last page, with one that did not land or with a cut
    document. A page without a list of rows is a failure of the term, whatever its
    number; so is a missing first page.
    """
    stops = page_stops(pages).join(cuts.select("term", F.col("cut.page").alias("_reached")), "term", "left")
    reached = F.coalesce(F.col("_reached") < F.col("stop"), F.lit(False))
    return stops.where(reached | ((F.col("stop") > 1) & ~F.col("kind").eqNullSafe("wrong"))).select("term")
