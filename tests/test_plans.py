"""Properties of physical plans that matter at scale."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from postmill.catalog import adapter, analytics, ingesting, listings, loading, texts
from postmill.functions import coerce, entities
from postmill.operators import trends
from postmill.plans import extraction
from postmill.session import scratch_path
from postmill.sources.tables import Store, empty_table

SF_DIR = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [
    analytics.technology_trends_dense, analytics.table_counts, listings.job_records, ingesting.newer_prefix,
    ingesting.active_terms,
])
def test_no_cross_joins(spark, query):
    text = plan(query(spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_copies_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(ingesting.first_per_id(spark, SF_DIR))


def test_pages_are_a_distributed_top_n(spark):
    assert "TakeOrderedAndProject" in plan(listings.job_page_by_salary(spark, SF_DIR))


def test_text_features_do_not_shuffle_by_key(spark):
    text = plan(texts.extracted_features(spark, SF_DIR))
    assert "hashpartitioning" not in text and "ArrowEvalPython" not in text


def test_mentions_are_searched_once(spark):
    """The pattern of salaries stands once in the plan of a load's job values, however often its hits are used."""
    fields = extraction.job_fields(extraction.with_text_features(adapter.posts(spark, SF_DIR)), "regex")
    text = fields._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("a\\s+combinar") == 1


def test_posts_of_one_file_are_taken_apart_in_all_cores(spark, monkeypatch):
    """The job values of a load are computed in as many tasks as there are cores, however few files the orders are."""
    monkeypatch.setattr(adapter, "text_table", adapter.table)
    staged = []
    monkeypatch.setattr(loading, "stage", lambda frame, label: staged.append(frame) or frame)
    fields = loading._fields(spark, SF_DIR)
    assert staged == [fields] and fields.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_entities_are_told_in_one_pass(spark):
    """Frequent entities are looked up in the parts of a text, not searched for in the whole text name by name."""
    frame = adapter.posts(spark, SF_DIR).select(entities.unescape("description").alias("t"))
    assert "replace(" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_stack_components_are_counted_without_sets(spark):
    featured = extraction.with_text_features(adapter.posts(spark, SF_DIR)).select("features.tech_stack")
    assert "array_intersect" not in featured._jdf.queryExecution().optimizedPlan().toString()


def test_first_spellings_are_found_by_plain_keys(spark):
    """Keys are no fields of a struct, whose type Spark works out for every place; nulls are dropped, the first spelling stays."""
    lists = [["Go", "SQL"], ["sql", "SQL", "Go", "Sql", "GO"], ["b", None, "a"], [None], [], None]
    frame = spark.createDataFrame([(i, names) for i, names in enumerate(lists)], "id int, names array<string>")
    told = frame.select("id", coerce.distinct_ignoring_case(F.col("names")).alias("names"))
    assert ".key" not in told._jdf.queryExecution().optimizedPlan().toString()
    assert [r.names for r in told.orderBy("id").collect()] == [["Go", "SQL"], ["sql", "Go"], ["b", "a"], [], [], None]


def test_responses_are_parsed_once(spark):
    """All fields of a response read one parsed value, and responses of one file are parsed in many tasks."""
    responses = texts.model_responses(spark, SF_DIR)
    text = responses._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("parse_json") + text.count("parseJson") == 1
    assert responses.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_rows_of_one_term_are_dealt(spark):
    """Where the table of terms is not broadcast, the rows of a term meet it in many tasks."""
    from pyspark.sql import functions as F

    from postmill.operators import ingest

    rows = spark.range(2000).selectExpr("'dev' as term", "int(id div 40) as page", "int(id % 40) as position", "id % 900 as id")
    rows = rows.selectExpr("*", "timestamp_ntz '2024-01-01' as published_date")
    terms = spark.range(3).selectExpr("element_at(array('dev', 'ops', 'qa'), int(id) + 1) as term", "id", "timestamp_ntz '2020-01-01' as last_scraped_at")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        kept = ingest.newer_prefix(rows, terms)
        assert kept.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        first = ingest.first_per_id(rows, terms)
        assert first.count() == 900 and kept.count() == 2000 and "_part" in plan(first)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_landed_rows_are_parsed_once(spark, monkeypatch):
    """The cuts, the new posts and the errors of a run read rows that are parsed already."""
    from postmill.plans import ingest
    from postmill.sources import pages

    path, store = scratch_path(spark, "landing"), Store(spark, scratch_path(spark, "store"))
    ingesting.page_documents(spark, SF_DIR).write.text(path)
    store.replace("search_terms", ingesting._terms(spark, SF_DIR).selectExpr("*", "true as is_active"))
    plans, own = [], ingest.new_posts
    monkeypatch.setattr(ingest, "new_posts", lambda rows, *others: plans.append(plan(rows)) or own(rows, *others))
    ingest.ingest_pages(store, pages.read_pages(spark, path))
    assert plans and "from_json" not in plans[0]


def test_trend_window_prunes_month_folders(spark):
    store = Store(spark, scratch_path(spark, "store"))
    posts = empty_table(spark, "jobs_posts").unionByName(
        spark.sql("select id, timestamp_ntz '2024-01-05' + make_interval(0, cast(id as int)) as published_date from range(6)"),
        allowMissingColumns=True,
    )
    store.append("jobs_posts", posts)
    daily = trends.daily_counts(
        store.read("jobs_posts"), store.read("jobs"), store.read("job_hard_skills"), store.read("hard_skills"),
        date(2024, 4, 20),
    )
    recent = store.read("jobs_posts").where("published_month >= date '2024-04-01'")
    assert daily.count() == 0
    assert "PartitionFilters: [isnotnull(published_month" in plan(recent)


def test_pending_posts_exchange_ids_only(spark):
    store = Store(spark, scratch_path(spark, "store"))
    posts = empty_table(spark, "jobs_posts").unionByName(
        spark.range(50).selectExpr("id", "repeat('text ', 100) as description"), allowMissingColumns=True
    )
    store.append("jobs_posts", posts)
    stored = spark.range(20).write.mode("append")
    stored.parquet(store.path("known"))
    known = spark.read.parquet(store.path("known"))
    text = plan(extraction.pending_ids(store.read("jobs_posts"), known))
    assert "description" not in text
    assert extraction.pending_posts(store.read("jobs_posts"), known).count() == 30


def test_timestamps_are_taken_apart_once(spark):
    """The pattern of a timestamp runs once to test a text and once for each of its three parts."""
    from postmill.functions import coerce

    rows = spark.createDataFrame([("2024-01-02T03:04:05-03:30",)], "t string")
    text = rows.select(coerce.parse_datetime(rows.t).alias("at"))._jdf.queryExecution().analyzed().toString()
    assert text.count("(?:.(") == 4


def test_pages_are_ranked_once(spark):
    """The last page of a kind is counted, not found by a second sort of all its events."""
    assert plan(ingesting.uneven_pages(spark, SF_DIR)).count("Window [") == 1


def test_extractors_run_on_pending_rows_once(spark):
    """The filters of a load are not pushed below its join, where the extractor would run on all posts a second time."""
    from postmill.catalog import loading

    stored = loading._described(spark, SF_DIR).join(spark.range(5), "id", "left_semi")
    featured = extraction.with_custom_features(stored, extraction.guarded(loading._counted_words, loading._RESULT))
    text = plan(extraction.job_fields(featured, "custom"))
    assert text.count("ArrowEvalPython") == 1 and text.index("ArrowEvalPython") < text.index("LeftSemi")


def test_failing_batches_are_tried_in_parts():
    """A few rows that raise cost few calls, and change no other row."""
    import pandas as pd

    from postmill.catalog import loading

    calls = []

    def counted(description):
        calls.append(len(description))
        return loading._counted_words(description)

    texts_of = ["a | b" if i in (7, 8, 999) else "" if i % 50 == 0 else f"w{i} " * (i % 9 + 1) for i in range(1000)]
    got = extraction.guarded(counted, loading._RESULT).func(pd.Series(texts_of))
    assert len(calls) < 120
    assert got["error"].notna().tolist() == ["|" in t for t in texts_of]
    for text, title, years in zip(texts_of, got["job_title"], got["years_experience"], strict=True):
        assert (title, years) == ((None, None) if "|" in text else (text.split()[0] if text else "none", len(text.split())))


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_at_depth_sort_single_ranges(spark, order):
    """Pages of any depth, with nulls and ties across ranges; the rows that are sorted lie in few ranges."""
    from postmill.operators import listing

    rows = spark.range(500).selectExpr("id", "case when id % 7 <> 0 then id % 5 end as kind", "repeat('x', 50) as body")
    by = listing.ordering("kind", {"kind": "kind"}, "kind", order)
    whole = [r.id for r in rows.orderBy(*by).collect()]
    for page in (1, 2, 9, 13, 14, 40):
        got = listing.page_at_depth(rows, "kind", order, page, 39, partitions=8)
        assert [r.id for r in got.collect()] == whole[(page - 1) * 39 : page * 39]
    assert listing.page_at_depth(rows.where("false"), "kind", order, 1, 5).collect() == []
