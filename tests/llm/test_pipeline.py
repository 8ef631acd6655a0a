import os

import corpus_pipeline
from cases import documents, prose, texts
from test_jaccard import expected as components
from test_linedup import maximal as line_runs

import __spark_entry__ as entry_points
from postmill.llm import jaccard

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_operator_and_the_pipeline_are_registered():
    names = entry_points.queries()
    assert "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))


def test_stages_on_awkward_rows(spark, tmp_path):
    """Every stage keeps the columns, clashing ones too, and does what its operator says."""
    docs = documents(spark)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, prose(1, 60))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [r for r in texts() if r[0] is not None and r[0] != 16]
    docs = docs.where("doc_id is not null and doc_id <> 16").drop("kept")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    cleaned = {r.doc_id: r for r in corpus_pipeline.line_stage(spark, docs, str(tmp_path)).collect()}
    by_id = {d: t for d, t, *_ in rows}
    for doc, (_, removed, text) in line_runs(by_id).items():
        if removed and not text.strip():
            assert doc not in cleaned
        else:
            assert cleaned[doc].text == text and (not removed or cleaned[doc].n_chars == len(text))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()}
    assert kept == {d for d, (_, root) in components(by_id, jaccard.Rule(5, 80)).items() if d == root}
    clean = {r.doc_id for r in corpus_pipeline.benchmark_stage(spark, docs, str(tmp_path)).collect()}
    assert 0 not in clean and 8 in clean


def test_run_returns_a_subset_of_documents(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert out.columns == docs.columns
    assert 0 < out.count() < docs.count()
    assert out.select("doc_id").distinct().count() == out.count()
