"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
`documents`. `run` applies them in order to the documents of a folder.

In every stage an empty table stays empty, further columns pass through whatever their names, and
repeated rows are treated alike: all of them stay or go, except where a stage keeps one row of each group by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import decontaminate, jaccard, linedup, mixing, quality
from postmill.llm.scratch import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier; the others go.

    A null or empty text has too few words and goes. Rows without an id are judged by their text like all others.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.judge(docs, quality.train(docs, labels), keep=tuple(docs.columns), prefix="__quality_")
    return judged.where("__quality_kept").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; documents that lose all their words go.

    Null texts and rows without an id stay as they are. Of equal runs the one in the document of the least id stays.
    """
    cleaned = linedup.without_repeats(docs, prefix="__lines_")
    worded = F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.col("__lines_n_removed_lines") == 0)
    cleaned = cleaned.where(worded)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("__lines_n_removed_lines") > 0, length).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: that of the smallest id.

    Texts without words and rows without an id are linked with nothing and stay; rows of one id stay together.
    """
    return jaccard.one_of_each(docs, jaccard.Rule(size=5, above=80))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window like a benchmark item; the others go.

    Null and empty texts and items match nothing; rows without an id stay.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics have their target weights.

    Null sources and languages are values of their own; texts without words cost nothing and stay.
    """
    return mixing.sample(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The classifier's verdicts and the fitted weights are not expressible in SQL; tests compare with sequential versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        label = name.replace(" ", "-")
        docs = scratch.write(stage(spark, docs, sf_dir), label)
        if before:
            scratch.release(before)
        before = label
    return docs
