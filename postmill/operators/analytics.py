"""Aggregates over posts, jobs and skill bridges.

Bridges are counted by key before names are joined, so a skill that holds a
third of all rows is already one partial count per task when it is shuffled.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_counts(posts: DataFrame, jobs: DataFrame, terms: DataFrame, errors: DataFrame) -> DataFrame:
    """Four counts in one row."""

    def rows(table):
        return table.agg(F.count("*")).scalar()

    spark: SparkSession = posts.sparkSession
    return spark.range(1).select(
        rows(posts).alias("total_jobs"),
        rows(jobs).alias("total_processed"),
        rows(terms).alias("total_terms"),
        rows(errors).alias("total_errors"),
    )


def average_posts_per_day(posts: DataFrame) -> DataFrame:
    """Mean posts per calendar day; posts without a date form one more day."""
    daily = posts.groupBy(F.to_date("published_date").alias("day")).agg(F.count("*").alias("n"))
    return daily.agg(F.avg("n").alias("average"))


def average_salary(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.avg("salary").alias("average"))


def _per_key(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def count_by_name(rows: DataFrame, key: str, dimension: DataFrame) -> DataFrame:
    """Rows per dimension name, most frequent first; equal names are merged."""
    names = dimension.select(F.col("id").alias(key), "name")
    return (
        _per_key(rows, key)
        .join(names, key)
        .groupBy("name")
        .agg(F.sum("n").alias("count"))
        .orderBy(F.desc("count"), "name")
    )


def top_technologies(bridge: DataFrame, skills: DataFrame, n: int = 10) -> DataFrame:
    return count_by_name(bridge, "hard_skill_id", skills).limit(n)


def top_locations(jobs: DataFrame, cities: DataFrame, n: int = 10) -> DataFrame:
    return count_by_name(jobs, "city_id", cities).limit(n)


def jobs_by_contract_type(jobs: DataFrame, contract_types: DataFrame) -> DataFrame:
    return count_by_name(jobs, "contract_type_id", contract_types)


def jobs_by_seniority(jobs: DataFrame) -> DataFrame:
    return (
        jobs.where(F.col("seniority").isNotNull())
        .groupBy(F.col("seniority").alias("name"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "name")
    )
