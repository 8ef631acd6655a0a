"""Daily technology counts, dense series and their summaries."""

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.operators.listing import clamp


def requested(days=None, limit=None):
    """A request's window length, kept within 7..90 days, and number of technologies, within 1..10.

    The operators themselves do what they are asked.
    """
    return clamp(days, 30, 7, 90), clamp(limit, 5, 1, 10)


def window_of(as_of: date, days: int = 30):
    """First and last day of a trend window of `days` days."""
    return as_of - timedelta(days=days - 1), as_of


def daily_counts(
    posts: DataFrame, jobs: DataFrame, bridge: DataFrame, skills: DataFrame, since: date, skill: str = None
) -> DataFrame:
    """Jobs per (day, technology) published on or after `since`.

    Everything joins on the unique job id. Counts are taken per skill id first
    and named afterwards, so no join sees a hot skill.
    """
    recent = posts.where(F.col("published_date").isNotNull() & (F.col("published_date") >= F.lit(since)))
    if "published_month" in posts.columns:
        recent = recent.where(F.col("published_month") >= F.lit(since.replace(day=1)))
    dated = recent.select(F.col("id").alias("job_id"), F.to_date("published_date").alias("period"))
    named = skills.select(F.col("id").alias("hard_skill_id"), F.col("name").alias("technology"))
    if skill and skill.strip():
        named = named.where(F.lower("technology") == skill.strip().lower())
        bridge = bridge.join(named.select("hard_skill_id"), "hard_skill_id", "left_semi")
    counted = (
        bridge.join(dated, "job_id")
        .join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
        .groupBy("period", "hard_skill_id")
        .agg(F.count("*").alias("n"))
    )
    return (
        counted.join(named, "hard_skill_id")
        .groupBy("period", "technology")
        .agg(F.sum("n").alias("count"))
    )


def totals(daily: DataFrame, limit: int = 5, skill: str = None) -> DataFrame:
    """Totals of the technologies to show: the largest few, or all of a requested skill."""
    summed = daily.groupBy("technology").agg(F.sum("count").alias("total"))
    if skill and skill.strip():
        return summed.orderBy("technology")
    return summed.orderBy(F.desc("total"), "technology").limit(limit)


def dense_series(daily: DataFrame, kept: DataFrame, since: date, as_of: date) -> DataFrame:
    """One count per technology and day of the window, 0 where nothing was posted."""
    grid = kept.select(
        "technology", "total", F.explode(F.sequence(F.lit(since), F.lit(as_of))).alias("period")
    )
    return grid.join(daily, ["technology", "period"], "left").select(
        "technology", "total", "period", F.coalesce("count", F.lit(0)).alias("count")
    )


def packed_series(dense: DataFrame) -> DataFrame:
    """One row per technology with the counts in day order."""
    ordered = F.sort_array(F.collect_list(F.struct("period", "count")))
    return dense.groupBy("technology", "total").agg(
        F.transform(ordered, lambda d: d["count"]).alias("counts")
    )


def summary(dense: DataFrame) -> DataFrame:
    """Window, busiest day (the first one of equals), overall total and peak count."""
    # every day has one row per technology, so the totals of any day are all totals
    by_day = dense.groupBy("period").agg(
        F.sum("count").alias("day_total"),
        F.max("count").alias("day_peak"),
        F.count("*").alias("series"),
        F.sum("total").alias("series_total"),
    )
    busiest = F.max_by("period", F.struct("day_total", (-F.unix_date("period")).alias("earliest")))
    return by_day.agg(
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        busiest.alias("busiest_day"),
        F.max("day_total").alias("busiest_total"),
        F.max("series").alias("technologies"),
        F.max("series_total").alias("overall_total"),
        F.greatest(F.lit(1), F.max("day_peak")).alias("peak"),
    )


def series_statistics(dense: DataFrame) -> DataFrame:
    """Active days, latest and peak counts, daily average and date of the latest hit."""
    latest = F.max_by("count", "period")
    return dense.groupBy("technology", "total").agg(
        F.count_if(F.col("count") > 0).alias("active_days"),
        latest.alias("latest"),
        F.max("count").alias("peak"),
        (F.col("total") / F.count("*")).alias("average"),
        F.when(latest > 0, F.max("period")).alias("latest_hit"),
    )
