"""The technology-trend report."""

from datetime import date

from pyspark.sql import DataFrame

from postmill.operators import trends


def technology_trends(
    posts: DataFrame, jobs: DataFrame, bridge: DataFrame, skills: DataFrame,
    as_of: date, days: int = 30, limit: int = 5, skill: str = None,
) -> DataFrame:
    """Dense (technology, total, period, count) rows for the leading technologies."""
    since, until = trends.window_of(as_of, days)
    daily = trends.daily_counts(posts, jobs, bridge, skills, since, skill)
    return trends.dense_series(daily, trends.totals(daily, limit, skill), since, until)
