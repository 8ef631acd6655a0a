"""Evaluate an expression once inside a higher-order function."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row.

    A column used inside a lambda is otherwise re-evaluated for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
