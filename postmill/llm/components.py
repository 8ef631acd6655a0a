"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.scratch import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node (larger ones, or smaller ones and itself) to its least neighbour."""
    if large:
        pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """(node, root) for every node of `edges` (u, v); the root is the least node it is linked with.

    Every round is a written table, so lineage stays short. Rounds end when no edge
    changes; their number grows with the logarithm of the longest path.
    """
    current = scratch.write(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), f"{name}-0")
    state, turn = None, 0
    while True:
        turn += 1
        following = scratch.write(_stars(_stars(current, large=True), large=False), f"{name}-{turn}")
        scratch.release(f"{name}-{turn - 1}")
        sums = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        current = following
        if tuple(sums) == state or not sums[0]:
            break
        state = tuple(sums)
    roots = current.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
