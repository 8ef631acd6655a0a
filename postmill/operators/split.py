"""Exact ordered split of a frame without sorting it in one task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from postmill.session import stage


def cut_key(rows: DataFrame, key: str, share: float = 0.9, partitions: int = None) -> DataFrame:
    """The key of the last row of the leading `share`, as one row (none if empty).

    Only the key column is range partitioned, and the placement is written once
    so that counts and ranks see the same ranges. Counts per range locate the
    cut; only the range that holds it is ranked. `key` must be unique.
    """
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(
        rows.select(F.col(key).alias("key"))
        .repartitionByRange(partitions, "key")
        .withColumn("part", F.spark_partition_id()),
        "split-keys",
    )
    # as many rows as there are ranges
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    until = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    located = (
        counts.withColumn("upto", F.sum("n").over(until))
        .withColumn("wanted", F.floor(F.sum("n").over(everything) * share))
        .where("upto - n < wanted and wanted <= upto")
        .select("part", (F.col("wanted") - F.col("upto") + F.col("n")).alias("rank"))
    )
    local = Window.partitionBy("part").orderBy("key")
    return (
        placed.join(located, "part")
        .withColumn("n", F.row_number().over(local))
        .where("n = rank")
        .select("key")
    )


def ordered_split(rows: DataFrame, key: str, share: float = 0.9) -> DataFrame:
    """Add `part`: `train` for the first floor(n * share) rows by key, else `test`."""
    cut = cut_key(rows, key, share).scalar()
    return rows.withColumn("part", F.when(F.col(key) <= cut, "train").otherwise("test"))
