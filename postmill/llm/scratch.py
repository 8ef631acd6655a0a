"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmill.session import delete, scratch_path


class Scratch:
    """Tables of one operator run: written once, read back, deleted when done.

    A written table cuts lineage: a lost executor costs the running tasks only.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.count = spark, scratch_path(spark, label), 0
        self.open: dict[str, str] = {}

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(path)
        self.open[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            path = self.open.pop(name, None)
            if path:
                delete(self.spark, path)

    def keep(self, *names: str) -> None:
        """Delete all tables but `names`, which a result still reads."""
        self.release(*(name for name in list(self.open) if name not in names))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
