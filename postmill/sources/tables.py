"""The table store: parquet folders under one root, or tables over JDBC."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import schema
from postmill.session import delete
from postmill.sources import deadletter


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """An empty frame the optimizer knows to be empty, so joins with it vanish."""
    fields = schema.TABLES[name].fields
    return spark.range(1).where(F.lit(False)).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    )


class Store:
    """Tables of one deployment.

    Posts are partitioned by publication month, so date filters prune folders
    without leaving a file per day.
    Search terms are small and mutable: every change writes a new version, and
    readers take the newest complete one. The star tables are filled by loads: each writes
    below its own id, and counts once the id is published for all of them.
    """

    VERSIONED = ("search_terms",)

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def rows_below(self, path: str, columns: schema.T.StructType) -> DataFrame | None:
        """Rows below a path, or None where nothing was written."""
        try:
            return self.spark.read.schema(columns).parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _version(self, name: str) -> int:
        """The newest complete version: published ones are listed, with or without rows."""
        listed = self.rows_below(self.path(f"{name}_versions"), schema.VERSION)
        return 0 if listed is None else listed.agg(F.max("version")).first()[0] or 0

    def loads(self) -> list[str]:
        """Ids of the published loads, without those that a merged one replaces."""
        listed = self.rows_below(self.path("loads"), schema.LOAD)
        if listed is None:
            return []
        rows = listed.collect()
        gone = {load for row in rows for load in row.replaces}
        return sorted({row.load for row in rows} - gone)

    def new_load(self) -> str:
        return f"load-{uuid.uuid4().hex}"

    def publish(self, load: str, replaces: tuple[str, ...] = ()) -> None:
        """Let readers see all that `load` wrote, in place of `replaces`: one small file decides."""
        listed = self.spark.createDataFrame([(load, list(replaces))], schema.LOAD)
        listed.coalesce(1).write.mode("append").parquet(self.path("loads"))

    def merge_loads(self) -> str | None:
        """Rewrite all published loads as one, so that the number of files does not grow with the number of loads.

        What was replaced stays until `vacuum`, for those who still read it.
        """
        loads = self.loads()
        if len(loads) < 2:
            return None
        merged = self.new_load()
        for name in schema.STAR:
            self.append(name, self.read(name), merged)
        self.publish(merged, tuple(loads))
        return merged

    def vacuum(self) -> None:
        """Delete what no published load holds: replaced loads, and what failed ones left. No load may be under way."""
        kept = set(self.loads())
        for name in schema.STAR:
            stored = self.rows_below(self.path(name), schema.T.StructType([schema.T.StructField("load", schema.T.StringType())]))
            if stored is not None:
                for row in stored.select("load").distinct().collect():
                    if row.load not in kept:
                        delete(self.spark, f"{self.path(name)}/load={row.load}")

    def read(self, name: str) -> DataFrame:
        columns = schema.TABLES[name]
        path = self.path(name)
        if name in schema.STAR:
            loads = self.loads()
            with_load = schema.T.StructType([*columns.fields, schema.T.StructField("load", schema.T.StringType())])
            stored = self.rows_below(path, with_load) if loads else None
            if stored is None:
                return empty_table(self.spark, name)
            return stored.where(F.col("load").isin(loads)).select(*columns.fieldNames())
        if name in self.VERSIONED:
            path = f"{path}/version={self._version(name)}"
        elif name == "jobs_posts":
            columns = schema.T.StructType(
                columns.fields + [schema.T.StructField("published_month", schema.T.DateType())]
            )
        stored = self.rows_below(path, columns)
        return empty_table(self.spark, name) if stored is None else stored

    def append(self, name: str, rows: DataFrame, load: str | None = None) -> None:
        """Add rows. Those of a star table belong to `load` and are seen once that is published; without one they are at once."""
        columns = [f.name for f in schema.TABLES[name].fields]
        rows = rows.select(*columns)
        if name in schema.STAR:
            own = load or self.new_load()
            rows.write.mode("append").parquet(f"{self.path(name)}/load={own}")
            if not load:
                self.publish(own)
        elif name == "jobs_posts":
            # one month may hold most rows: AQE splits big months into several files
            rows.withColumn("published_month", F.trunc("published_date", "month")).hint(
                "rebalance", "published_month"
            ).write.mode("append").partitionBy("published_month").parquet(self.path(name))
        else:
            rows.write.mode("append").parquet(self.path(name))

    def log(self, errors: DataFrame) -> None:
        """Append error rows that are not logged yet."""
        self.append("error_logs", deadletter.unlogged(errors, self.read("error_logs")))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Publish a new version of a small mutable table.

        The version is listed once its rows are complete; what a failed attempt left is overwritten.
        """
        columns = [f.name for f in schema.TABLES[name].fields]
        version = self._version(name) + 1
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path(name)}/version={version}")
        listed = self.spark.createDataFrame([(version,)], schema.VERSION)
        listed.coalesce(1).write.mode("append").parquet(self.path(f"{name}_versions"))


def jdbc_table(
    spark: SparkSession, url: str, table: str, key: str, bounds: tuple, partitions: int, **options
) -> DataFrame:
    """A database table read in parallel ranges of an integer key.

    `bounds` only decide how the ranges are cut; rows outside them are read too.
    """
    low, high = bounds
    return (
        spark.read.format("jdbc")
        .options(**options)
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", key)
        .option("lowerBound", low)
        .option("upperBound", high)
        .option("numPartitions", partitions)
        .load()
    )
