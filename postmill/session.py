"""Session settings and shared scratch space."""

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_shipped: str | None = None
#: Scratch folders of sessions on one machine that name none, by application.
_own: dict[str, str] = {}


def build_session(app: str = "postmill", **options) -> SparkSession:
    """A session with the settings the library is tuned for; `options` win."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in options.items()})
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by spark.checkpoint.dir."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return configured.rstrip("/")


def local_scratch(spark: SparkSession) -> SparkSession:
    """Have a scratch folder for a session of one machine that names none (tests, bench, smoke runs).

    The setting cannot be changed in a running session, so the folder is kept here.
    """
    application = spark.sparkContext.applicationId
    if not spark.conf.get("spark.checkpoint.dir", None) and application not in _own:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _own[application] = tempfile.mkdtemp(prefix="spark-")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per Spark context."""
    global _shipped
    if _shipped != spark.sparkContext.applicationId:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "postmill.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(package):
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("postmill", os.path.relpath(path, package)))
        spark.sparkContext.addPyFile(archive)
        _shipped = spark.sparkContext.applicationId
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/postmill/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whichever one that is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly below a path of the shared file system; none where it does not exist."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(status.getPath().getName() for status in files.listStatus(folder)) if files.exists(folder) else []


@contextmanager
def staging(spark: SparkSession):
    """Staged tables that are deleted at the end: yields a function like `stage`."""
    paths = []

    def staged(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        paths.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield staged
    finally:
        for path in paths:
            delete(spark, path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: cuts lineage and keeps column pruning.

    Used where several writes derive from one expensive frame. Losing executors
    costs nothing, since the rows are files in the shared folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
