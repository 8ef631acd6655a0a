"""Dead-letter rows: what failed, where, and the offending payload."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import schema
from postmill.functions import coerce


def now_utc() -> Column:
    """Current time as naive UTC, whatever the session time zone."""
    return coerce.naive_utc(F.current_timestamp())


def error_rows(
    failures: DataFrame, source: str, payload: Column = None, created_at: Column = None, run: str = ""
) -> DataFrame:
    """Failures (with at least `message`) as error-log rows.

    Text payloads are stored as given, anything else as JSON. The id is a hash of
    the content and the run, so a repeated run logs nothing twice.
    """
    present = set(failures.columns)

    def optional(name, kind):
        return (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)

    if payload is None:
        payload = F.col("payload") if "payload" in present else F.lit(None).cast("string")
    stamp = (now_utc() if created_at is None else created_at).cast("timestamp_ntz").alias("created_at")
    content = failures.select(
        F.lit(source).alias("source"),
        F.col("message").cast("string").alias("message"),
        optional("term", "string"),
        optional("page", "int"),
        optional("request_limit", "int"),
        payload.cast("string").alias("payload"),
        stamp,
    )
    return content.select(F.xxhash64(F.lit(run), *content.columns[:-1]).alias("id"), *content.columns)


def unlogged(errors: DataFrame, logged: DataFrame) -> DataFrame:
    """Error rows whose id is not logged yet, each once."""
    return errors.dropDuplicates(["id"]).join(logged.select("id"), "id", "left_anti")
