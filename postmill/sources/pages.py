"""Landed pages of raw posts, one JSON document per line.

Rows inside a page are kept as JSON text until they are exploded. A damaged row
then costs only itself, absent and null keys stay distinguishable, and the
dead letter carries the row as it was landed.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill import schema
from postmill.functions import coerce

RAW_PAGE = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("data", T.ArrayType(T.StringType())),
    T.StructField("pagination", T.StructType([T.StructField("total", T.LongType())])),
    T.StructField("_corrupt", T.StringType()),
])

STRICT_KEYS = (
    "id", "companyId", "name", "description",
    "careerPageId", "careerPageName", "careerPageLogo", "careerPageUrl",
)


def _options(reader):
    return (
        reader.schema(RAW_PAGE)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
    )


def _named(pages: DataFrame) -> DataFrame:
    """`pages` with the term and page of cut documents, as far as their text or path tells them.

    A path tells them by folders or a file name like `term=dev/page=3.json`.
    """
    path = F.col("_metadata.file_path")

    def told(text: str, place: str, value: Column) -> Column:
        inside = F.regexp_extract("_corrupt", text, 1)
        outside = F.url_decode(F.regexp_extract(path, place, 1))
        return F.coalesce(value, F.nullif(inside, F.lit("")), F.nullif(outside, F.lit("")))

    cut = F.col("_corrupt").isNotNull()
    # only whole strings: the value may be what is cut
    term = told(r'^\s*\{\s*"term"\s*:\s*"([^"\\]*)"', r"(?:^|/)term=([^/]+)/", F.col("term"))
    page = told(r'^[^\[]{0,512}?"page"\s*:\s*(\d+)\s*[,}]', r"(?:^|/)page=(\d+)(?:[./]|$)", F.col("page").cast("string"))
    return pages.withColumns({
        "term": F.when(cut, term).otherwise(F.col("term")), "page": F.when(cut, page.try_cast("int")).otherwise(F.col("page")),
    })


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return _named(_options(spark.read).json(path))


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Pages as they land, at most `files_per_batch` files in a micro-batch."""
    return _named(_options(spark.readStream).option("maxFilesPerTrigger", files_per_batch).json(path))


def _is_bad() -> Column:
    return F.col("data").isNull() | F.col("_corrupt").isNotNull()


def _is_broken() -> Column:
    # a cut document may still yield its leading fields, so ask a JSON parser
    return F.col("_corrupt").isNotNull() & F.try_parse_json("_corrupt").isNull()


def page_states(pages: DataFrame) -> DataFrame:
    """term, page and state of every landed page: 'usable', 'lost' (broken JSON) or 'wrong' (no list of rows)."""
    state = F.when(~_is_bad(), "usable").when(_is_broken(), "lost").otherwise("wrong")
    return pages.select("term", "page", state.alias("state"))


def page_errors(pages: DataFrame) -> DataFrame:
    """One row per unusable page: broken JSON, or `data` absent or not a list."""
    broken = _is_broken()
    return pages.where(_is_bad()).select(
        F.when(broken, "invalid JSON in page").otherwise("missing or invalid data list").alias("message"),
        "term",
        "page",
        F.coalesce("_corrupt", F.to_json(F.struct("term", "page", "pagination"))).alias("payload"),
    )


def explode_pages(pages: DataFrame) -> DataFrame:
    """One row per listed post with its term, page and position on the page."""
    listed = pages.where(~_is_bad()).select(
        "term", "page", F.posexplode("data").alias("position", "raw")
    )
    return listed.select(
        "term", "page", "position", "raw",
        F.from_json("raw", schema.LANDED_ROW).alias("landed"),
        F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>")).alias("keys"),
    )


def to_posts(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Landed rows as posts plus `reasons`, the list of why a row is unusable.

    Strict rows need all mandatory keys; lenient rows only an id.
    """
    landed = {name: F.col(f"landed.{name}") for name in schema.LANDED_ROW.fieldNames()}
    columns = {stored: landed[name] for name, stored in schema.LANDED_TO_POST.items()}
    columns["published_date"] = coerce.parse_datetime(landed["publishedDate"])
    columns["application_deadline"] = coerce.parse_date(landed["applicationDeadline"])
    if strict:
        for name in ("skills", "badges"):
            falsy = columns[name].isin("", "[]", "{}", "0", "false")
            columns[name] = F.when(~falsy, columns[name])
    else:
        absent_name = ~F.array_contains("keys", "name")
        columns["name"] = F.when(absent_name, F.lit("")).otherwise(columns["name"])
        for name in ("skills", "badges"):
            columns[name] = F.coalesce(columns[name], F.lit("null"))
    posts = rows.select(
        "term", "page", "position", "raw", "keys", *[c.alias(name) for name, c in columns.items()]
    )
    return posts.withColumn("reasons", _reasons(strict)).drop("keys")


def _reasons(strict: bool) -> Column:
    required = STRICT_KEYS if strict else ("id",)
    missing = F.array_except(F.array(*[F.lit(k) for k in required]), F.col("keys"))
    checks = [
        F.when(F.size(missing) > 0, F.concat(F.lit("missing keys: "), F.array_join(missing, ", "))),
        F.when(F.col("id").isNull(), "id is null"),
        F.when(F.col("name").isNull(), "name is null"),
    ]
    return F.array_compact(F.array(*checks))


def usable(posts: DataFrame) -> DataFrame:
    return posts.where(F.size("reasons") == 0).drop("raw", "reasons")


def rejected(posts: DataFrame) -> DataFrame:
    """Dead-letter fields of the unusable rows."""
    return posts.where(F.size("reasons") > 0).select(
        F.array_join("reasons", "; ").alias("message"), "term", "page", F.col("raw").alias("payload")
    )
