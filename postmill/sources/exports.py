"""CSV and JSON-lines exports, record projections, and the labelled-CSV reader."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import schema
from postmill.functions import coerce

POST_CSV_COLUMNS = (
    "id", "company_id", "name", "description", "career_page_name", "career_page_url", "job_type",
    "published_date", "application_deadline", "is_remote_work", "city", "state", "country",
    "job_url", "workplace_type", "disabilities", "skills", "badges",
)

JOB_CSV_COLUMNS = (
    "id", "job_title", "salary", "extractor_type", "company", "contract_type", "state", "city",
    "hard_skills", "soft_skills", "nice_to_have_skills", "tech_stack",
)

JOB_RECORD_COLUMNS = (
    "id", "job_title", "extractor_type", "salary", "seniority", "years_experience", "tech_stack",
    "company_id", "contract_type_id", "state_id", "city_id", "company", "contract_type", "state",
    "city", "hard_skills", "soft_skills", "nice_to_have_skills",
)


def _spelled(flag: str) -> Column:
    return F.when(F.col(flag), "True").when(~F.col(flag), "False").alias(flag)


def post_csv_rows(posts: DataFrame) -> DataFrame:
    """The 18 exported columns of a post, newest first (undated posts lead); equal dates by falling id."""
    special = {
        "published_date": coerce.iso_datetime(F.col("published_date")).alias("published_date"),
        "application_deadline": coerce.iso_date(F.col("application_deadline")).alias("application_deadline"),
        "is_remote_work": _spelled("is_remote_work"),
        "disabilities": _spelled("disabilities"),
    }
    ordered = posts.orderBy(F.col("published_date").desc_nulls_first(), F.col("id").desc())
    return ordered.select(*[special.get(c, F.col(c)) for c in POST_CSV_COLUMNS])


def job_csv_rows(records: DataFrame) -> DataFrame:
    """The 12 exported columns of a job, from resolved job records."""
    special = {
        "salary": F.when(F.col("salary") != 0, F.col("salary")).alias("salary"),
    }
    for name in ("hard_skills", "soft_skills", "nice_to_have_skills", "tech_stack"):
        special[name] = F.array_join(name, ", ").alias(name)
    return records.select(*[special.get(c, F.col(c)) for c in JOB_CSV_COLUMNS])


def write_csv(rows: DataFrame, path: str) -> None:
    """Part files in row order, each with a header; NULL and '' are both empty."""
    rows.write.csv(
        path, header=True, escape='"', emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def post_records(posts: DataFrame) -> DataFrame:
    """The 20-field post record with ISO dates."""
    special = {
        "published_date": coerce.iso_datetime(F.col("published_date")).alias("published_date"),
        "application_deadline": coerce.iso_date(F.col("application_deadline")).alias("application_deadline"),
    }
    return posts.select(*[special.get(f.name, F.col(f.name)) for f in schema.POST.fields])


def error_records(errors: DataFrame) -> DataFrame:
    return errors.select(
        "id", "source", "message", "term", "page", "request_limit", "payload",
        coerce.iso_datetime(F.col("created_at")).alias("created_at"),
    )


def term_records(terms: DataFrame) -> DataFrame:
    """Term records; the watermark is an instant and carries its UTC offset."""
    return terms.select(
        "id", "term", "is_active",
        F.concat(coerce.iso_datetime(F.col("last_scraped_at")), F.lit("+00:00")).alias("last_scraped_at"),
    )


def as_json(records: DataFrame) -> DataFrame:
    """One JSON document per record, with explicit nulls."""
    return records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value"))


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled descriptions: quoted fields may span lines."""
    return spark.read.schema(schema.LABELLED).csv(path, header=True, multiLine=True, escape='"')


def write_examples(examples: DataFrame, path: str) -> None:
    """Token examples as JSON lines."""
    examples.select("id", "tokens", "ner_tags").write.json(path)


def write_entity_csv(features: DataFrame, path: str) -> None:
    write_csv(features, path)
