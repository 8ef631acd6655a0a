"""Model responses (JSON text) to the common feature struct.

The response is parsed as VARIANT, because how a value is coerced depends on
its JSON type, not only on its text.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions import coerce
from postmill.functions.binding import let


def _kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def list_field(value: Column, path: str) -> Column:
    """A JSON list, comma text or scalar as a tidy list; NULL gives []."""
    items = F.transform(
        F.try_variant_get(value, path, "array<string>"),
        lambda x: F.coalesce(x, F.lit("None")),
    )
    text = _text(value, path)
    kind = _kind(value, path)
    parts = (
        F.when(kind.startswith("ARRAY"), items)
        .when(kind == "STRING", F.split(text, ","))
        .when(text.isNotNull(), F.array(text))
    )
    return F.coalesce(coerce.tidy_list(parts), F.array().cast("array<string>"))


def int_field(value: Column, path: str) -> Column:
    """Numbers are truncated; of anything else the digits are read as one integer."""
    kind = _kind(value, path)
    text = _text(value, path)
    return F.when(
        _is_number(kind) | (kind == "BOOLEAN"),
        F.try_variant_get(value, path, "double").try_cast("int"),
    ).otherwise(coerce.digits_to_int(text))


def double_field(value: Column, path: str) -> Column:
    kind = _kind(value, path)
    return F.when(
        _is_number(kind) | (kind == "BOOLEAN"), F.try_variant_get(value, path, "double")
    ).when(kind == "STRING", coerce.text_to_double(_text(value, path)))


def salary_field(value: Column, path: str) -> Column:
    """Salary mentions; a JSON number is taken as a whole amount."""
    kind = _kind(value, path)
    items = F.try_variant_get(value, path, "array<string>")
    amount = F.try_variant_get(value, path, "double").try_cast("bigint").cast("string")
    return (
        F.when(kind.startswith("ARRAY"), items)
        .when(_is_number(kind), F.array(amount))
        .when(kind == "STRING", F.array(_text(value, path)))
    )


def response_features(response: Column) -> Column:
    """Feature struct of one response; unreadable responses give empty features."""

    def features(value):
        return F.struct(
            _text(value, "$.job_title").alias("job_title"),
            list_field(value, "$.hard_skills").alias("hard_skills"),
            list_field(value, "$.soft_skills").alias("soft_skills"),
            list_field(value, "$.nice_to_have").alias("nice_to_have"),
            int_field(value, "$.experiencia_anos").alias("years_experience"),
            _text(value, "$.nivel").alias("seniority"),
            salary_field(value, "$.salary").alias("salary"),
            list_field(value, "$.contrato").alias("contract_type"),
            F.array().cast("array<string>").alias("tech_stack"),
            double_field(value, "$.confidence_score").alias("confidence_score"),
        )

    # bound, as the fields would parse the response a dozen times a row
    return let(F.try_parse_json(response), features)
