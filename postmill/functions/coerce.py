"""Scalar coercions: dates, numbers, lists, URLs, salary and contract text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions import vocab
from postmill.functions.binding import let

_ISO_DATE = r"(\d{4}-\d{2}-\d{2}|\d{8})"
_ISO_TIME = r"(\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{4}|\d{6}(?:[.,]\d+)?)"
_ISO_ZONE = r"(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?"
_ISO_TIMESTAMP = rf"^{_ISO_DATE}(?:.{_ISO_TIME}{_ISO_ZONE})?$"


def parse_date(text: Column) -> Column:
    """Strict ISO date, dashed or compact; anything else is NULL."""
    return F.when(text.rlike(rf"^{_ISO_DATE}$"), _dashed(text).try_cast("date"))


def parse_datetime(text: Column) -> Column:
    """ISO-8601 text to naive UTC (TIMESTAMP_NTZ); blank or invalid is NULL.

    The offset is subtracted explicitly, so the session time zone plays no part.
    """

    def of(parts):
        clock, zone = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
        # plain concatenation keeps "no time at all" and "time of 0" the same
        local = F.concat(
            F.get(parts, F.lit(0)), F.lit(" "),
            F.substring(clock, 1, 2), F.lit(":"),
            F.substring(clock, 3, 2), F.lit(":"),
            F.substring(clock, 5, 2), F.lit("."),
            F.substring(clock, 7, 6),
        ).try_cast("timestamp_ntz")
        offset = F.rpad(F.substring(zone, 2, 6), 6, "0")
        seconds = (
            F.coalesce(F.substring(offset, 1, 2).try_cast("int"), F.lit(0)) * 3600
            + F.coalesce(F.substring(offset, 3, 2).try_cast("int"), F.lit(0)) * 60
            + F.coalesce(F.substring(offset, 5, 2).try_cast("int"), F.lit(0))
        )
        away = F.when(zone == "", 0).when(zone.startswith("-"), seconds).otherwise(-seconds)
        return F.timestamp_add("SECOND", away, local)

    # bound, as the patterns would run for every use of a part
    day, clock, zone = (F.regexp_extract(text, _ISO_TIMESTAMP, n) for n in (1, 2, 3))
    padded = F.rpad(F.translate(clock, ":,.", ""), 12, "0")
    return F.when(text.rlike(_ISO_TIMESTAMP), let(F.array(_dashed(day), padded, F.translate(zone, ":Z", "")), of))


def _dashed(text: Column) -> Column:
    return F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")


def iso_datetime(ts: Column) -> Column:
    """ISO text of a naive timestamp; the fraction appears only when non-zero.

    Goes through the plain text form, which involves no time zone.
    """
    written = ts.cast("timestamp_ntz").cast("string")
    whole = F.replace(F.substring(written, 1, 19), F.lit(" "), F.lit("T"))
    fraction = F.substring(written, 21, 6)
    return F.when(fraction == "", whole).otherwise(F.concat(whole, F.lit("."), F.rpad(fraction, 6, "0")))


def iso_date(day: Column) -> Column:
    return day.cast("date").cast("string")


def naive_utc(instant: Column) -> Column:
    """An instant as naive UTC, whatever the session time zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def truncate(text: Column, size: int) -> Column:
    return F.substring(text, 1, size)


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def title(extracted: Column, posted: Column) -> Column:
    """Extracted title, else the posted name, else a constant."""
    chosen = F.coalesce(blank_to_null(extracted), blank_to_null(posted), F.lit(vocab.DEFAULT_TITLE))
    return truncate(chosen, 255)


def first_per_key(items: Column, key) -> Column:
    """The items whose key, `key(item)`, is that of no earlier one; items without a key are dropped.

    Lists whose keys are all different are told by their count. The keys are a list by themselves, as
    a field of a struct would have its type worked out for every place.
    """
    def told(given: Column) -> Column:
        def of_keys(keys: Column) -> Column:
            firsts = F.filter(given, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1)
            return F.when(F.size(F.array_distinct(F.array_compact(keys))) == F.size(given), given).otherwise(firsts)

        return let(F.transform(given, key), of_keys)

    return let(items, told)


def distinct_ignoring_case(items: Column) -> Column:
    """Keep the first spelling of every value, comparing in lower case."""
    return first_per_key(items, F.lower)


def tidy_list(items: Column) -> Column:
    """Trim, drop blanks and keep the first spelling of every value."""
    trimmed = F.transform(items, _strip)
    return distinct_ignoring_case(F.filter(trimmed, lambda x: x != ""))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", "")


def split_list(text: Column) -> Column:
    """Comma text to a tidy list; NULL gives an empty list."""
    return F.coalesce(tidy_list(F.split(text, ",")), F.array().cast("array<string>"))


def digits_to_int(text: Column) -> Column:
    """All digits of the text read as one integer; none, or too many, is NULL."""
    return F.regexp_replace(text, r"\D", "").try_cast("int")


def text_to_double(text: Column) -> Column:
    """Number text to double; text that is not a plain number is NULL."""
    plain = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|nan|inf(inity)?)\s*$"
    return F.when(text.rlike(plain), text.try_cast("double"))


def url_host(url: Column) -> Column:
    """Host name of an absolute URL, or `Direct`."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("Direct"))


def stored_list(text: Column) -> Column:
    """A stored JSON list as an array; text that is no such list is one element."""
    parsed = F.from_json(text, "array<string>")
    return F.when(F.size(parsed) > 0, parsed).when(text != "", F.array(text))


def salary_amount(mention: Column) -> Column:
    """First amount of a salary mention as a whole number (bigint).

    Text after the first comma is ignored and dots are thousands separators.
    """
    head = F.split(mention, ",", 2)[0]
    return F.replace(F.regexp_extract(head, r"\d+(?:\.\d+)*", 0), F.lit("."), F.lit("")).try_cast("bigint")


def contract_family(text: Column) -> Column:
    """Map a contract mention to one of the three stored contract types."""
    lowered = F.lower(text)

    def has(*needles):
        found = [F.contains(lowered, F.lit(n)) for n in needles]
        result = found[0]
        for f in found[1:]:
            result = result | f
        return result

    return (
        F.when(has("pj", "jurídica", "juridica"), "PJ / Pessoa Jurídica")
        .when(has("estág", "estag"), "Estágio")
        .otherwise(vocab.DEFAULT_CONTRACT)
    )


def first_contract(candidates: Column) -> Column:
    """First candidate of a list (or the default), mapped to its contract type."""
    return contract_family(F.coalesce(F.get(candidates, F.lit(0)), F.lit(vocab.DEFAULT_CONTRACT)))
