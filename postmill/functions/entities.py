"""HTML entities decoded by Column expressions, by the rules of HTML 5.

A text is cut at each ampersand. What follows one starts with a name up to a semicolon, with a
number, or with one of the old names that need no semicolon, of which the longest counts;
anything else stays as it is. Names are looked up in a literal array by the code of the first letter,
then by that of the second one, and in a map of the few rests there.
"""

import html
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.binding import let

#: Names that count without a semicolon, longest first.
_OLD = sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))
_OLD_PATTERN = "^(?:" + "|".join(_OLD) + ")"
#: Names of letters and signs that most entities of adverts are.
_FREQUENT = (
    "nbsp", "aacute", "acirc", "agrave", "atilde", "ccedil", "eacute", "ecirc", "iacute", "oacute", "ocirc", "otilde",
    "uacute", "Aacute", "Atilde", "Ccedil", "Eacute", "Oacute", "bull", "ndash", "ordf",
)
_NUMBER_PATTERN = "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?"
#: What the numbers stand for that do not stand for their own code point: controls, and a code page of old.
_ODD = {n: html.unescape(f"&#{n};") for n in range(0xA0) if html.unescape(f"&#{n};") != chr(n)}


def _by_code(entries: dict) -> tuple[list, int]:
    """Values in a list by the code of their one-letter keys, and the code that the list starts with."""
    first = min(map(ord, entries))
    return [entries.get(chr(code)) for code in range(first, max(map(ord, entries)) + 1)], first


def _nested() -> tuple[list, int, int]:
    out: dict = {}
    for name, value in html5.items():
        if name.endswith(";"):
            name = name[:-1]
            out.setdefault(name[0], {}).setdefault(name[1], {})[name[2:]] = value
    least = min(letter for seconds in out.values() for letter in seconds)
    rows = {letter: _by_code({least: None, **seconds})[0] for letter, seconds in out.items()}
    return *_by_code(rows), ord(least)


def _named(name: Column) -> Column:
    """What a name stands for, null if it is none."""
    names, first, second = _nested()
    table = F.from_json(F.lit(json.dumps(names)), "array<array<map<string, string>>>")
    rests = F.get(F.get(table, F.ascii(name) - first), F.ascii(F.substring(name, 2, 1)) - second)
    return F.try_element_at(rests, F.substr(name, F.lit(3)))


def _character(digits: Column, hexadecimal: Column) -> Column:
    """The character of a number: what its code point is mapped to, nothing for a code that is none, else itself."""
    plain = F.ltrim(digits, F.lit("0"))
    size = F.char_length(plain)
    code = F.when(size > 7, F.lit(0x110000).cast("bigint")).when(hexadecimal, F.conv(plain, 16, 10).cast("bigint")).otherwise(plain.try_cast("bigint"))
    code = F.coalesce(code, F.lit(0).cast("bigint"))

    def told(n: Column) -> Column:
        odd = F.create_map(*(F.lit(part) for n_, text in _ODD.items() for part in (n_, text)))
        unpaired = n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        none = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        own = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return (
            F.when(unpaired, "�").when(n < 0xA0, F.coalesce(F.element_at(odd, n.cast("int")), own))
            .when(none, "").otherwise(own)
        )

    return let(code, told)


def _numbered(part: Column) -> Column:
    def told(whole: Column) -> Column:
        inner = F.rtrim(F.substr(whole, F.lit(2)), F.lit(";"))
        hexadecimal = F.lower(F.substring(inner, 1, 1)) == "x"
        digits = F.when(hexadecimal, F.substr(inner, F.lit(2))).otherwise(inner)
        decoded = F.concat(_character(digits, hexadecimal), F.substr(part, F.char_length(whole) + 1))
        return F.when(whole == "", F.concat(F.lit("&"), part)).otherwise(decoded)

    return let(F.regexp_extract(part, _NUMBER_PATTERN, 0), told)


def _unclosed(part: Column) -> Column:
    def told(name: Column) -> Column:
        decoded = F.concat(_named(name), F.substr(part, F.char_length(name) + 1))
        return F.when(name == "", F.concat(F.lit("&"), part)).otherwise(decoded)

    return let(F.regexp_extract(part, _OLD_PATTERN, 0), told)


def _decoded(part: Column) -> Column:
    """What follows an ampersand, with what the ampersand starts decoded."""
    def told(both: Column) -> Column:
        closed = F.concat(both["value"], F.substr(part, F.char_length(both["name"]) + 2))
        return F.when(both["value"].isNotNull(), closed).when(F.startswith(part, F.lit("#")), _numbered(part)).otherwise(_unclosed(part))

    def looked_up(name: Column) -> Column:
        ends = F.char_length(name) < F.char_length(part)
        return F.struct(name.alias("name"), F.when(ends, _named(name)).alias("value"))

    return let(let(F.substring_index(part, ";", 1), looked_up), told)


def _soon_decoded(part: Column) -> Column:
    """As `_decoded`; the frequent names are told by one look-up. They are closed, so the semicolon is looked up with them."""
    end = F.instr(part, ";")
    frequent = F.create_map(*(F.lit(x) for name in _FREQUENT for x in (f"{name};", html5[f"{name};"])))
    value = F.try_element_at(frequent, F.substr(part, F.lit(1), end))
    return F.coalesce(F.concat(value, F.substr(part, end + 1)), _decoded(part))


def unescape(text: Column) -> Column:
    """`text` with named and numeric entities decoded once; null stays null."""
    def joined(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), _soon_decoded), ""))

    return F.when(F.contains(text, F.lit("&")), let(F.split(text, "&", -1), joined)).otherwise(text)
