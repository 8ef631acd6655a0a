"""Text features of a job description, as Column expressions.

Every function takes and returns a Column, and runs in the JVM.

Letters, digits and underscore are spelled out as a character class instead of
`\\w`, because Java's `\\w` also covers combining marks and misses some numbers.
After `clean` the only white space left is a single blank.
"""

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions import coerce, entities, vocab
from postmill.functions.binding import let

_WORD = r"[\p{L}\p{N}_]"
_NOT_AFTER_WORD = rf"(?<!{_WORD})"
_NOT_BEFORE_WORD = rf"(?!{_WORD})"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_BLANKS = r"[\s\p{Z}\x1c-\x1f\x85]+"

_FOLD = "(?iu)"
# most places are inside a plain word, which is told without the classes of all letters
# and without ranges, which are looked at one by one
_INSIDE = f"(?<![{string.ascii_letters}{string.digits}_])"
_MARKUP = r"[<&\u200b](?:(?<=<)[^>]+>|(?<=&)[a-z]+;|(?<=\u200b))"
# runs of white space other than a single blank, which would be replaced by itself
_UNEVEN_BLANKS = rf"(?![!-~])(?: {_BLANKS}|{_BLANKS[:-2]}&&[^ ]]{_BLANKS[:-1]}*)"


def _any_of(alternatives) -> str:
    return "(?:" + "|".join(alternatives) + ")"


def _head(alternative: str) -> str:
    return alternative[:2] if alternative.startswith("\\") else alternative[0]


def _by_first_letter(alternatives) -> str:
    """Alternation grouped by first letter.

    Two alternatives can only compete at one position when they start with the
    same letter, so grouping keeps the order that decides a match while most
    positions are rejected after looking at a single letter per group.
    """
    groups = {}
    for alternative in alternatives:
        head = _head(alternative)
        groups.setdefault(head.lower(), []).append(alternative[len(head):])
    return _any_of(head + _any_of(rest) for head, rest in groups.items())


def _opening(heads) -> str:
    """Look-ahead for the first letter in either case, tried before anything costlier.

    The long s and the Kelvin sign fold to s and k, so they are let through.
    """
    letters = dict.fromkeys(c for h in heads for c in (h.upper(), h.lower()))
    return f"(?=[{''.join(letters)}ſK])"


def _letter(head: str) -> str:
    """A first letter in either case; the signs that fold to s and k count as those."""
    return head if head.startswith("\\") else "[" + head.upper() + head.lower() + {"S": "ſ", "K": "K"}.get(head.upper(), "") + "]"


def _by_ranges(alternatives, ranges: int = 4) -> str:
    """Alternation by first letter as `_by_first_letter`, with the letters in ranges that are told by one look-ahead each."""
    groups = {}
    for alternative in alternatives:
        head = _head(alternative)
        groups.setdefault(head.lower(), []).append(alternative[len(head):])
    heads = sorted(groups)
    size = -(-len(heads) // ranges)
    out = []
    for at in range(0, len(heads), size):
        part = heads[at : at + size]
        letters = "".join(_letter(head).strip("[]") for head in part)
        out.append(f"(?=[{letters}])" + _any_of(f"{_letter(head)}{_FOLD[:-1]}:{'|'.join(groups[head])})" for head in part))
    return _any_of(out)


def _words(alternatives, ending=_NOT_BEFORE_WORD) -> str:
    """Any of the alternatives (group 1) as a whole word, in any case. Letters inside a word are passed over first."""
    opening = _opening(_head(a) for a in alternatives)
    return f"{_INSIDE}{opening}{_NOT_AFTER_WORD}({_by_ranges(alternatives)}){ending}"


TECHNOLOGY_PATTERN = _words(vocab.TECHNOLOGIES)
SOFT_PATTERN = _words(vocab.SOFT_SKILLS)
# an abbreviation may end in a dot, so its right edge can lie before a letter
SENIORITY_PATTERN = _words(vocab.SENIORITY, _EDGE)
STACK_PATTERN = _words(vocab.STACK_MENTIONS)
# what may stand before the number has no part in it
EXPERIENCE_PATTERN = rf"(?=\d){_FOLD}" + vocab.EXPERIENCE.removeprefix(r"(?:M[íi]nimo\s+de\s+)?")
SALARY_PATTERN = r"(?=[Rr][$Ee]|[Ssſ][Aa]|[Bb][Oo])" + _FOLD + vocab.SALARY
# opened by plain letters, which are searched for without trying every place; the mention itself is group 1
CONTRACT_PATTERN = vocab.CONTRACT.replace("[Cc]ontrata", "ontrata(?<=[Cc]ontrata)", 1)


# --- cleaning ----------------------------------------------------------------

def unescape_html(raw: Column) -> Column:
    """Decode named and numeric HTML entities; NULL becomes ''."""
    return F.coalesce(entities.unescape(raw), F.lit(""))


def strip_markup(text: Column) -> Column:
    """Tags, left-over entities and zero-width blanks out; white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, _MARKUP, " "), _UNEVEN_BLANKS, " "))


def clean(raw: Column) -> Column:
    return strip_markup(unescape_html(raw))


def prefix(text: Column, size: int = 1500) -> Column:
    return F.substring(text, 1, size)


# --- sections ----------------------------------------------------------------

def section(text: Column, header, stops) -> Column:
    """Text after the first header, up to the first stop header or the end; '' if none."""
    pattern = rf"(?isu){_at_header(header)}(.*?)(?:{_at_header(stops)}|$)"
    return F.trim(F.regexp_extract(text, pattern, 1))


def _at_header(headers) -> str:
    """Any of the headers in any case, tried where its first letter stands; the i without and with a dot fold to i."""
    letters = "".join(dict.fromkeys(c for h in headers for c in (h[0].upper(), h[0].lower())))
    return f"(?:(?=[{letters}ſıİ])(?iu:{_by_first_letter(headers)}))"


def nice_section(text: Column) -> Column:
    return section(text, vocab.NICE_HEADERS, vocab.SOFT_HEADERS + vocab.ADDITIONAL_HEADERS)


def soft_section(text: Column) -> Column:
    return section(text, vocab.SOFT_HEADERS, vocab.NICE_HEADERS + vocab.ADDITIONAL_HEADERS)


def without_section(text: Column, part: Column) -> Column:
    """The text with every occurrence of the section removed."""
    return F.replace(text, part, F.lit(""))


# --- technologies ------------------------------------------------------------

def technologies(text: Column) -> Column:
    """All vocabulary hits in order, spelled as in the text."""
    return F.regexp_extract_all(text, F.lit(TECHNOLOGY_PATTERN), F.lit(1))


def _lookup(entries: dict, key: Column) -> Column:
    """The value of a key, or NULL. A map is searched from its start, so the entries are dealt by first letter."""
    groups = {}
    for spelled, value in entries.items():
        groups.setdefault(ord(spelled[0]), []).append(f"'{spelled}', '{value}'")
    first = min(groups)
    # one parsed literal instead of a Python call per entry
    maps = ", ".join(f"map({', '.join(groups[code])})" if code in groups else "null" for code in range(first, max(groups) + 1))
    return F.try_element_at(F.get(F.expr(f"array({maps})"), F.ascii(key) - first), key)


def _key(name: Column) -> Column:
    return F.lower(F.trim(name))


def canonical(name: Column) -> Column:
    return F.coalesce(_lookup(vocab.ALIASES, _key(name)), _key(name))


#: Labels by spelling: those of the canonical names, and of the aliases of those.
_LABEL_OF = {
    key: vocab.LABELS[vocab.ALIASES.get(key, key)]
    for key in (*vocab.LABELS, *vocab.ALIASES) if vocab.ALIASES.get(key, key) in vocab.LABELS
}


def label_of(name: str) -> str:
    """The label of one fixed name, as `label` gives it."""
    return _LABEL_OF.get(name.strip().lower()) or (name.upper() if len(name) <= 2 else name.strip())


def label(name: Column) -> Column:
    """Display label; unlisted names keep their spelling, two letters at most go upper."""
    return F.coalesce(
        _lookup(_LABEL_OF, _key(name)),
        F.when(F.length(name) <= 2, F.upper(name)).otherwise(F.trim(name)),
    )


def canonical_names(names: Column) -> Column:
    return F.transform(names, canonical)


def one_per_canonical(names: Column) -> Column:
    """One spelling per canonical name: the longest, then the smallest."""
    ranked = F.sort_array(
        F.transform(F.array_distinct(names), lambda s: F.struct((-F.length(s)).alias("len"), s.alias("name")))
    )
    return coerce.first_per_key(F.transform(ranked, lambda r: r["name"]), canonical)


def labels_of(names: Column) -> Column:
    return F.sort_array(F.transform(names, label))


def nice_without_hard(nice: Column, hard: Column) -> Column:
    """Nice-to-have names whose canonical name is not already a hard skill."""
    return let(
        canonical_names(hard),
        lambda taken: F.filter(nice, lambda s: ~F.array_contains(taken, canonical(s))),
    )


def skill_names(names: Column) -> Column:
    """Stored skill names: label, cut to 120 characters, first spelling kept."""
    cut = F.transform(names, lambda s: F.substring(label(s), 1, 120))
    return F.coalesce(coerce.distinct_ignoring_case(cut), F.array().cast("array<string>"))


# --- other features ----------------------------------------------------------

def soft_skills(text: Column) -> Column:
    source = F.concat(soft_section(text), F.lit(" "), text)
    hits = F.regexp_extract_all(source, F.lit(SOFT_PATTERN), F.lit(1))
    return F.sort_array(F.array_distinct(F.transform(hits, F.lower)))


def years_experience(text: Column) -> Column:
    """Minimum years of the first plausible mention (its maximum when the minimum is 0)."""
    limit = vocab.EXPERIENCE_LIMIT
    mentions = F.transform(
        F.regexp_extract_all(text, F.lit(EXPERIENCE_PATTERN), F.lit(0)),
        lambda m: F.struct(
            F.regexp_extract(m, EXPERIENCE_PATTERN, 1).alias("low"),
            F.regexp_extract(m, EXPERIENCE_PATTERN, 2).alias("high"),
        ),
    )
    plausible = F.filter(
        mentions,
        lambda m: (m["low"].try_cast("int") <= limit)
        & ((m["high"] == "") | (m["high"].try_cast("int") <= limit)),
    )
    years = F.transform(
        plausible,
        lambda m: F.coalesce(
            F.nullif(m["low"].try_cast("int"), F.lit(0)),
            F.nullif(m["high"].try_cast("int"), F.lit(0)),
        ),
    )
    return F.get(years, F.lit(0))


def salary_mentions(text: Column) -> Column:
    """All salary mentions, or NULL."""
    hits = F.regexp_extract_all(text, F.lit(SALARY_PATTERN), F.lit(0))
    return let(hits, lambda found: F.when(F.size(found) > 0, found))


def contract_mentions(text: Column) -> Column:
    hits = F.regexp_extract_all(text, F.lit(CONTRACT_PATTERN), F.lit(1))
    default = F.array(F.lit(vocab.DEFAULT_CONTRACT))
    return let(F.transform(hits, F.trim), lambda found: F.when(F.size(found) > 0, found).otherwise(default))


def seniority(text: Column) -> Column:
    """First seniority word with abbreviations spelled out, or NULL."""
    hit = F.lower(F.regexp_extract(text, SENIORITY_PATTERN, 1))
    return F.coalesce(
        _lookup(vocab.SENIORITY_LABELS, hit),
        F.initcap(coerce.blank_to_null(hit)),
    )
