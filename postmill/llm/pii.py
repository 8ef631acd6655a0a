"""Personal data: validated patterns, and candidates chosen by boosted trees.

High-recall generators propose overlapping spans; trees over their format and
context, fitted on the validated spans of a bounded sample, choose which are
redacted besides the validated ones.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.boosting import Boosted, boost
from postmill.llm.textkit import runs

KINDS = ("email", "ip", "card", "phone")
#: Spans that the trees add.
ADDED = "candidate"
#: Texts and candidates that the trees are fitted on, at most.
FIT_TEXTS, FIT_CANDIDATES = 1500, 8000
#: A candidate is redacted from this probability on.
REDACT_FROM = 0.8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SPELLED = _LOCAL - {"%", "+"}
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBERS = re.compile(r"[+(]?[0-9][0-9 ().-]{5,}[0-9]")
_SOLID = re.compile(r"\S+")
_AT = re.compile(r"\(at\)|\[at\]")
_SPELLED_START = re.compile(r"\b[A-Za-z0-9._-]")
_SPELLED_HOST = re.compile(r" ?[A-Za-z0-9.-]+\b")
_CONTEXT = re.compile(r"phone|call|tel|mobile|fax|mail|contact|card|iban|account|ssn|address|\bip\b", re.I)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, @ and a dotted host, found from each @ backwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _HOST.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Validated spans as (kind, start, end), by kind and start; failing matches are dropped, not retried.

    `_CARD` asks for 16 digits at once: matches are maximal chains of digits, so
    chains that the shorter pattern would find and the digit count drop are the same.
    """
    spans = [(0, *span) for span in _emails(text)]
    for found in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found[0].split(".")):
            spans.append((1, *found.span()))
    for found in _CARD.finditer(text):
        digits = _digits(found[0])
        if len(digits) <= 19 and luhn(digits):
            spans.append((2, *found.span()))
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 8 <= len(_digits(found[0])) <= 15:
                spans.append((3, *found.span()))
    return spans


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Runs of other characters than blanks and @ on both sides of an @, from left to right without overlaps."""
    for solid in _SOLID.finditer(text):
        start, end = solid.span()
        at = text.find("@", start, end)
        while at >= 0:
            following = text.find("@", at + 1, end)
            stop = end if following < 0 else following
            if at > start and stop > at + 1:
                yield start, stop
                start = stop
            else:
                start = at + 1
            at = following


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a written (at) or [at], found from that mark outwards, without overlaps."""
    done = 0
    for mark in _AT.finditer(text):
        end = mark.start() - (text[mark.start() - 1 : mark.start()] == " ")
        start = end
        while start > done and text[start - 1] in _SPELLED:
            start -= 1
        first = _SPELLED_START.search(text, start, end) if start < end else None
        host = _SPELLED_HOST.match(text, mark.end()) if first else None
        if host:
            yield first.start(), host.end()
            done = host.end()


def candidates(text: str) -> list[tuple[int, int]]:
    """Overlapping spans that may be personal data."""
    spans = {found.span() for found in _NUMBERS.finditer(text)}
    if "@" in text:
        spans.update(_addresses(text))
    if "at)" in text or "at]" in text:
        spans.update(_spelled(text))
    return sorted(spans)


def describe(text: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span = text[start:end]
    digits = _digits(span)
    before, after = text[max(0, start - 24) : start], text[end : end + 8]
    groups = [g for g in re.split(r"[^0-9]+", span) if g]
    return [
        len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        span.count("."), span.count("-"), span.count(" "), span.count("("), float(span.startswith("+")),
        span.count("@"), sum(c.isalpha() for c in span), len(set(digits)), float(bool(_CONTEXT.search(before))),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(after[:1] in ("%", "€", "$")),
        max((int(g) for g in groups if len(g) <= 6), default=0),
    ]


class _Covered:
    """Spans that others can be held against; each question takes logarithmic time."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, span: tuple[int, int]) -> bool:
        before = bisect_left(self.starts, span[1])
        return before > 0 and self.ends[before - 1] > span[0]

    def add(self, span: tuple[int, int]) -> None:
        """Add a span that overlaps none."""
        place = bisect_left(self.starts, span[0])
        self.starts.insert(place, span[0])
        self.ends.insert(place, span[1])


def _covered(known: list[tuple[int, int, int]]) -> _Covered:
    return _Covered((start, end) for _, start, end in known)


def train(docs: DataFrame, fit_texts: int = FIT_TEXTS, fit_candidates: int = FIT_CANDIDATES) -> Boosted:
    """Fit on at most `fit_candidates` candidates of at most `fit_texts` different texts, chosen by hash.

    Those that hold a part of a validated span are the positive ones.
    """
    usable = docs.where("text rlike '[0-9@]'").select("doc_id", "text", F.xxhash64("text").alias("__order"))
    bound = usable.groupBy("__order").agg(F.min("doc_id").alias("doc_id")).orderBy("__order").limit(fit_texts)
    sample = usable.join(F.broadcast(bound), ["__order", "doc_id"]).select("text")

    def rows(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                known = _covered(base_spans(text))
                lines = [describe(text, *span) + [float(known.overlaps(span))] for span in candidates(text)]
                for at in range(0, len(lines), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(lines[at : at + 4096], pa.list_(pa.float64()))], names=["line"])

    lines = sample.mapInArrow(rows, "line array<double>").orderBy(F.xxhash64("line"), "line").limit(fit_candidates)
    lines = sorted(lines.toArrow().column(0).to_pylist())
    if not lines:
        return Boosted(start=-30.0)
    table = np.array(lines)
    table = table[np.random.Generator(np.random.PCG64(5)).permutation(len(table))]
    return boost(table[:, :-1], table[:, -1] > 0)


def find(texts: list[str], model: Boosted, threshold: float = REDACT_FROM):
    """Validated spans and chosen candidates of each text."""
    known = [base_spans(text) for text in texts]
    covered = [_covered(spans) for spans in known]
    proposed = [(row, span) for row, text in enumerate(texts) for span in candidates(text) if not covered[row].overlaps(span)]
    chosen: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if proposed:
        taken = [_Covered() for _ in texts]
        chance = model.probability(np.array([describe(texts[row], *span) for row, span in proposed]))
        for at in np.lexsort((np.arange(len(proposed)), -chance)):
            row, span = proposed[at]
            if chance[at] >= threshold and not taken[row].overlaps(span):
                taken[row].add(span)
                chosen[row].append((len(KINDS), *span))
    return known, [sorted(spans) for spans in chosen]


def joined(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, ADDED)
    return ",".join(f"{names[kind]}:{start}:{end}" for kind, start, end in spans)


def pii_spans(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """Spans of personal data of every row: counts, digest of the validated ones, and all.

    Offsets are code points of the whole text, ends exclusive. A null text is
    empty and has no span; equal texts have equal spans.
    """
    model = model or train(docs)

    def scan(batches):
        for batch, _ in runs(batches, "text"):
            known, chosen = find([text or "" for text in batch.column(1).to_pylist()], model)
            counts = [pa.array([sum(k == kind for k, _, _ in spans) for spans in known], pa.int64()) for kind in range(len(KINDS))]
            digests = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in known]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests), pa.array([joined(a + b) for a, b in zip(known, chosen)])],
                names=["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"],
            )

    fields = ", ".join(f"n_{kind} long" for kind in KINDS)
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id long, {fields}, base_sha256 string, spans string")


def redact(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """`docs` rows (doc_id, text) with every found span replaced by its kind in brackets; overlapping spans merge."""
    model = model or train(docs)
    names = (*KINDS, ADDED)

    def blank(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, done = [], 0
        for kind, start, end in sorted(spans, key=lambda s: (s[1], s[0])):
            if start >= done:
                out += [text[done:start], f"[{names[kind]}]"]
            done = max(done, end)
        return "".join([*out, text[done:]])

    def apply(batches):
        for batch, _ in runs(batches, "text"):
            texts = batch.column(1).to_pylist()
            known, chosen = find([text or "" for text in texts], model)
            out = [None if t is None else blank(t, a + b) for t, a, b in zip(texts, known, chosen)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, text string")
