"""Secrets in text: known shapes, and literals bound to sensitive names.

A lexer reads name-literal pairs of source and configuration syntax; constants are
carried from name to name, and each literal is scored by the names that it ends
up in, those of the maps around it included.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from postmill.llm.lexer import bindings
from postmill.llm.textkit import runs

KINDS = ("assign", "access", "hex")
#: Literals that the lexer adds.
ADDED = "literal"
#: A literal is reported from this score on.
REPORT_FROM = 0.6
#: Share of the weight of the names of the maps around a literal that it takes on.
INHERITED = 0.75
#: Words longer than this are literals, not names of constants.
LONGEST_NAME = 256

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: How far a part of a name speaks for a secret.
WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "pass": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "key": 0.5, "private": 0.5, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.8, "access": 0.4, "bearer": 0.9,
    "signature": 0.5, "salt": 0.6, "cert": 0.4, "api": 0.4,
}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Known shapes as (start, kind, end), in order of start and kind; failing matches are dropped, not retried.

    The patterns of access keys and hex runs ask for the least length at once:
    their matches are maximal runs, so that nothing else is found or lost.
    """
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def name_weight(name: str) -> float:
    """How sensitive a name is: the heaviest of its parts, with a little for each other one."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)
    weights = sorted((WEIGHTS.get(part.lower(), 0.0) for part in [*parts, "".join(parts)]), reverse=True)
    return min(1.0, weights[0] + 0.5 * sum(weights[1:])) if weights else 0.0


def strength(value: str) -> float:
    """0 to 1: bits of surprise of the value's characters, against 40."""
    if len(value) < 6 or len(set(value)) < 3:
        return 0.0
    n = len(value)
    bits = -sum(c * math.log2(c / n) for c in Counter(value).values())
    return min(1.0, bits / 40)


def literal_spans(text: str, known: list[tuple[int, int, int]], threshold: float = REPORT_FROM) -> list[tuple[int, int, int]]:
    """Literals that reach a sensitive name, outside the known spans.

    A bare name that was bound before stands for its literals; so a constant
    keeps the weight of the heaviest name it is ever assigned to.
    """
    if ":" not in text and "=" not in text:
        return []
    # each value as its weight, the literals in it and the earlier values that it takes over by name
    values: list[tuple[float, list[tuple[int, int]], list[int]]] = []
    current: dict[str, int] = {}
    for name, around, pieces in bindings(text, name_weight):
        literals, taken = [], []
        for literal, start, end in pieces:
            earlier = current.get(text[start:end]) if end - start <= LONGEST_NAME else None
            if earlier is not None:
                taken.append(earlier)
            elif literal:
                literals.append((start, end))
        current[name] = len(values)
        values.append((min(1.0, name_weight(name) + INHERITED * around), literals, taken))
    weight: dict[tuple[int, int], float] = {}
    reached = [heavy for heavy, _, _ in values]
    for at in range(len(values) - 1, -1, -1):
        _, literals, taken = values[at]
        for earlier in taken:
            reached[earlier] = max(reached[earlier], reached[at])
        for literal in literals:
            weight[literal] = max(weight.get(literal, 0.0), reached[at])
    starts = [start for start, _, _ in known]
    reach = list(accumulate((end for _, _, end in known), max))
    found = []
    for (start, end), heavy in weight.items():
        before = bisect_left(starts, end)
        if heavy and heavy * strength(text[start:end]) >= threshold and not (before and reach[before - 1] > start):
            found.append((start, len(KINDS), end))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, ADDED)
    return ",".join(f"{names[kind]}:{start}:{end}" for start, kind, end in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """Secrets of every row: counts and digest of the known shapes, and all spans.

    Offsets are code points of the whole text, ends exclusive. A null text is
    empty and has no span; rows of equal text have equal spans.
    """

    def scan(batches):
        for batch, _ in runs(batches, "text"):
            texts = [text or "" for text in batch.column(1).to_pylist()]
            known = [base_spans(text) for text in texts]
            every = [sorted(spans + literal_spans(text, spans)) for text, spans in zip(texts, known)]
            counts = [pa.array([sum(k == kind for _, k, _ in spans) for spans in known], pa.int64()) for kind in range(len(KINDS))]
            digests = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in known]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests), pa.array([joined(spans) for spans in every])],
                names=["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"],
            )

    fields = ", ".join(f"n_{kind} long" for kind in KINDS)
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id long, {fields}, base_sha256 string, spans string")
