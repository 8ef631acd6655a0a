import hashlib

import numpy as np
import pytest
from cases import documents, identified, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm import suffixes


def expected(by_id, length):
    seen, out = set(), {}
    for doc, text in sorted(by_id.items()):
        data = (text or "").encode()
        gone = [False] * len(data)
        strings = [data[i : i + length] for i in range(len(data) - length + 1)]
        for i, s in enumerate(strings):
            if s in seen:
                gone[i : i + length] = [True] * length
        seen.update(strings)
        rest = bytes(c for c, g in zip(data, gone) if not g)
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(data), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return out


def result(frame):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()}


def test_matches_brute_force(spark):
    assert result(suffixes.suffix_dedup(documents(spark))) == expected(identified(), 50)


def test_matches_at_other_offsets_and_partial_blocks(spark):
    """Passages of 45 to 120 bytes, cut at any byte and put between other texts."""
    source = prose(40, 400)
    rows = [(0, source, "en", "a")]
    for i in range(60):
        a = 13 * i
        rows.append((1 + i, f"{prose(200 + i, 6)}{source[a : a + 45 + i]}{prose(300 + i, 6)}", "en", "a"))
    want = expected({d: t for d, t, *_ in rows}, 50)
    assert result(suffixes.suffix_dedup(documents(spark, rows))) == want
    assert sum(v[1] > 0 for v in want.values()) > 40


def test_a_repeated_character_and_its_end(spark):
    rows = [(0, "z" * 200, "en", "a"), (1, "q" + "z" * 120 + "r", "en", "a"), (2, "z" * 49, "en", "a"), (3, "z" * 50, "en", "a")]
    assert result(suffixes.suffix_dedup(documents(spark, rows))) == expected({d: t for d, t, *_ in rows}, 50)


def test_remaining_text(spark):
    rows = [(0, prose(1, 50), "en", "a"), (1, "<" + prose(1, 50) + ">", "en", "a")]
    got = {r.doc_id: r.text for r in suffixes.suffix_dedup(documents(spark, rows), with_text=True).collect()}
    assert got == {0: rows[0][1], 1: "<>"}


def test_empty_table(spark):
    assert suffixes.suffix_dedup(documents(spark, [])).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80))
def test_two_stage_order_sorts_suffixes(symbols):
    array = np.array(symbols, np.int16)
    order = suffixes.two_stage_order(array, len(symbols)).tolist()
    assert order == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    prefixes = suffixes.adjacent_prefixes(array, np.array(order), 10).tolist()
    for k in range(1, len(order)):
        a, b = symbols[order[k - 1] :], symbols[order[k] :]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert prefixes[k] == min(same, 10)


@pytest.mark.parametrize("width", [1, 2, 3, 16, 31])
def test_least_of_runs(width):
    values = np.random.default_rng(width).integers(0, 99, 60).astype(np.uint64)
    assert suffixes._least(values, width).tolist() == [int(values[i : i + width].min()) for i in range(60 - width + 1)]
