"""Language-model scores against a dictionary version."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import documents, prose, texts

from postmill.llm import automaton, exchange

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END, START = object(), object()


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), END]


def sequential(rows):
    def held(doc):
        return doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0

    words, pairs = Counter(), Counter()
    for doc, text, *_ in rows:
        if not held(doc):
            seen = tokens(text)
            words.update([START, *seen])
            pairs.update(zip([START, *seen], seen))
    n, v = sum(words.values()) - words[START], len(set(words) - {START})

    def root(w):
        return (words[w] + 0.1) / (n + 0.1 * (v + 1))

    out = []
    for doc, text, *_ in rows:
        seen = tokens(text)
        score, history = 0.0, START if words[START] else None
        for w in seen:
            if history is not None and pairs[history, w]:
                score += math.log10((pairs[history, w] + automaton.TRUST * root(w)) / (words[history] + automaton.TRUST))
            else:
                score += math.log10(root(w))
                if history is not None:
                    score += math.log10(automaton.TRUST / (words[history] + automaton.TRUST))
            history = w if words[w] else None
        out.append((doc, held(doc), len(seen), sum(words[w] > 0 for w in seen), n, sum(math.log10(root(w)) for w in seen), score))
    return out


def key(row):
    return (row[0] is None, *(c if c is not None else 0 for c in row))


def compare(spark, rows):
    got = sorted((tuple(r) for r in automaton.lm_scores(documents(spark, rows)).collect()), key=key)
    want = sorted(sequential(rows), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_matches_dictionary_version(spark):
    rows = texts() + [(200 + i, prose(i, 30 + i), "en", "a") for i in range(80)]
    rows += [(500, "unheard of words " * 3, "en", "a"), (501, "the end", "en", "a"), (501, "the end", "en", "a")]
    compare(spark, rows)


def test_small_runs_and_lanes(spark, monkeypatch):
    """Runs of a few texts and lanes of a few tokens give the same scores: counts meet and lanes resume."""
    monkeypatch.setattr(automaton, "BUCKET_KEYS", 500)
    rows = [(i, prose(i % 7, 900 + i), "en", "a") for i in range(25)]
    whole = {r.doc_id: r.score for r in automaton.lm_scores(documents(spark, rows)).collect()}
    want = {row[0]: row[6] for row in sequential(rows)}
    assert whole == pytest.approx(want, rel=1e-9)


def test_lanes_do_not_change_weights(monkeypatch):
    rng = np.random.default_rng(5)
    tokens_ = np.sort(rng.integers(1, 1 << 62, 40).astype(np.uint64))
    vocabulary = np.sort(np.concatenate([tokens_, [automaton.END, automaton.START]]))
    counts = np.array([1, 700, 3, 256, 257])
    allowed = np.flatnonzero((vocabulary != automaton.START) & (vocabulary != automaton.END))
    ids = rng.choice(allowed, counts.sum())
    ids[np.cumsum(counts) - 1] = np.searchsorted(vocabulary, automaton.END)
    run = automaton.Run(vocabulary, ids, counts, np.array([False, False, True, True, False]))
    words, pairs = (np.asarray(c, float) for _, c in run.asked)
    machine = automaton.Automaton(run, words, pairs, int(counts[[0, 1, 4]].sum()), int((words > 0).sum()) - 1)
    monkeypatch.setattr(automaton, "LANE", 1 << 20)
    once = machine.traverse(run)
    for lane in (1, 2, 7, 256):
        monkeypatch.setattr(automaton, "LANE", lane)
        assert np.array_equal(machine.traverse(run), once)


def test_chances_of_a_state_add_up_to_one():
    """Arcs and failure arcs of each state, with the unknown token, are a distribution."""
    vocabulary = np.sort(np.array([3, 5, 9, automaton.END, automaton.START], np.uint64))
    ids = np.array([0, 1, 0, 1, 2, int(np.searchsorted(vocabulary, automaton.END))])
    run = automaton.Run(vocabulary, ids, np.array([6]), np.array([False]))
    words, pairs = (np.asarray(c, float) for _, c in run.asked)
    machine = automaton.Automaton(run, words, pairs, 6, 4)
    every = np.array([i for i in range(len(vocabulary)) if i != run.start])
    for state in range(len(vocabulary) + 1):
        if state == 0 or words[state - 1] and state - 1 != run.end:
            spare = machine.failure[state] + math.log10(0.1 / 6.5)
            total = (10 ** machine.step(np.full(len(every), state), every)[0]).sum() + 10**spare
            assert total == pytest.approx(1)


def test_packing_round_trip():
    a, b = np.array([0, 1, 2**63, 2**64 - 1], np.uint64), np.array([5, 0, 1, 7], np.uint64)
    assert [c.tolist() for c in exchange.unpack(exchange.pack(a, b), 2)] == [a.tolist(), b.tolist()]


def test_nothing_to_learn(spark):
    assert automaton.lm_scores(documents(spark, [])).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    assert [tuple(r) for r in automaton.lm_scores(documents(spark, [(held, "some words", "en", "a")])).collect()] == [(held, True, 3, 0, 0, 0.0, 0.0)]
