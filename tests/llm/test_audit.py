"""Filter audit against a sequential version."""

import re
from itertools import permutations

import numpy as np
from cases import documents, prose, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm import audit
from postmill.llm.textkit import Texts


def packed(values):
    raw = [v.encode() for v in values]
    return Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aBé漢 \n\t#|\x00x ", max_size=30) | st.sampled_from(["", "a" * 19 + "b", "a" * 19 + "c " + "a" * 19 + "b"]), min_size=1, max_size=6))
def test_transducer_counts(values):
    got = audit.measure(packed(values))
    assert got["words"].tolist() == [len(words(v)) for v in values]
    assert got["distinct"].tolist() == [len(set(words(v))) for v in values]
    assert got["capitals"].tolist() == [len(re.findall("[A-Z]", v)) for v in values]
    assert got["points"].tolist() == [len(v) for v in values]
    assert got["marks"].tolist() == [len(re.findall(r"[#$%&*|]", v)) for v in values]


def test_table_hits_are_verified(monkeypatch):
    """With equal hashes of all words, bytes still tell them apart."""
    monkeypatch.setattr(audit, "hashes", lambda sums, a, b: np.zeros(len(a), np.uint64))
    values = ["one two three one", "longer-than-eight longer-than-eighT longer-than-eight", ""]
    assert audit.measure(packed(values))["distinct"].tolist() == [3, 2, 0]


def sequential(rows, labels):
    def mark(doc, at):
        return any(row[0] == doc and row[at] == 1 for row in labels if row[0] is not None)

    fails = []
    for doc, text, _, source in rows:
        text = text or ""
        w = words(text)
        same = [d for d, t, *_ in rows if (t or "") == text and d is not None]
        fails.append((source or "", {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": doc is not None and doc > min(same),
        }, mark(doc, 1), mark(doc, 2)))
    out = {}
    for part in {f[0] for f in fails}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if f[1][letter]]
                every = sum(f[1][letter] for f in fails if f[0] == part)
                left = [f for f in left if not f[1][letter]]
                only = sum(f[1][letter] and sum(f[1].values()) == 1 for f in fails if f[0] == part)
                out[part, "".join(order), step] = [len(left), len(gone), every - len(gone), only, sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shapley[letter] += len(gone)
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[letter])
    return out


def test_matches_sequential_version(spark):
    rows = texts() + [(60 + i, prose(i, 260).upper() if i % 3 else prose(i, 260), "en", "z") for i in range(9)]
    rows += [(70, "word # | other " * 80, "en", "z"), (71, prose(0, 260), "en", "q"), (60, prose(0, 260), "en", "z")]
    labels = [(d, d % 2, d % 3 == 0 and 1 or 0) for d in range(0, 75, 2)] + [(None, 1, 1), (4, None, None), (60, 1, None), (999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in audit.audit(documents(spark, rows), table).collect()}
    assert got == sequential(rows, labels)


def test_nothing_to_audit(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(documents(spark, []), empty).collect() == []
    only = audit.audit(documents(spark, [(None, None, None, None), (None, None, None, None)]), empty).where("filter_order = 'ABCDE'").collect()
    assert [(r.part, r.step, r.kept, r.removed, r.redundant) for r in sorted(only, key=lambda r: r.step)] == [("", 1, 0, 2, 0)] + [("", s, 0, 0, 0) for s in (2, 3, 4, 5)]
