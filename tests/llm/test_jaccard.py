import re
from itertools import combinations

import pytest
from cases import documents, identified, prose, edited, texts

from postmill.llm import jaccard
from postmill.llm.components import components
from postmill.llm.scratch import Scratch

FOLD = {c: c + 32 for c in range(65, 91)}


def sets_of(by_id, size):
    out = {}
    for doc, text in by_id.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        grams = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] or ([tuple(words)] if words else [])
        out[doc] = frozenset(grams)
    return out


def expected(by_id, rule):
    sets = sets_of(by_id, rule.size)
    root = {d: d for d in by_id}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(by_id), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if both and rule.below * both >= rule.above * either:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in by_id}


@pytest.mark.parametrize("rule", [jaccard.Rule(4, 85), jaccard.Rule(5, 80)])
def test_components_match_brute_force(spark, rule):
    rows = jaccard.jaccard_components(documents(spark), rule).collect()
    assert len(rows) == len(texts())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    assert got == expected(identified(), rule)
    assert all(r.component_id is None for r in rows if r.doc_id is None)


def test_chains_and_frequent_passages(spark):
    """A chain of edits, and texts that share a passage but little else."""
    chain = [prose(50, 90)]
    for step in range(14):
        chain.append(edited(chain[-1], 600 + step, 1))
    passage = prose(70, 30)
    rows = [(i, t, "en", "a") for i, t in enumerate(chain)]
    rows += [(100 + i, f"{passage} {prose(700 + i, 5 + i)}", "en", "a") for i in range(60)]
    rule = jaccard.Rule(4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, rows), rule).collect()}
    assert got == expected({d: t for d, t, *_ in rows}, rule)


def test_small_cells_give_the_same(spark, monkeypatch):
    """Lists cut into many cells and stars lose no link."""
    monkeypatch.setattr(jaccard, "CELL", 2)
    monkeypatch.setattr(jaccard, "STAR", 2)
    rule = jaccard.Rule(4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark), rule).collect() if r.doc_id is not None}
    assert got == expected(identified(), rule)


def test_empty_table(spark):
    assert jaccard.jaccard_components(documents(spark, [])).collect() == []


def test_one_of_each_keeps_columns_and_unlinked_rows(spark):
    docs = documents(spark)
    kept = jaccard.one_of_each(docs, jaccard.Rule(5, 80))
    assert kept.columns == docs.columns
    want = expected(identified(), jaccard.Rule(5, 80))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(
        d for d, *_ in texts() if d is not None and want[d][1] == d
    )


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    frame = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "u binary, v binary")
    roots = {r.node[0]: r.root[0] for r in components(frame, Scratch(spark, "test")).collect()}
    assert roots == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
