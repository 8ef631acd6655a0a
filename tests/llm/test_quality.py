import re
from collections import Counter

import pytest
from cases import documents, prose, texts

from postmill.llm import quality


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, repeated = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            repeated |= set(range(i, i + 8))
    lines, earlier, later = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            later += line in earlier
            earlier.add(line)
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), later, len(repeated),
        n < 20 or 100 * len(repeated) > 30 * n,
    )


def labelled(spark, good=60, bad=25):
    rows = [(1000 + i, prose(1000 + i, 60), "en", "a") for i in range(good)]
    rows += [(2000 + i, " ".join(w + "###" for w in prose(2000 + i, 60).split()), "en", "a") for i in range(bad)]
    labels = [(d, int(d < 2000), 0) for d, *_ in rows] + [(1000, 1, 0), (None, 1, 0), (5000, 0, 0), (1001, None, 0)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model(spark):
    return quality.train(*labelled(spark))


def test_counts_match_brute_force(spark, model):
    extra = [(80, "a b c d e f g h\n" * 6 + "tail | <x> $5", "en", "a"), (81, "x y\nx y\n \n \nx  y", "en", "a")]
    rows = texts() + extra
    out = quality.judge(documents(spark, rows), model, keep=("doc_id", "text")).collect()
    assert len(out) == len(rows)
    for r in out:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == counts(r.text)
        assert not (r.base_failed and r.kept)


def test_unseen_rows_are_told_apart(spark, model):
    rows = [(i, prose(5000 + i, 80), "en", "a") for i in range(30)]
    rows += [(100 + i, " ".join(w + "###" for w in prose(6000 + i, 80).split()), "en", "a") for i in range(30)]
    got = {r.doc_id: r.kept for r in quality.judge(documents(spark, rows), model).collect()}
    assert sum(got[i] for i in range(30)) >= 29
    assert sum(got[100 + i] for i in range(30)) <= 1


def test_no_labels_keep_what_passes_the_rules(spark):
    docs = documents(spark, [(1, prose(1, 50), "en", "a"), (2, "short", "en", "a")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.kept for r in quality.quality_rules(docs, none).collect()} == {1: True, 2: False}


def test_empty_table(spark, model):
    assert quality.judge(documents(spark, []), model).collect() == []


def test_all_columns_can_be_kept(spark, model):
    docs = documents(spark).drop("kept")
    out = quality.judge(docs, model, keep=tuple(docs.columns))
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == len(texts())
