import random
import re
from collections import Counter

from pyspark.sql import functions as F

from cases import documents, edited, prose, texts

from postmill.llm import decontaminate

ITEMS = [(0, prose(800, 40)), (1, prose(801, 25)), (2, "Just three words"), (3, None), (4, ""), (5, prose(802, 40)), (6, prose(803, 6)), (None, prose(1, 30))]


def bag(words, size):
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def similarity(left, right):
    both = sum((Counter(left) & Counter(right)).values())
    return both / (len(left) + len(right) - both)


def expected(rows):
    out = {}
    for doc, text, *_ in rows:
        for item, body in ITEMS:
            if item is None or doc is None or not words(body):
                continue
            size = min(5, len(words(body)))
            mine, grams = bag(words(body), size), bag(words(text), size)
            windows = [grams[i : i + len(mine)] for i in range(max(len(grams) - len(mine), 0) + 1)] if grams else []
            best = max((similarity(w, mine) for w in windows), default=0)
            if best >= 0.8 - 1e-12:
                out[doc, item] = round(best, 9)
    return out


def benchmark(spark):
    return spark.createDataFrame([(*r, 3, "clash") for r in ITEMS], "item_id long, text string, n int, h string")


def leaking():
    rows = texts()
    for i in range(12):
        body = ITEMS[(0, 1, 5)[i % 3]][1]
        rows.append((200 + i, f"{prose(900 + i, 10 * i)} {edited(body, i, i // 4)} {prose(950 + i, 7)}", "en", "a"))
    rows.append((300, "so: JUST three\nwords, and just three words", "en", "a"))
    rows.append((301, " ".join(ITEMS[0][1].split()[:-4]), "en", "a"))
    rows.append((302, " ".join(ITEMS[0][1].split()[:20]), "en", "a"))
    rows.append((303, f"{ITEMS[0][1]} {prose(5, 10)} {ITEMS[0][1]} {ITEMS[5][1]}", "en", "a"))
    rows.append((304, ITEMS[6][1], "en", "a"))
    return rows


def test_matches_brute_force(spark):
    rows = leaking()
    out = decontaminate.leaks(documents(spark, rows), benchmark(spark)).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in out} == expected(rows)
    assert all(r.hamming <= decontaminate.RADIUS for r in out)


def test_shuffled_sides_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    rows = leaking()
    out = decontaminate.leaks(documents(spark, rows), benchmark(spark)).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in out} == expected(rows)


def test_no_python_in_the_plan(spark):
    plan = decontaminate.clean(documents(spark), benchmark(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_clean_documents_stay_with_all_columns(spark):
    rows = leaking()
    docs = documents(spark, rows)
    kept = decontaminate.clean(docs, benchmark(spark))
    assert kept.columns == docs.columns
    gone = {doc for doc, _ in expected(rows)}
    key = lambda d: (d is None, d or 0)
    assert sorted((r.doc_id for r in kept.collect()), key=key) == sorted((d for d, *_ in rows if d not in gone), key=key)


def test_empty_tables(spark):
    assert decontaminate.leaks(documents(spark, []), benchmark(spark)).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(documents(spark), none).collect() == []
    assert decontaminate.clean(documents(spark), none).count() == len(texts())


#: Shingles of items of which `missed` takes pairs.
LENGTHS = (5, 6, 7, 8, 9, 10, 15, 20, 45, 100)


def missed(spark, pairs):
    """By item length, the pairs of barely enough similarity, windows as long as the item and shorter ones, with fingerprints beyond the radius."""
    pick, rows = random.Random(11), []
    for n in LENGTHS:
        for i in range(pairs):
            item = [pick.getrandbits(64) - (1 << 63) for _ in range(n)]
            shared = -(-8 * n // 9) if i % 2 else -(-4 * n // 5)
            rows.append((n, item, item[:shared] + ([pick.getrandbits(64) - (1 << 63) for _ in range(n - shared)] if i % 2 else [])))
    out = spark.createDataFrame(rows, "n int, item array<long>, window array<long>")
    apart = F.bit_count(decontaminate.fingerprint(F.col("item")).bitwiseXOR(decontaminate.fingerprint(F.col("window"))))
    lost = out.groupBy("n").agg(F.count_if(apart > decontaminate.RADIUS).alias("lost"), F.max(apart).alias("most"))
    return {r.n: (r.lost, r.most) for r in lost.collect()}


def test_fingerprints_find_pairs_of_every_length(spark):
    """At the similarity asked for, at least 99 of 100 pairs lie within the radius, short items too."""
    found = missed(spark, 400)
    assert sorted(found) == sorted(LENGTHS)
    assert all(lost <= 4 for lost, _ in found.values()), found
