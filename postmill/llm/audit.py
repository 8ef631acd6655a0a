"""Audit of how quality filters interact: what each removes in every order of application.

A byte transducer reads each text once: a table gives the outputs of every state
and class of byte, from which words, capitals, code points and symbols are
counted, while the spans of words enter a hash table whose hits are verified
byte by byte. Documents then count by the set of filters that they fail.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.textkit import Texts, hashes, mix, runs

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Distinct words and capitals, in percent of words and of code points.
MIN_DISTINCT, MAX_CAPITALS = 50, 2
ORDERS = tuple("".join(order) for order in permutations(FILTERS))

# Classes of bytes; END stands behind each text.
BLANK, UPPER, SYMBOL, OTHER, TRAIL, END = range(6)
CLASSES = 6
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = BLANK
CLASS[65:91] = UPPER
CLASS[list(b"#$%&*|")] = SYMBOL
CLASS[0x80:0xC0] = TRAIL
# States: between words, within one. Outputs are sets of bits.
BETWEEN, WITHIN = range(2)
POINT, CAPITAL, MARK, OPENS, CLOSES = 1, 2, 4, 8, 16
#: The state that a class of byte leads to, from either state.
FOLLOWING = np.array([BETWEEN, WITHIN, WITHIN, WITHIN, WITHIN, BETWEEN], np.uint8)
OUTPUT = np.zeros((2, CLASSES), np.uint8)
OUTPUT[:, BLANK:TRAIL] |= POINT
OUTPUT[:, UPPER] |= CAPITAL
OUTPUT[:, SYMBOL] |= MARK
OUTPUT[BETWEEN, [UPPER, SYMBOL, OTHER, TRAIL]] |= OPENS
OUTPUT[WITHIN, [BLANK, END]] |= CLOSES


def transduce(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of the transducer for each byte and each end of a text, and where the texts start in them."""
    count = len(texts)
    begins = texts.offsets + np.arange(count + 1)
    symbols = np.empty(len(texts.data) + count, np.uint8)
    inner = np.ones(len(symbols), bool)
    inner[begins[1:] - 1] = False
    symbols[inner] = CLASS[texts.data]
    symbols[~inner] = END
    states = np.empty(len(symbols), np.uint8)
    states[:1] = BETWEEN
    states[1:] = FOLLOWING[symbols[:-1]]
    return OUTPUT.ravel()[states * np.uint8(CLASSES) + symbols], begins


def _same_bytes(data: np.ndarray, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans of `length` bytes at `left` and `right` are equal, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    same, open_ = np.ones(len(left), bool), np.arange(len(left))
    at = 0
    while len(open_):
        rest = np.minimum(length[open_] - at, 8)
        differ = (eight[left[open_] + at] ^ eight[right[open_] + at]) << ((8 - rest) * 8).astype(np.uint64)
        same[open_[differ != 0]] = False
        open_ = open_[(differ == 0) & (length[open_] - at > 8)]
        at += 8
    return same


def distinct_words(texts: Texts, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Different words of each text: spans are inserted into one open-addressed table, and hits are verified.

    All words try their place at once; those that meet another word go to the next place.
    """
    keys = mix(hashes(texts.sums(), starts, ends) ^ mix(owner.astype(np.uint64)))
    size = 1 << max(2 * len(starts), 2).bit_length()
    table = np.full(size, -1, np.int64)
    place = (keys & np.uint64(size - 1)).astype(np.int64)
    counts = np.zeros(len(texts), np.int64)
    waiting = np.arange(len(starts))
    while len(waiting):
        at = place[waiting]
        free = table[at] < 0
        table[at[free]] = waiting[free]
        holder = table[at]
        own = holder == waiting
        counts += np.bincount(owner[waiting[own]], minlength=len(texts))
        waiting, holder = waiting[~own], holder[~own]
        length = ends[waiting] - starts[waiting]
        alike = (keys[waiting] == keys[holder]) & (owner[waiting] == owner[holder]) & (length == ends[holder] - starts[holder])
        alike[alike] = _same_bytes(texts.data, starts[waiting[alike]], starts[holder[alike]], length[alike])
        waiting = waiting[~alike]
        place[waiting] = (place[waiting] + 1) & (size - 1)
    return counts


def measure(texts: Texts) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each text."""
    outputs, begins = transduce(texts)

    def total(bit: int) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum((outputs & bit) > 0)])[begins])

    opened, closed = np.flatnonzero(outputs & OPENS), np.flatnonzero(outputs & CLOSES)
    owner = np.searchsorted(begins, opened, "right") - 1
    return {
        "words": np.bincount(owner, minlength=len(texts)),
        "distinct": distinct_words(texts, opened - owner, closed - owner, owner),
        "capitals": total(CAPITAL), "points": total(POINT), "marks": total(MARK),
    }


def failures(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Set of the filters A to D that each text fails, as bits in their order."""
    return (
        (counts["words"] < MIN_WORDS)
        + 2 * (100 * counts["distinct"] < MIN_DISTINCT * counts["words"])
        + 4 * (100 * counts["capitals"] > MAX_CAPITALS * counts["points"])
        + 8 * (counts["marks"] > 0)
    )


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, part, failed (bits of A to D) and digest of every document."""

    def scan(batches):
        for batch, texts in runs(batches, "text"):
            failed = failures(measure(texts))
            body = texts.data.tobytes()
            digests = [hashlib.sha256(body[a:b]).digest() for a, b in zip(texts.offsets[:-1], texts.offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(failed.astype(np.int32)), pa.array(digests, pa.binary())],
                names=["doc_id", "part", "failed", "digest"],
            )

    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(scan, "doc_id long, part string, failed int, digest binary")


def failure_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (bits of A to E), good, toxic and the number of such documents.

    Rows are added up before each shuffle, so copies of one text, one part or
    rows of one id travel as a few rows of each task.
    """
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    ).withColumn("salt", F.lit(0))
    # Rows without an id meet no label; the salt keeps them from meeting in one task.
    salt = F.when(F.col("doc_id").isNull(), F.hash("digest")).otherwise(F.lit(0)).alias("salt")
    rows = facts(docs).select("*", salt).groupBy("doc_id", "salt", "part", "failed", "digest").agg(F.count("*").alias("n"))
    marked = rows.join(marks, ["doc_id", "salt"], "left").select(
        "doc_id", "part", "failed", "digest", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )
    named = F.col("doc_id").isNotNull()
    kinds = marked.groupBy("digest", "part", "failed", "good", "toxic").agg(
        F.min("doc_id").alias("least"), F.min_by(F.when(named, F.col("n")), F.when(named, F.col("doc_id"))).alias("n_least"),
        F.sum("n").alias("n"), F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("n_unnamed"),
    )
    # A text has at most one row here for each part and label, however many copies it has.
    first = F.min("least").over(Window.partitionBy("digest"))
    passed = F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0) + F.col("n_unnamed")
    split = kinds.withColumn("first", first).select("part", "failed", "good", "toxic", "n", passed.alias("passed"))
    either = F.explode(F.array(
        F.struct(F.col("failed").alias("failed"), F.col("passed").alias("n")),
        F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("passed")).alias("n")),
    )).alias("kind")
    return split.select("part", "good", "toxic", either).where("kind.n > 0").groupBy(
        "part", F.col("kind.failed").alias("failed"), "good", "toxic"
    ).agg(F.sum("kind.n").alias("n"))


def _steps() -> dict[str, np.ndarray]:
    """For each order and step, which sets of failed filters it keeps, removes, and so on: rows of 32 flags."""
    sets = np.arange(32)
    out: dict[str, list[np.ndarray]] = {"kept": [], "removed": [], "redundant": [], "unique_fails": []}
    for order in ORDERS:
        before = 0
        for letter in order:
            bit = 1 << FILTERS.index(letter)
            fails, gone = (sets & bit) > 0, (sets & before) > 0
            out["kept"].append(~fails & ~gone)
            out["removed"].append(fails & ~gone)
            out["redundant"].append(fails & gone)
            out["unique_fails"].append(sets == bit)
            before |= bit
    return {name: np.array(rows, np.int64) for name, rows in out.items()}


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step, with counts of the part's documents.

    A part is a value of source, '' where it is null. Null and empty texts are
    equal: they fail A, and E where a smaller id has such a text too. Rows without
    an id fail E never and make none fail it. Repeated rows count each. A document
    is good or toxic if any of its labels says so; null labels say nothing. No
    documents, no rows.
    """
    cube = failure_sets(docs, labels).groupBy("part").agg(F.collect_list(F.struct("failed", "good", "toxic", "n")).alias("cells"))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def unfold(batches):
        steps = _steps()
        orders = pa.array([order for order in ORDERS for _ in FILTERS])
        step = pa.array(np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS)))
        letter = np.array([FILTERS.index(c) for order in ORDERS for c in order])
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                every, good, toxic = np.zeros((3, 32), np.int64)
                for cell in cells:
                    every[cell["failed"]] += cell["n"]
                    good[cell["failed"]] += cell["n"] * cell["good"]
                    toxic[cell["failed"]] += cell["n"] * cell["toxic"]
                columns = {name: flags @ every for name, flags in steps.items()}
                columns["good_lost"], columns["toxic_lost"] = steps["removed"] @ good, steps["removed"] @ toxic
                shares = np.zeros(len(FILTERS), np.int64)
                np.add.at(shares, letter, columns["removed"])
                columns["shapley"] = shares[letter]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(orders)), orders, step, *(pa.array(columns[name]) for name in names)],
                    names=["part", "filter_order", "step", *names],
                )

    fields = ", ".join(f"{name} long" for name in names)
    return cube.mapInArrow(unfold, f"part string, filter_order string, step int, {fields}")


AUDIT_SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), marks AS (
    SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good,
           coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS bad
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), firsts AS (
    SELECT body, min(doc_id) AS least FROM words GROUP BY body
), judged AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
           (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END)
           + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
           + (CASE WHEN 100 * length(regexp_replace(words.body, '[^A-Z]', '', 'g')) > 2 * length(words.body) THEN 4 ELSE 0 END)
           + (CASE WHEN regexp_matches(words.body, '[#$%&*|]') THEN 8 ELSE 0 END)
           + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS failed
    FROM words JOIN firsts ON words.body = firsts.body LEFT JOIN marks USING (doc_id)
), cube AS (
    SELECT part, failed, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM judged GROUP BY part, failed
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
    FROM letters a JOIN letters b ON b.bit <> a.bit JOIN letters c ON c.bit NOT IN (a.bit, b.bit)
    JOIN letters d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN letters e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)
), steps AS (
    SELECT filter_order, step, bit,
           (SELECT coalesce(sum(x.bit), 0) FROM letters x WHERE position(x.letter IN filter_order) < step) AS gone
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s JOIN letters ON letter = substr(filter_order, step, 1)
), counted AS (
    SELECT part, filter_order, step, bit,
           sum(CASE WHEN failed & (bit + gone)::BIGINT = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN failed & bit <> 0 AND failed & gone::BIGINT = 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN failed & bit <> 0 AND failed & gone::BIGINT <> 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN failed & bit <> 0 AND failed & gone::BIGINT = 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN failed & bit <> 0 AND failed & gone::BIGINT = 0 THEN bad ELSE 0 END) AS toxic_lost
    FROM cube, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""
