"""Quality rules: fixed counts, and a logistic regression on hashed word and character n-grams.

The regression learns from labelled rows, its scores are calibrated as
probabilities on a part of them held back, and texts are scored in Arrow batches
against fixed thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.textkit import SPACE, Texts, hashes, mix, owners, runs, shingles

WORD_SLOTS, GRAM_SLOTS = 2048, 2048
SLOTS = WORD_SLOTS + GRAM_SLOTS
#: At most this many labelled rows are used for the fit.
FIT_ROWS = 3000
#: A text is kept from this probability of good quality on.
KEEP_FROM = 0.5
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

RULES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _later_copies(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """True for an item equal to an earlier one of the same text."""
    keys = mix(values ^ mix(text.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return same


def _has_copy(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """True for an item with an equal one in the same text."""
    keys = mix(values ^ mix(text.astype(np.uint64)))
    order = np.argsort(keys)
    ranked = keys[order]
    equal = ranked[1:] == ranked[:-1]
    both = np.zeros(len(keys), bool)
    both[1:] |= equal
    both[:-1] |= equal
    out = np.empty(len(keys), bool)
    out[order] = both
    return out


def rule_counts(texts: Texts, sums: np.ndarray, words: tuple) -> dict[str, np.ndarray]:
    """Counts of each text, over its whole bytes."""
    data, offsets = texts.data, texts.offsets
    starts, ends, word_offsets = words
    n_words = np.diff(word_offsets)
    in_word = ~SPACE[data] & ((data & 0xC0) != 0x80)
    values = hashes(sums, starts, ends)
    windows, where = shingles(values, word_offsets, REPEAT_WINDOW, short=False)
    first = np.flatnonzero(np.arange(len(values)) + REPEAT_WINDOW <= word_offsets[owners(word_offsets) + 1])
    cover = np.zeros(len(values) + 1, np.int64)
    repeated = first[_has_copy(windows, where)] if len(windows) else first
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + REPEAT_WINDOW, -1)
    line_starts, line_ends, line_offsets = texts.lines()
    spoken = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_text = owners(line_offsets)[spoken]
    later = _later_copies(hashes(sums, line_starts[spoken], line_ends[spoken]), line_text)
    n_repeat = _per_text(np.cumsum(cover)[:-1] > 0, word_offsets)
    return {
        "n_words": n_words,
        "word_chars": _per_text(in_word, offsets),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_text[later], minlength=len(texts)),
        "n_repeat_words": n_repeat,
        "base_failed": (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words),
    }


def feature_matrix(texts: Texts, sums: np.ndarray, words: tuple) -> np.ndarray:
    """Damped, normed counts of hashed words and of hashed runs of four bytes."""
    starts, ends, word_offsets = words
    n = len(texts)
    slot = (hashes(sums, starts, ends) >> np.uint64(40)).astype(np.int64) % WORD_SLOTS
    word_part = np.bincount(owners(word_offsets) * WORD_SLOTS + slot, minlength=n * WORD_SLOTS)
    data = texts.data.astype(np.uint32)
    if len(data) > 3:
        grams = data[:-3] | (data[1:-2] << 8) | (data[2:-1] << 16) | (data[3:] << 24)
        slot = ((grams * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(GRAM_SLOTS)
        text = owners(texts.offsets)
        inside = text[:-3] == text[3:]
        index = text[:-3][inside] * GRAM_SLOTS + slot[inside]
    else:
        index = np.zeros(0, np.int64)
    gram_part = np.bincount(index, minlength=n * GRAM_SLOTS)
    parts = []
    for part, width in ((word_part, WORD_SLOTS), (gram_part, GRAM_SLOTS)):
        part = np.log1p(part.reshape(n, width).astype(np.float32))
        parts.append(part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-6))
    return np.concatenate(parts, axis=1)


@dataclass
class QualityModel:
    """Weights of the hashed features, and the line that makes scores probabilities."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, matrix: np.ndarray) -> np.ndarray:
        score = matrix @ self.weights + np.float32(self.bias)
        return 1 / (1 + np.exp(-(self.slope * score.astype(np.float64) + self.shift)))


def _descend(matrix: np.ndarray, target: np.ndarray, ridge: float, steps: int = 200, rate: float = 0.05):
    """Logistic regression by gradient steps with adapted rates; the classes weigh the same."""
    share = target.mean()
    weight = np.where(target > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    w, b = np.zeros(matrix.shape[1], np.float32), 0.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        off = ((1 / (1 + np.exp(-(matrix @ w + np.float32(b)))) - target) * weight).astype(np.float32)
        gradient = np.append(off @ matrix / len(target) + ridge * w, off.mean())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - move[-1]
    return w, float(b)


def fit(matrix: np.ndarray, target: np.ndarray) -> QualityModel:
    """Fit on four rows in five, calibrate on the fifth; a single class gives a constant near 1 or 0."""
    target = target.astype(np.float32)
    if len(target) < 20 or min(target.sum(), (1 - target).sum()) < 5:
        share = (target.sum() + 2) / (len(target) + 2)
        return QualityModel(np.zeros(SLOTS, np.float32), 0.0, 0.0, float(np.log(share / max(1 - share, 1e-3))))
    held = np.arange(len(target)) % 5 == 4
    w, b = _descend(matrix[~held], target[~held], ridge=1e-4)
    score, goal = matrix[held] @ w + b, target[held]
    if 0 < goal.sum() < len(goal):
        slope, shift = _descend_line(score, goal)
    else:
        slope, shift = 1.0, 0.0
    return QualityModel(w, b, slope, shift)


def _descend_line(score: np.ndarray, goal: np.ndarray) -> tuple[float, float]:
    """Platt's line by Newton steps, with his smoothed targets."""
    good, bad = goal.sum(), len(goal) - goal.sum()
    goal = np.where(goal > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    line = np.array([1.0, 0.0])
    design = np.stack([score.astype(np.float64), np.ones(len(score))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ line))
        slope = design.T @ (p - goal)
        curve = (design * (p * (1 - p) + 1e-6)[:, None]).T @ design + 1e-6 * np.eye(2)
        line = line - np.clip(np.linalg.solve(curve, slope), -1, 1)
    return float(max(line[0], 0.0)), float(line[1])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fit on at most `fit_rows` labelled rows, those of smallest crc32 of their id.

    A document labelled twice takes its lower quality; null labels and ids are left out.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("__quality"))
        .join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
        .orderBy(F.crc32(F.col("doc_id").cast("string")), "doc_id").limit(fit_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "__quality", "text")

    def features(batches):
        for batch, texts in runs(batches, "text"):
            matrix = np.float16(feature_matrix(texts, texts.sums(), texts.words()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int32()), pa.array([row.tobytes() for row in matrix], pa.binary())],
                names=["doc_id", "quality", "features"],
            )

    table = rows.mapInArrow(features, "doc_id long, quality int, features binary").toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("features", "ascending")]).slice(0, fit_rows)
    # row by row into the matrix, so that the features are held twice at no time
    matrix = np.empty((table.num_rows, SLOTS), np.float32)
    for row, body in enumerate(table.column("features")):
        matrix[row] = np.frombuffer(body.as_buffer(), np.float16)
    target = table.column("quality").to_numpy() > 0
    del table
    pa.default_memory_pool().release_unused()
    return fit(matrix, target)


def judge(
    docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",), threshold: float = KEEP_FROM, prefix: str = ""
) -> DataFrame:
    """Columns `keep` of every row of `docs` with its counts, probability and verdict, whose names start with `prefix`.

    A null or empty text has no words, so it fails the base rules. Rows of equal
    id are judged one by one. No row is left out and none is cut.
    """
    extra = [name for name in keep if name != "text"]
    columns = [*extra, "text"] if "text" not in keep else list(keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    verdicts = ", ".join(prefix + field for field in f"{RULES}, kept boolean, quality_chance double".split(", "))

    def score(batches):
        for batch, texts in runs(batches, "text"):
            sums, words = texts.sums(), texts.words()
            counts = rule_counts(texts, sums, words)
            chance = model.probability(feature_matrix(texts, sums, words))
            kept = ~counts["base_failed"] & (chance >= threshold)
            arrays = [batch.column(batch.schema.get_field_index(name)) for name in keep]
            yield pa.RecordBatch.from_arrays(
                [*arrays, *(pa.array(v) for v in counts.values()), pa.array(kept), pa.array(chance)],
                names=[*keep, *(prefix + name for name in (*counts, "kept", "quality_chance"))],
            )

    return docs.select(*columns).mapInArrow(score, f"{fields}, {verdicts}")


def quality_rules(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Train on `labels`, then judge every document."""
    return judge(docs, train(docs, labels), keep)
