"""Language identification by rank-order profiles of character n-grams.

A language's profile ranks its most frequent n-grams; a text has the language
whose ranks its own most frequent n-grams are least out of place in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.textkit import Texts, owners, runs

SLOTS = 8192
PROFILE = 300
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_counts(texts: Texts) -> np.ndarray:
    """Counts of n-grams of one to three bytes by hashed slot; all but letters is one blank."""
    n = len(texts)
    data = _FOLD[texts.data].astype(np.uint32)
    text = owners(texts.offsets)
    counts = np.zeros(n * SLOTS, np.int64)
    grams, start = np.zeros(len(data), np.uint32), 0
    for size in (1, 2, 3):
        if len(data) < size:
            break
        grams = (grams[: len(data) - size + 1] << np.uint32(8)) | data[size - 1 :]
        start = text[: len(grams)]
        inside = (start == text[size - 1 :]) & (data[: len(grams)] + data[size - 1 :] != 0x40)
        slot = (((grams ^ np.uint32(size << 28)) * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
        counts += np.bincount(start[inside] * SLOTS + slot[inside], minlength=n * SLOTS)
    return counts.reshape(n, SLOTS)


def top_slots(counts: np.ndarray, size: int = PROFILE) -> tuple[np.ndarray, np.ndarray]:
    """Slots by falling count (ties: lower slot first), and which of them occur at all."""
    keys = counts * SLOTS + (SLOTS - 1 - np.arange(SLOTS))
    part = np.partition(keys, SLOTS - size, axis=1)[:, SLOTS - size :]
    part = -np.sort(-part, axis=1)
    return SLOTS - 1 - part % SLOTS, part >= SLOTS


def has_letters(texts: Texts) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = (_FOLD[texts.data] >= 97) & (texts.data < 128)
    seen = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = seen[texts.offsets[1:]] > seen[texts.offsets[:-1]]
    for row in np.flatnonzero(~out & (np.diff(texts.offsets) > 0)):
        body = texts.data[texts.offsets[row] : texts.offsets[row + 1]]
        out[row] = any(c.isalpha() for c in body.tobytes().decode("utf-8", "replace"))
    return out


@dataclass
class Profiles:
    languages: list[str]
    #: Rank of each slot in each language; PROFILE where it is not among the most frequent.
    ranks: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest language and a score, 1 for equal ranks and 0 for none shared."""
        slots, present = top_slots(counts)
        places = np.arange(PROFILE)
        away = np.stack([(np.abs(rank[slots] - places) * present).sum(axis=1) for rank in self.ranks])
        best = away.argmin(axis=0)
        most = np.maximum((present * np.maximum(places, PROFILE - places)).sum(axis=1), 1)
        return best, 1 - away.min(axis=0) / most


def learn(labelled: DataFrame) -> Profiles:
    """Profiles from `text` and non-null `lang` of all different texts."""
    usable = labelled.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("text").alias("__text"))
    sample = usable.dropDuplicates(["__text", "lang"])

    def count(batches):
        for batch, texts in runs(batches, "text"):
            counts = gram_counts(texts)
            names = batch.column(1).to_pylist()
            for name in sorted(set(names)):
                total = counts[[i for i, n in enumerate(names) if n == name]].sum(axis=0)
                slots = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(total[slots])],
                    names=["lang", "slot", "n"],
                )

    rows = (
        sample.select("text", "lang").mapInArrow(count, "lang string, slot int, n long")
        .groupBy("lang", "slot").agg(F.sum("n").alias("n")).orderBy("lang", "slot").toArrow()
    )
    names = rows.column("lang").to_pylist()
    languages = sorted(set(names))
    counts = np.zeros((len(languages), SLOTS), np.int64)
    if languages:
        index = {name: i for i, name in enumerate(languages)}
        counts[[index[n] for n in names], rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    ranks = np.full((len(languages), SLOTS), PROFILE, np.int32)
    if languages:
        slots, present = top_slots(counts)
        for rank, slot, here in zip(ranks, slots, present):
            rank[slot[here]] = np.arange(PROFILE)[here]
    return Profiles(languages, ranks)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """lang_pred and score of every row, from its whole text.

    `und` with score 0 where the text is null or has no letter, or nothing was
    learnt. Equal distances take the language that sorts first.
    """

    def predict(batches):
        for batch, texts in runs(batches, "text"):
            names = np.full(len(texts), UNKNOWN, object)
            scores = np.zeros(len(texts))
            if profiles.languages:
                best, near = profiles.predict(gram_counts(texts))
                known = has_letters(texts)
                names[known] = np.array(profiles.languages, object)[best[known]]
                scores[known] = np.clip(near[known], 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict all rows."""
    profiles = learn(docs.where(~held_out()))
    return identify(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
