"""Sums over the whole corpus for the keys that each run of texts asks for.

A run sends its different 64-bit keys with counts, packed by bucket of the key; a bucket adds them up over all
runs, and gives each run its totals back in the order asked. No task holds more than one bucket
or a few runs, however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Keys that one bucket holds, about.
BUCKET_KEYS = 2_000_000
#: Rows of packed keys that are sent at once.
ROWS_AT_ONCE = 256


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers of one length, by planes of bytes, compressed."""
    planes = np.concatenate([np.ascontiguousarray(c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).ravel() for c in columns])
    return len(columns[0]).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(body: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(body[:8], "little")
    planes = np.frombuffer(pa.decompress(body[8:], 8 * n * columns, "zstd"), np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(plane.T).reshape(-1).view(np.uint64) for plane in planes]


def rows_of(batches) -> Iterator[dict]:
    """Rows of Arrow batches, one at a time."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield {name: batch.column(k)[at].as_py() for k, name in enumerate(batch.schema.names)}


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of sorted keys begins, and their end: bucket k holds the k-th part of the range of keys."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def questions(run: str, sections: list[tuple[np.ndarray, np.ndarray]], names: tuple[str, ...], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (run, bucket, a binary for each of `names`) of sorted different keys and their counts."""
    bodies: list[dict[int, bytes]] = []
    for keys, counts in sections:
        cut = cuts(keys, buckets)
        bodies.append({
            k: pack(np.diff(keys[cut[k] : cut[k + 1]], prepend=np.uint64(0)), counts[cut[k] : cut[k + 1]])
            for k in np.flatnonzero(np.diff(cut)).tolist()
        })
    filled = sorted(set().union(*bodies))
    for at in range(0, len(filled), ROWS_AT_ONCE):
        some = filled[at : at + ROWS_AT_ONCE]
        yield pa.RecordBatch.from_arrays(
            [pa.array([run] * len(some)), pa.array(some, pa.int32()), *(pa.array([body.get(k) for k in some], pa.binary()) for body in bodies)],
            names=["run", "bucket", *names],
        )


def asked_fields(names: tuple[str, ...]) -> str:
    return "run string, bucket int, " + ", ".join(f"{name} binary" for name in names)


def answers(asked: DataFrame, names: tuple[str, ...], buckets: int) -> DataFrame:
    """The totals over all runs of what each row of `asked` holds, in its order.

    `positive` of the rows adds up to the number of different keys of the first section with a positive total.
    """

    def answer(batches):
        held: list[dict] = []
        for row in rows_of(batches):
            if held and held[0]["bucket"] != row["bucket"]:
                yield from _totals(held, names)
                held = []
            held.append(row)
        if held:
            yield from _totals(held, names)

    dealt = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(answer, f"{asked_fields(names)}, positive long")


def _totals(rows: list[dict], names: tuple[str, ...]):
    """Totals of one bucket, given back to each row."""
    positive, given = 0, []
    for section in names:
        parts = [unpack(row[section], 2) if row[section] else [np.zeros(0, np.uint64)] * 2 for row in rows]
        keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        counts = np.concatenate([p[1] for p in parts])
        order = np.argsort(keys)
        ranked = keys[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
        totals = np.add.reduceat(counts[order], first) if len(first) else counts
        if section == names[0]:
            positive = int((totals > 0).sum())
        spread = np.empty(len(keys), np.uint64)
        spread[order] = np.repeat(totals, np.diff(np.append(first, len(ranked))))
        ends = np.cumsum([0, *(len(p[0]) for p in parts)])
        given.append([pack(spread[a:b]) if b > a else None for a, b in zip(ends[:-1], ends[1:])])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([row["run"] for row in rows]), pa.array([row["bucket"] for row in rows], pa.int32()),
            *(pa.array(bodies, pa.binary()) for bodies in given), pa.array([positive] + [0] * (len(rows) - 1), pa.int64()),
        ],
        names=["run", "bucket", *names, "positive"],
    )
