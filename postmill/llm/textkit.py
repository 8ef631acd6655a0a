"""Vectorised work on Arrow string columns: bytes, words, lines and rolling hashes.

A batch of texts is one byte array with row offsets; every function works on
the whole batch at once, so that the cost of a row is that of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 2 << 20
RUN_ROWS = 512

_GENERATOR = np.random.Generator(np.random.PCG64(20240607))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random number for each byte value; letters A-Z share that of a-z in the folded table.
CODES = _GENERATOR.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
FOLDED = CODES.copy()
FOLDED[65:91] = CODES[97:123]
#: Odd factors that tell the places within a shingle apart.
PLACES = _GENERATOR.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, size: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < size:
        steps = np.full(max(size, RUN_BYTES + 1), base, np.uint64)
        steps[0] = 1
        table = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return table[:size]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


class Texts:
    """A run of texts: `data` holds their bytes, text i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def sums(self, codes: np.ndarray = CODES) -> np.ndarray:
        """Prefix sums from which `hashes` takes the hash of any range of bytes."""
        out = np.empty(len(self.data) + 1, np.uint64)
        out[0] = 0
        np.cumsum(codes[self.data] * _power_table("up", _BASE, len(self.data)), out=out[1:])
        return out

    def boundaries(self) -> np.ndarray:
        """True where a text starts; one entry more than bytes, the last is True."""
        marks = np.zeros(len(self.data) + 1, bool)
        marks[self.offsets] = True
        return marks

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words (runs without ASCII white space), and word offsets of the texts."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self.offsets), np.int64)
        solid, marks = ~SPACE[self.data], self.boundaries()
        before = np.empty(len(solid), bool)
        before[0] = False
        before[1:] = solid[:-1]
        starts = np.flatnonzero(solid & (~before | marks[:-1]))
        after = np.empty(len(solid), bool)
        after[-1] = False
        after[:-1] = solid[1:]
        ends = np.flatnonzero(solid & (~after | marks[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of lines split at newlines, and line offsets of the texts; no text, no line."""
        breaks = np.flatnonzero(self.data == 10)
        filled = np.flatnonzero(np.diff(self.offsets) > 0)
        starts = np.sort(np.concatenate([self.offsets[filled], breaks + 1]))
        ends = np.sort(np.concatenate([self.offsets[filled + 1], breaks]))
        counts = np.zeros(len(self), np.int64)
        owner = np.searchsorted(self.offsets, breaks, "right") - 1
        np.add.at(counts, owner, 1)
        counts[filled] += 1
        return starts, ends, np.concatenate([[0], np.cumsum(counts)])


def hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand."""
    back = _power_table("down", _INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text of each item, from item offsets of the texts."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingles(word_hashes: np.ndarray, offsets: np.ndarray, size: int, short: bool = True):
    """Hash and text of each run of `size` words, in order.

    With `short`, a text of fewer words has its whole sequence as one shingle;
    texts without words have none.
    """
    n = len(word_hashes)
    text = owners(offsets)
    combined = np.zeros(max(n - size + 1, 0), np.uint64)
    for place in range(size):
        combined += word_hashes[place : place + len(combined)] * PLACES[place]
    whole = np.arange(len(combined)) + size <= offsets[text[: len(combined)] + 1]
    values, where = mix(combined[whole]), text[: len(combined)][whole]
    if short:
        counts = np.diff(offsets)
        few = np.flatnonzero((counts > 0) & (counts < size))
        if len(few):
            extra = np.zeros(len(few), np.uint64)
            for place in range(size - 1):
                has = counts[few] > place
                extra[has] += word_hashes[offsets[few[has]] + place] * PLACES[place]
            extra = mix(extra + counts[few].astype(np.uint64) * PLACES[-1])
            values, where = np.concatenate([values, extra]), np.concatenate([where, few])
            order = np.argsort(where, kind="stable")
            values, where = values[order], where[order]
    return values, where


def texts_of(column: pa.Array) -> Texts:
    """Bytes of a string column; nulls are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.binary()) if pa.types.is_string(column.type) else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def runs(batches: Iterator[pa.RecordBatch], column: str, run_bytes: int = RUN_BYTES, run_rows: int = RUN_ROWS):
    """Batches cut into runs of about `run_bytes` of text (one row at least, `run_rows` at most), with their texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = texts_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(whole.offsets, whole.offsets[at] + run_bytes, "right")) - 1
            end = min(max(end, at + 1), at + run_rows, batch.num_rows)
            lo, hi = whole.offsets[at], whole.offsets[end]
            yield batch.slice(at, end - at), Texts(whole.data[lo:hi], whole.offsets[at : end + 1] - lo)
            at = end


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return values.astype(np.uint64, copy=False).view(np.int64)


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of bytes of a contiguous array, as an Arrow binary column; offsets count items of `data`."""
    data = np.ascontiguousarray(data)
    offsets = (np.asarray(offsets, np.int64) * data.itemsize).astype(np.int64)
    column = pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    )
    return column.cast(pa.binary())
