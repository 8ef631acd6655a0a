"""Removal of repeated byte strings with suffix arrays built by two-stage sorting.

A string of LENGTH bytes occurs twice only where its least gram, its anchor,
does. Texts are cut into blocks, the strings of one anchor; equal blocks are found
by hash, and where one anchor has different blocks their bytes are put into
a suffix array, whose adjacent common prefixes tell the strings they share.

The array: suffixes smaller than their successor are sorted directly; the rest
is induced bucket by bucket from the order of their successors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.scratch import Scratch, shuffle_partitions
from postmill.llm.textkit import Texts, binaries, hashes, mix, owners, runs

LENGTH = 50
GRAM = 20
#: Bytes of blocks that are sorted at a time, about; an anchor's blocks stay together.
SORT_BYTES = 1 << 19

_PLACE_BITS = np.uint64(28)
_PLACES = np.uint64((1 << 28) - 1)

SPAN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("size", "<u4")])
REQUEST = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("size", "<u1")])


# --- blocks --------------------------------------------------------------------

def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of `width` entries."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def blocks(texts: Texts, length: int = LENGTH, gram: int = GRAM):
    """Text, start, end, anchor hash and block hash of each block of strings with one anchor.

    The anchor of a string is the leftmost of its grams with the least hash, so
    equal strings have equal anchors, and a block is known by its bytes.
    """
    data = texts.data
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = texts.sums()
    at = np.arange(len(data) - gram + 1)
    grams = hashes(sums, at, at + gram)
    keys = (grams & ~_PLACES) | at.astype(np.uint64)
    least = _least(keys, length - gram + 1)
    text = owners(texts.offsets)
    strings = np.flatnonzero(text[: len(least)] == text[length - 1 :])
    if not len(strings):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = (least[strings] & _PLACES).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:], [len(strings)]]) - 1
    start, end = strings[first], strings[last] + length
    return text[start], start, end, grams[anchor[first]], hashes(sums, start, end)


def _runs_of(keys: list[np.ndarray]) -> np.ndarray:
    """Number of each run of rows equal in all sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.cumsum(new) - 1


def _group_least(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Least value of each row's group; groups are sorted."""
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return np.minimum.reduceat(values, heads)[group - group[0]]


def _dealt(kind: str, keys: np.ndarray, rows: np.ndarray, parts: int):
    """Rows packed by the bucket of their key, as batches (bucket, kind, doc_id, body)."""
    if not len(rows):
        return
    bucket = (mix(keys.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=parts)
    filled = np.flatnonzero(counts)
    body = binaries(
        np.frombuffer(rows[order].tobytes(), np.uint8), np.concatenate([[0], np.cumsum(counts[filled])]) * rows.itemsize
    )
    yield pa.RecordBatch.from_arrays(
        [pa.array(filled.astype(np.int32)), pa.array([kind] * len(filled)), pa.nulls(len(filled), pa.int64()), body],
        names=["bucket", "kind", "doc_id", "body"],
    )


PACKED = "bucket int, kind string, doc_id long, body binary"


def _pack_columns(columns: list[np.ndarray]) -> bytes:
    """Columns one after the other, so that the ordered ones compress."""
    return b"".join([len(columns[0]).to_bytes(4, "little"), *(np.ascontiguousarray(c).tobytes() for c in columns)])


def _cut(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bytes of 64-bit values."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :width]


def _widen(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.view(np.uint64).ravel()


def _emit_blocks(parts: int, length: int):
    """Blocks of each run, packed by anchor; copies within the run are settled at once."""

    def emit(batches):
        for batch, texts in runs(batches, "text"):
            ids = batch.column(0).to_numpy()
            text, start, end, anchor, block = blocks(texts, length)
            if not len(text):
                continue
            doc = ids[text]
            order = np.lexsort((doc, block))
            text, start, end, anchor, block, doc = (x[order] for x in (text, start, end, anchor, block, doc))
            group = _runs_of([block])
            later = doc > _group_least(group, doc)
            local = (start - texts.offsets[text]).astype(np.uint32)
            size = (end - start).astype(np.uint8)
            spans = np.zeros(int(later.sum()), SPAN)
            spans["doc"], spans["start"], spans["size"] = doc[later], local[later], size[later]
            spans = merged(spans)
            yield from _dealt("span", spans["doc"], spans, parts)
            keep = np.flatnonzero(~later)
            keep = keep[np.lexsort((local[keep], text[keep]))]
            bucket = (mix(anchor[keep]) % np.uint64(parts)).astype(np.int64)
            keep = keep[np.argsort(bucket, kind="stable")]
            counts = np.bincount(bucket, minlength=parts)
            bodies, filled, at = [], np.flatnonzero(counts), 0
            for b in filled:
                rows = keep[at : at + counts[b]]
                at += counts[b]
                seen, place = np.unique(text[rows], return_inverse=True)
                bodies.append(len(seen).to_bytes(4, "little") + ids[seen].astype(np.int64).tobytes() + _pack_columns(
                    [_cut(anchor[rows], 6), _cut(block[rows], 6), place.astype(np.uint16), local[rows], size[rows]]
                ))
            yield pa.RecordBatch.from_arrays(
                [pa.array(filled.astype(np.int32)), pa.array(["block"] * len(filled)), pa.nulls(len(filled), pa.int64()), pa.array(bodies, pa.binary())],
                names=["bucket", "kind", "doc_id", "body"],
            )

    return emit


def _unpack(body: bytes):
    raw = np.frombuffer(body, np.uint8)
    seen = int.from_bytes(body[:4], "little")
    at = 4 + 8 * seen
    ids = np.frombuffer(body[4:at], np.int64)
    n = int.from_bytes(body[at : at + 4], "little")
    at += 4
    out = []
    for width in (6, 6, 2, 4, 1):
        out.append(raw[at : at + n * width])
        at += n * width
    return (
        _widen(out[0], 6), _widen(out[1], 6), ids[out[2].copy().view(np.uint16)], out[3].copy().view(np.uint32), out[4]
    )


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans of each document joined where they touch or overlap."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["doc"]))]
    start = spans["start"].astype(np.int64)
    end = start + spans["size"]
    _, doc = np.unique(spans["doc"], return_inverse=True)
    # Ends run on within a document: documents are set apart by more than any text is long.
    wide = np.int64(1) << 34
    reach = np.maximum.accumulate(end + doc * wide)
    new = np.concatenate([[True], start[1:] + doc[1:] * wide > reach[:-1]])
    heads = np.flatnonzero(new)
    tails = np.concatenate([heads[1:], [len(spans)]]) - 1
    out = spans[heads].copy()
    out["size"] = (reach[tails] - doc[tails] * wide - start[heads]).astype(np.uint32)
    return out


def _settle(parts: int):
    """Blocks met by anchor: equal ones of a later document are spans, different ones of one anchor are requests."""

    def settle(batches):
        bodies = []
        for batch in batches:
            for kind, body in zip(batch.column(1).to_pylist(), batch.column(3)):
                bodies.append(body.as_buffer().to_pybytes())
        if not bodies:
            return
        anchor, block, doc, start, size = (np.concatenate(c) for c in zip(*map(_unpack, bodies)))
        del bodies
        order = np.argsort(anchor, kind="stable")
        ranked = anchor[order]
        twice = np.zeros(len(order), bool)
        twice[1:] = ranked[1:] == ranked[:-1]
        twice[:-1] |= twice[1:]
        order = order[twice]
        if not len(order):
            return
        anchor, block, doc, start, size = (x[order] for x in (anchor, block, doc, start, size))
        order = np.lexsort((doc, block, anchor))
        anchor, block, doc, start, size = (x[order] for x in (anchor, block, doc, start, size))
        by_block = _runs_of([anchor, block])
        later = doc > _group_least(by_block, doc)
        spans = np.zeros(int(later.sum()), SPAN)
        spans["doc"], spans["start"], spans["size"] = doc[later], start[later], size[later]
        spans = merged(spans)
        yield from _dealt("span", spans["doc"], spans, parts)
        by_anchor = _runs_of([anchor])
        first_doc = _group_least(by_anchor, doc)
        other = np.maximum.reduceat(np.where(later, first_doc, doc), np.flatnonzero(np.concatenate([[True], by_anchor[1:] != by_anchor[:-1]])))[by_anchor]
        ask = ~later & (other > first_doc)
        requests = np.zeros(int(ask.sum()), REQUEST)
        requests["anchor"], requests["doc"], requests["start"], requests["size"] = anchor[ask], doc[ask], start[ask], size[ask]
        yield from _dealt("request", requests["doc"], requests, parts)

    return settle


def _pack_texts(parts: int):
    """Compressed texts by bucket of their document."""

    def pack(batches):
        for batch, texts in runs(batches, "text"):
            ids = batch.column(0).to_numpy()
            bucket = (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
            bodies = []
            for a, b in zip(texts.offsets[:-1], texts.offsets[1:]):
                bodies.append(int(b - a).to_bytes(8, "little") + pa.compress(texts.data[a:b].tobytes(), "zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(["text"] * len(ids)), batch.column(0), pa.array(bodies, pa.binary())],
                names=["bucket", "kind", "doc_id", "body"],
            )

    return pack


def _text(body) -> bytes:
    raw = body.as_buffer()
    return pa.decompress(raw[8:], int.from_bytes(raw[:8].to_pybytes(), "little"), "zstd").to_pybytes()


def _beside_texts(packs: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """Packs and texts of the same documents in one partition, packs first."""
    return packs.unionByName(texts).repartition(parts, "bucket").sortWithinPartitions("kind")


def _by_document(rows: np.ndarray) -> dict[int, np.ndarray]:
    if not len(rows):
        return {}
    rows = rows[np.argsort(rows["doc"], kind="stable")]
    cuts = np.flatnonzero(np.concatenate([[True], rows["doc"][1:] != rows["doc"][:-1]]))
    return {int(rows["doc"][a]): rows[a:b] for a, b in zip(cuts, np.concatenate([cuts[1:], [len(rows)]]))}


def _packs_then_texts(batches, dtype):
    """Yields (rows of packs by document, None) once, then (doc_id, text) of each text."""
    held, table = [], None
    for batch in batches:
        for kind, doc, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if kind != "text":
                held.append(np.frombuffer(body.as_buffer().to_pybytes(), dtype))
                continue
            if table is None:
                table = _by_document(np.concatenate(held)) if held else {}
                held = []
            yield table, doc, body


def _fetch(parts: int):
    """The bytes asked for, packed by anchor."""

    def fetch(batches):
        found, size = [], 0
        for table, doc, body in _packs_then_texts(batches, REQUEST):
            asked = table.get(doc)
            if asked is None:
                continue
            data = _text(body)
            for row in asked:
                piece = data[row["start"] : row["start"] + row["size"]]
                found.append((int(row["anchor"]), doc, int(row["start"]), piece))
                size += len(piece)
            if size > 4 << 20:
                yield _fetched(found, parts)
                found, size = [], 0
        if found:
            yield _fetched(found, parts)

    return fetch


def _fetched(found: list[tuple], parts: int) -> pa.RecordBatch:
    anchors = np.array([f[0] for f in found], np.uint64)
    bucket = (mix(anchors) % np.uint64(parts)).astype(np.int64)
    bodies, filled = [], np.unique(bucket)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.append(filled, parts))
    for a, b in zip(cuts[:-1], cuts[1:]):
        rows = [found[i] for i in order[a:b]]
        columns = [np.array([r[k] for r in rows], d) for k, d in ((0, np.uint64), (1, np.int64), (2, np.uint32))]
        columns.append(np.array([len(r[3]) for r in rows], np.uint8))
        bodies.append(_pack_columns(columns) + b"".join(r[3] for r in rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(filled.astype(np.int32)), pa.array(["piece"] * len(filled)), pa.nulls(len(filled), pa.int64()), pa.array(bodies, pa.binary())],
        names=["bucket", "kind", "doc_id", "body"],
    )


# --- suffix array --------------------------------------------------------------

def two_stage_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of `symbols`, in order of their first `depth` symbols at least.

    Symbols are 0 to 256. A suffix is small if it is less than its successor; a
    symbol's bucket holds its large suffixes first, then its small ones. Small
    suffixes are sorted directly; large ones follow, bucket by bucket, from the
    order of their successors, which stand in earlier buckets or earlier in theirs.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    following = np.append(symbols[1:], -1).astype(np.int32)
    differs = symbols != following
    # The type of a run of equal symbols is that of its last one.
    deciding = np.flatnonzero(differs)[np.searchsorted(np.flatnonzero(differs), np.arange(n))]
    small = symbols[deciding] < following[deciding]
    rank = np.full(n + 1, -1, np.int64)
    counts = np.bincount(symbols, minlength=257)
    bucket = np.concatenate([[0], np.cumsum(counts)])
    chosen = np.flatnonzero(small)
    if len(chosen):
        padded = np.concatenate([symbols.astype(np.int32), np.full(depth + 8, -1, np.int32)]) + 1
        keys = []
        for at in range(0, depth, 6):
            word = np.zeros(len(chosen), np.uint64)
            for k in range(6):
                word = (word << np.uint64(9)) | padded[chosen + at + k].astype(np.uint64)
            keys.append(word)
        chosen = chosen[np.lexsort(keys[::-1])]
        symbol = symbols[chosen]
        within = np.arange(len(chosen)) - np.searchsorted(symbol, symbol)
        small_counts = np.bincount(symbol, minlength=257)
        rank[chosen] = bucket[symbol + 1] - small_counts[symbol] + within
    large = np.flatnonzero(~small)
    by_symbol = large[np.argsort(symbols[large], kind="stable")]
    cuts = np.searchsorted(symbols[by_symbol], np.arange(258))
    for c in np.flatnonzero(np.diff(cuts)):
        mine = by_symbol[cuts[c] : cuts[c + 1]]
        layer = mine[following[mine] != c]
        layer = layer[np.argsort(rank[layer + 1], kind="stable")]
        at = bucket[c]
        while len(layer):
            rank[layer] = at + np.arange(len(layer))
            at += len(layer)
            before = layer - 1
            layer = before[(before >= 0) & (symbols[before] == c)]
    order = np.empty(n, np.int64)
    order[rank[:n]] = np.arange(n)
    return order


def adjacent_prefixes(symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to `most`, of each suffix in order with the one before; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    padded = np.concatenate([symbols, np.full(most, -1, symbols.dtype)])
    for k in range(most):
        alive = alive[padded[order[alive] + k] == padded[order[alive - 1] + k]]
        if not len(alive):
            break
        out[alive] = k + 1
    return out


def shared_strings(pieces: list[tuple[int, int, bytes]], length: int) -> np.ndarray:
    """Spans of the strings that occur in a piece of an earlier document too. Pieces are (doc, start, bytes)."""
    sizes = np.array([len(p[2]) for p in pieces])
    joined = np.frombuffer(b"".join(p[2] + b"\0" for p in pieces), np.uint8).astype(np.int16) + 1
    ends = np.cumsum(sizes + 1)
    joined[ends - 1] = 0
    order = two_stage_order(joined, length)
    piece = np.searchsorted(ends, order, "right")
    whole = order + length <= ends[piece] - 1
    order, piece = order[whole], piece[whole]
    if not len(order):
        return np.zeros(0, SPAN)
    prefixes = adjacent_prefixes(joined, order, length)
    group = np.cumsum(prefixes < length)
    doc = np.array([p[0] for p in pieces], np.int64)[piece]
    covered = doc > _group_least(group, doc)
    starts = np.array([p[1] for p in pieces], np.int64)
    spans = np.zeros(int(covered.sum()), SPAN)
    spans["doc"] = doc[covered]
    spans["start"] = (order - (ends - sizes - 1)[piece] + starts[piece])[covered]
    spans["size"] = length
    return merged(spans)


def _sort_pieces(parts: int, length: int):
    """Suffix arrays over the pieces of a partition, whole anchors at a time."""

    def sort(batches):
        pieces = []
        for batch in batches:
            for body in batch.column(3):
                raw = body.as_buffer().to_pybytes()
                n = int.from_bytes(raw[:4], "little")
                at, columns = 4, []
                for dtype in (np.uint64, np.int64, np.uint32, np.uint8):
                    width = np.dtype(dtype).itemsize
                    columns.append(np.frombuffer(raw[at : at + n * width], dtype).tolist())
                    at += n * width
                for anchor, doc, start, size in zip(*columns):
                    pieces.append((anchor, doc, start, raw[at : at + size]))
                    at += size
        pieces.sort(key=lambda p: p[0])
        chunk, size, last = [], 0, None
        for anchor, *piece in pieces:
            if size > SORT_BYTES and anchor != last:
                spans = shared_strings(chunk, length)
                yield from _dealt("span", spans["doc"], spans, parts)
                chunk, size = [], 0
            chunk.append(piece)
            size += len(piece[2])
            last = anchor
        if chunk:
            spans = shared_strings(chunk, length)
            yield from _dealt("span", spans["doc"], spans, parts)

    return sort


# --- whole operator --------------------------------------------------------------

def _cleaned(length: int, with_text: bool):
    def clean(batches):
        out: list[tuple] = []
        size = 0
        for table, doc, body in _packs_then_texts(batches, SPAN):
            data = _text(body)
            spans = table.get(doc)
            spans = merged(spans) if spans is not None else np.zeros(0, SPAN)
            kept, at, removed = [], 0, 0
            for start, width in zip(spans["start"].tolist(), spans["size"].tolist()):
                kept.append(data[at:start])
                at, removed = start + width, removed + width
            rest = b"".join([*kept, data[at:]])
            out.append((doc, len(data), removed, len(spans), rest if with_text else hashlib.sha256(rest).hexdigest()))
            size += len(rest)
            if len(out) >= 2000 or with_text and size > 8 << 20:
                yield _rows(out, with_text)
                out, size = [], 0
        if out:
            yield _rows(out, with_text)

    return clean


def _rows(out: list[tuple], with_text: bool) -> pa.RecordBatch:
    columns = list(zip(*out))
    last = pa.array([t.decode("utf-8", "replace") for t in columns[4]]) if with_text else pa.array(columns[4])
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.int64()) for c in columns[:4]), last],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "text" if with_text else "kept_sha256"],
    )


def suffix_dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (or the remaining text) of every row with an id.

    Each byte goes that a string of `length` bytes covers which also starts in a
    document of smaller doc_id. A null text is empty and nothing is removed from
    it; shorter texts keep all. Rows of one id count as one document: none covers
    the other, and each loses what either would lose at the same place, so give
    ids that are unique. Rows without an id are left out.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    scratch = Scratch(spark, "suffixes")
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    emitted = docs.where("text is not null").mapInArrow(_emit_blocks(parts, length), PACKED)
    local = emitted.where("kind = 'span'")
    met = scratch.write(
        emitted.where("kind = 'block'").repartition(parts, "bucket").mapInArrow(_settle(parts), PACKED), "met"
    )
    texts = docs.mapInArrow(_pack_texts(parts), PACKED)
    pieces = _beside_texts(met.where("kind = 'request'"), texts, parts).mapInArrow(_fetch(parts), PACKED)
    sorted_spans = scratch.write(pieces.repartition(parts, "bucket").mapInArrow(_sort_pieces(parts, length), PACKED), "sorted")
    spans = local.unionByName(met.where("kind = 'span'")).unionByName(sorted_spans)
    last = "text string" if with_text else "kept_sha256 string"
    return _beside_texts(spans, texts, parts).mapInArrow(
        _cleaned(length, with_text), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}"
    )
