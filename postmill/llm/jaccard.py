"""Exact Jaccard join of word n-gram sets, by relations between the sets.

Equal sets are one class. The corpus tells for each token how many classes hold it: a
class with too few shared tokens is linked with nothing and goes no further, and the
others are listed under their rarest tokens. Index lists are cut into blocks that are
skipped when their sizes, token positions or components leave nothing to find. In each list a leader is
compared with all members; answers between members follow from the leader's
wherever its overlaps bound theirs, and only the rest is compared.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.components import components
from postmill.llm.exchange import BUCKET_KEYS, answers, asked_fields, cuts, pack, questions, rows_of, unpack
from postmill.llm.scratch import Scratch, shuffle_partitions
from postmill.llm.textkit import FOLDED, Texts, binaries, hashes, mix, runs, shingles, signed

RUN_BYTES, RUN_ROWS = 2 << 20, 1 << 14
#: Runs that one task looks through, about.
TASK_RUNS = 8
#: Rows of an index list that are compared in one cell, about, and of one block of a cell.
CELL, BLOCK = 512, 128
#: Members compared with one copy of a leader.
STAR = 64
#: Bits of a parity sketch: the next power of two of the set's size, within these.
SKETCH_BITS = (256, 4096)
TOKENS = ("tokens",)

_ENTRY = np.dtype([("token", "<u8"), ("key", "V16"), ("n", "<u4"), ("place", "<u4")])


@dataclass(frozen=True)
class Rule:
    """Words in a shingle, and the least similarity as a fraction."""

    size: int = 5
    above: int = 80
    below: int = 100

    def needed(self, left, right):
        """Least overlap of sets of these sizes."""
        return -(-self.above * (left + right) // (self.above + self.below))

    def prefix(self, n):
        """How many first tokens of a set of n include one of any set similar to it."""
        return n - (-(-self.above * n // self.below)) + 1


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    """16 bytes that tell sets apart: 96 bits of sums of hashes, and the size."""
    out = np.zeros(len(sets), np.dtype([("a", "<u8"), ("b", "<u4"), ("n", "<u4")]))
    for row, values in enumerate(sets):
        out[row] = (values.sum(dtype=np.uint64), mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) >> np.uint64(32), len(values))
    return out


def _key_column(keys: np.ndarray) -> pa.Array:
    return binaries(np.frombuffer(keys.tobytes(), np.uint8), np.arange(len(keys) + 1) * 16)


def _sketch(values: np.ndarray) -> bytes:
    """Parity of the number of tokens in each of some hash buckets.

    Two sketches differ in no more bits than the sets have tokens apart, so pairs
    whose sketches differ too much are not similar: a bound, not an estimate.
    """
    width = min(max(1 << max(len(values) - 1, 1).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    counts = np.bincount((values >> np.uint64(40)).astype(np.int64) % width, minlength=width)
    return np.packbits(counts.astype(np.uint8) & 1).tobytes()


def _bits_apart(sketches: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of each pair differ; the wider one is folded to the width of the other."""
    sizes = np.array([len(s) for s in sketches])
    least = np.minimum(sizes[left], sizes[right])
    out = np.zeros(len(left), np.int64)
    folded: dict[int, np.ndarray] = {}
    place = np.full(len(sketches), -1)
    for width in np.unique(sizes)[::-1]:
        # each width holds the wider sketches, folded once more, and its own
        words = width // 8
        wider = [rows.reshape(len(rows), -1, words) for rows in ([folded[w] for w in folded][-1:])]
        own = np.flatnonzero(sizes == width)
        rows = [np.bitwise_xor.reduce(w, axis=1) for w in wider]
        base = len(rows[0]) if rows else 0
        place[own] = base + np.arange(len(own))
        rows.append(np.frombuffer(b"".join(sketches[k] for k in own), np.uint64).reshape(len(own), words))
        folded[width] = np.concatenate(rows)
        chosen = np.flatnonzero(least == width)
        for lo in range(0, len(chosen), 20_000):
            part = chosen[lo : lo + 20_000]
            apart = folded[width][place[left[part]]] ^ folded[width][place[right[part]]]
            out[part] = np.bitwise_count(apart).sum(axis=1)
    return out


def _tokens(texts: Texts, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts, and the text of each."""
    starts, ends, offsets = texts.words()
    return shingles(hashes(texts.sums(FOLDED), starts, ends), offsets, rule.size)


def _encoded(docs: DataFrame, rule: Rule) -> DataFrame:
    """One row for each run of whole texts: ids, sizes and class keys of its documents, and their compressed texts."""

    def encode(batches):
        for batch, texts in runs(batches, "text", RUN_BYTES, RUN_ROWS):
            tokens, where = _tokens(texts, rule)
            cut = np.searchsorted(where, np.arange(len(texts) + 1))
            keys = _keys([np.unique(tokens[a:b]) for a, b in zip(cut[:-1], cut[1:])])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().hex]), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([keys["n"].astype(np.int64)], pa.list_(pa.int64())), pa.array([_key_column(keys)], pa.list_(pa.binary())),
                    pa.array([pack(np.diff(texts.offsets))], pa.binary()),
                    pa.array([pa.Codec("zstd", compression_level=3).compress(texts.data.tobytes(), asbytes=True)], pa.binary()),
                    pa.array([len(tokens)], pa.int64()),
                ],
                names=["run", "doc_ids", "sizes", "keys", "lengths", "texts", "tokens"],
            )

    fields = "run string, doc_ids array<long>, sizes array<long>, keys array<binary>, lengths binary, texts binary, tokens long"
    return docs.select("doc_id", "text").mapInArrow(encode, fields)


class _Run:
    """Token sets of the classes of one run: `tokens` and `owner` (a place in the run) by token, `first` place of each class."""

    def __init__(self, row: dict, rule: Rule):
        offsets = np.concatenate([[0], np.cumsum(unpack(row["lengths"], 1)[0].astype(np.int64))])
        data = np.frombuffer(pa.decompress(row["texts"], int(offsets[-1]), "zstd"), np.uint8)
        tokens, where = _tokens(Texts(data, offsets), rule)
        self.keys, self.sizes = row["keys"], np.array(row["sizes"], np.int64)
        seen: dict[bytes, int] = {}
        for place, (doc, key, n) in enumerate(zip(row["doc_ids"], row["keys"], row["sizes"])):
            if doc is not None and n:
                seen.setdefault(key, place)
        mine = np.zeros(len(self.sizes), bool)
        mine[list(seen.values())] = True
        tokens, where = tokens[mine[where]], where[mine[where]]
        order = np.argsort(tokens, kind="stable")
        tokens, where = tokens[order], where[order]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (where[1:] != where[:-1])
        self.tokens, self.owner = tokens[fresh], where[fresh]
        starts = np.ones(len(self.tokens), bool)
        starts[1:] = self.tokens[1:] != self.tokens[:-1]
        at = np.flatnonzero(starts)
        #: Different tokens, the classes of the run that hold them, and the place of each entry among them.
        self.asked, self.rank = self.tokens[at], np.cumsum(starts) - 1
        self.classes = np.diff(np.append(at, len(self.tokens)))


def _candidates(table: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Classes that may be linked: (key, values, sketch), and their packed index entries: (bucket, entries).

    Two similar sets share at least `above` in `below` of each, so a class with fewer tokens that others
    hold too is left out. Tokens are ordered from rare to frequent, and a class is listed under the
    first ones only, as far as others hold them.
    """
    count, tokens = table.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    parts = shuffle_partitions(table.sparkSession)
    buckets = max(parts, -(-tokens // BUCKET_KEYS))

    def ask(batches):
        for row in rows_of(batches):
            run = _Run(row, rule)
            yield from questions(row["run"], [(run.asked, run.classes)], TOKENS, buckets)

    names = ("doc_ids", "sizes", "keys", "lengths", "texts")
    totals = scratch.write(answers(table.select("run", *names).mapInArrow(ask, asked_fields(TOKENS)), TOKENS, buckets), "totals")

    def choose(batches):
        run = held = cut = None
        for row in rows_of(batches):
            if row["bucket"] < 0:
                if run is not None:
                    yield from _chosen(run, held, rule, buckets)
                run = _Run(row, rule)
                held, cut = np.zeros(len(run.asked), np.uint64), cuts(run.asked, buckets)
            else:
                held[cut[row["bucket"]] : cut[row["bucket"] + 1]] = unpack(row["tokens"], 1)[0]
        if run is not None:
            yield from _chosen(run, held, rule, buckets)

    kinds = {f.name: f.dataType for f in table.schema}
    heads = table.select("run", F.lit(-1).alias("bucket"), *names, F.lit(None).cast("binary").alias("tokens"))
    rest = totals.select("run", "bucket", *(F.lit(None).cast(kinds[n]).alias(n) for n in names), "tokens")
    dealt = heads.unionByName(rest).repartition(max(parts, -(-count // TASK_RUNS)), "run").sortWithinPartitions("run", "bucket")
    return dealt.mapInArrow(choose, "bucket int, entries binary, key binary, n int, values binary, sketch binary")


def _chosen(run: _Run, held: np.ndarray, rule: Rule, buckets: int):
    frequency = held[run.rank]
    shared = np.bincount(run.owner[frequency > 1], minlength=len(run.sizes))
    least = -(-rule.above * run.sizes // rule.below)
    chosen = (shared >= least) & (shared > 0)
    inside = chosen[run.owner]
    tokens, owner, frequency = run.tokens[inside], run.owner[inside], frequency[inside]
    order = np.lexsort((tokens, frequency, owner))
    tokens, owner, frequency = tokens[order], owner[order], frequency[order]
    starts = np.searchsorted(owner, np.arange(len(run.sizes)))
    place = np.arange(len(owner)) - starts[owner]
    listed = (place < rule.prefix(run.sizes)[owner]) & (frequency > 1)
    entries = np.empty(int(listed.sum()), _ENTRY)
    keys = np.frombuffer(b"".join(run.keys), "V16")
    entries["token"], entries["key"], entries["n"], entries["place"] = tokens[listed], keys[owner[listed]], run.sizes[owner[listed]], place[listed]
    entries = entries[np.argsort(entries["token"])]
    cut = cuts(entries["token"], buckets)
    filled = np.flatnonzero(np.diff(cut))
    names = ["bucket", "entries", "key", "n", "values", "sketch"]
    for at in range(0, len(filled), 256):
        some = filled[at : at + 256]
        blank = pa.nulls(len(some), pa.binary())
        bodies = pa.array([entries[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), bodies, blank, pa.nulls(len(some), pa.int32()), blank, blank], names=names)
    for row in np.flatnonzero(chosen).tolist():
        values = np.sort(tokens[starts[row] : starts[row] + run.sizes[row]])
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([run.keys[row]], pa.binary()), pa.array([len(values)], pa.int32()),
                pa.array([pack(np.diff(values, prepend=np.uint64(0)))], pa.binary()), pa.array([_sketch(values)], pa.binary()),
            ],
            names=names,
        )


def _lists(candidates: DataFrame, rule: Rule) -> DataFrame:
    """Entries of the index lists with two classes or more, each with the leader of its list and size band."""

    def lists(batches):
        held: list[bytes] = []
        bucket = None
        for row in rows_of(batches):
            if row["bucket"] != bucket:
                yield from _led(np.frombuffer(b"".join(held), _ENTRY), rule)
                held, bucket = [], row["bucket"]
            held.append(row["entries"])
        yield from _led(np.frombuffer(b"".join(held), _ENTRY), rule)

    packed = candidates.where("bucket is not null").select("bucket", "entries")
    dealt = packed.repartition(shuffle_partitions(candidates.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lists, "token long, key binary, n long, place int, leader binary, leader_n long, leader_place int")


def _led(entries: np.ndarray, rule: Rule):
    """Entries of tokens with several classes, each with the least class of its token and size band."""
    token = entries["token"]
    _, code, counts = np.unique(token, return_inverse=True, return_counts=True)
    entries = entries[counts[code] > 1]
    if not len(entries):
        return
    key = np.frombuffer(np.ascontiguousarray(entries["key"]).tobytes(), np.dtype([("a", "<u8"), ("b", "<u8")]))
    band = np.floor(np.log(entries["n"]) / np.log(rule.below / rule.above) + 1e-9).astype(np.int64)
    order = np.lexsort((key["b"], key["a"], entries["n"], band, entries["token"]))
    entries, key, band = entries[order], key[order], band[order]
    fresh = np.ones(len(entries), bool)
    same_token = entries["token"][1:] == entries["token"][:-1]
    fresh[1:] = ~(same_token & (key["a"][1:] == key["a"][:-1]) & (key["b"][1:] == key["b"][:-1]))
    entries, band = entries[fresh], band[fresh]
    new = np.ones(len(entries), bool)
    new[1:] = entries["token"][1:] != entries["token"][:-1]
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1
    entries, band, group = entries[several], band[several], group[several]
    if not len(entries):
        return
    head = np.ones(len(entries), bool)
    head[1:] = (group[1:] != group[:-1]) | (band[1:] != band[:-1])
    leader = np.flatnonzero(head)[np.cumsum(head) - 1]
    step = 50_000
    for at in range(0, len(entries), step):
        part, lead = entries[at : at + step], entries[leader[at : at + step]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(signed(part["token"])), _key_column(part["key"]), pa.array(part["n"].astype(np.int64)),
                pa.array(part["place"].astype(np.int32)), _key_column(lead["key"]), pa.array(lead["n"].astype(np.int64)),
                pa.array(lead["place"].astype(np.int32)),
            ],
            names=["token", "key", "n", "place", "leader", "leader_n", "leader_place"],
        )


def _compare(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Overlap of the sets of each pair (left, right).

    The members of a left class are dealt over cells of about STAR, each with a
    copy of the left set; a cell is read as a stream, one set at a time.
    """
    sets = sets.select("key", "values")
    spread = pairs.groupBy("left").agg(F.ceil(F.count("*") / F.lit(STAR)).cast("int").alias("cells"))
    members = (
        pairs.join(spread, "left").withColumn("cell", F.pmod(F.xxhash64("right"), F.col("cells")).cast("int"))
        .join(sets.withColumnRenamed("key", "right"), "right").select("left", "cell", F.lit(1).alias("role"), "right", "values")
    )
    heads = (
        spread.join(sets.withColumnRenamed("key", "left"), "left")
        .select("left", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(0).alias("role"), F.col("left").alias("right"), "values")
    )
    parts = shuffle_partitions(pairs.sparkSession)
    dealt = heads.unionByName(members).repartition(parts, "left", "cell").sortWithinPartitions("left", "cell", "role")

    def measure(batches):
        head = None
        for batch in batches:
            out: list[tuple] = []
            for left, role, right, body in zip(*(batch.column(i) for i in (0, 2, 3, 4))):
                values = np.cumsum(unpack(body.as_py(), 1)[0], dtype=np.uint64)
                if role.as_py() == 0:
                    head = values
                else:
                    at = np.minimum(np.searchsorted(head, values), len(head) - 1)
                    out.append((left.as_py(), right.as_py(), len(head), len(values), int((head[at] == values).sum())))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[2:])],
                    names=["left", "right", "left_n", "right_n", "shared"],
                )

    measured = dealt.mapInArrow(measure, "left binary, right binary, left_n long, right_n long, shared long")
    similar = F.col("shared") * (rule.above + rule.below) >= rule.above * (F.col("left_n") + F.col("right_n"))
    return measured.withColumn("linked", similar)


def _open_pairs(
    near: DataFrame, sets: DataFrame, roots: DataFrame, answers: DataFrame, rule: Rule, forest: bool
) -> DataFrame:
    """Pairs of classes of one list and two components that the leaders' answers and sketches leave open, or link.

    A list of one component is skipped whole. In others the rows of the largest
    component meet only the other rows; cells hold about CELL rows of each side.
    """
    placed = near.join(roots, F.col("key") == F.col("node"), "left").select(
        "token", "key", "n", "place", "leader", "leader_n", F.coalesce("root", "key").alias("root")
    )
    sizes = placed.groupBy("token", "root").agg(F.count("*").alias("rows"))
    lists = sizes.groupBy("token").agg(
        F.sum("rows").alias("rows"), F.max("rows").alias("most"), F.max_by("root", F.struct("rows", "root")).alias("main"), F.count("*").alias("roots")
    ).where("roots > 1").drop("roots")
    known = answers.select(F.col("left").alias("leader"), F.col("right").alias("key"), "shared")
    open_rows = placed.join(lists, "token").join(known, ["leader", "key"], "left").withColumn(
        "shared", F.when(F.col("leader") == F.col("key"), F.col("n")).otherwise(F.coalesce("shared", F.lit(-1)))
    )
    a = F.ceil(F.col("most") / F.lit(CELL)).cast("int")
    b = F.ceil((F.col("rows") - F.col("most")) / F.lit(CELL)).cast("int")
    mine = F.pmod(F.xxhash64("key"), F.when(F.col("root") == F.col("main"), a).otherwise(b)).cast("int")

    def cell(i, j, kind):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))

    last_a, last_b = F.sequence(F.lit(0), a - 1), F.sequence(F.lit(0), b - 1)
    cells = (
        F.when(F.col("rows") <= CELL, F.array(cell(F.lit(0), F.lit(0), 0)))
        .when(F.col("root") == F.col("main"), F.transform(last_b, lambda j: cell(F.col("mine"), j, 1)))
        .otherwise(F.concat(
            F.transform(last_a, lambda i: cell(i, F.col("mine"), 1)),
            F.transform(last_b, lambda j: cell(F.least(F.col("mine"), j), F.greatest(F.col("mine"), j), 2)),
        ))
    )
    dealt = open_rows.join(sets.select("key", "sketch"), "key").withColumn("mine", mine).select(
        F.explode(cells).alias("cell"), "token", "key", "n", "place", "root", "leader", "leader_n", "shared", "sketch"
    ).select("token", "cell.*", "key", "n", "place", "root", "leader", "leader_n", "shared", "sketch")
    parts = shuffle_partitions(near.sparkSession)
    cell_key = ("token", "kind", "i", "j")
    dealt = dealt.repartition(parts, *cell_key).sortWithinPartitions(*cell_key, "n", "place", "key")
    pairs = dealt.mapInArrow(_cell_scan(rule, forest), "left binary, right binary, linked boolean")
    return pairs.groupBy("left", "right").agg(F.max("linked").alias("linked"))


def _cell_scan(rule: Rule, forest: bool):
    def scan(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            cuts = _cell_cuts(table)
            held = table.slice(cuts[-2])
            yield from _scan_cells(table.slice(0, cuts[-2]), cuts[:-1], rule, forest)
        if held is not None and held.num_rows:
            yield from _scan_cells(held, _cell_cuts(held), rule, forest)

    return scan


def _cell_cuts(table: pa.Table) -> list[int]:
    """Where the cells of sorted rows start, and the end."""
    ids = np.stack([table.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
    starts = (np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist()
    return [0, *starts, len(ids)]


def _scan_cells(table: pa.Table, cuts: list[int], rule: Rule, forest: bool):
    """Pairs of whole cells, as one batch."""
    if table.num_rows < 2:
        return
    table = table.combine_chunks()
    keys, sketches = table.column("key").to_pylist(), table.column("sketch").to_pylist()
    sets = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("n", "place", "leader_n", "shared")])
    rank = np.empty(len(keys), np.int64)
    rank[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
    root, leader = (
        table.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("root", "leader")
    )
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        own = root[lo:hi]
        if hi - lo > 1 and (own != own[0]).any():
            i, j, linked = _cell_pairs(rank[lo:hi], sketches[lo:hi], sets[:, lo:hi], own, leader[lo:hi], rule, forest)
            if len(i):
                found.append((i + lo, j + lo, linked))
    if found:
        i, j, linked = (np.concatenate(c) for c in zip(*found))
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[k] for k in i], pa.binary()), pa.array([keys[k] for k in j], pa.binary()), pa.array(linked)],
            names=["left", "right", "linked"],
        )


def _cell_pairs(rank, sketches, sets, root, leader, rule: Rule, forest: bool):
    """Open and derived pairs of one cell, whose rows are in order of size and place, a block of rows against another.

    Two blocks are skipped whole when the sizes and places of their rows leave no pair enough tokens.
    Derived links are told by a forest of them, and pairs that it connects are
    open no more. With `forest` the open ones are cut to a forest as well, of pairs
    with the nearest sketches: the fewest that could connect the cell.
    """
    n, place, leader_n, shared = sets
    parts: list[tuple] = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))]
    begins = np.arange(0, len(rank), BLOCK)
    smallest, largest = n[begins], n[np.minimum(begins + BLOCK, len(rank)) - 1]
    room = np.maximum.reduceat(n - place, begins)
    for a, at in enumerate(begins):
        rows = slice(at, at + BLOCK)
        for b in range(a, len(begins)):
            fewest = rule.needed(smallest[a], smallest[b])
            if min(largest[a], largest[b], room[a], room[b]) < fewest or min(largest[a], room[a]) < -(-rule.above * smallest[b] // rule.below):
                continue
            columns = slice(begins[b], begins[b] + BLOCK)
            need = rule.needed(n[rows, None], n[None, columns])
            rest = np.minimum(n[rows, None] - place[rows, None], n[None, columns] - place[None, columns])
            wide = (root[rows, None] != root[None, columns]) & (np.minimum(n[rows, None], n[None, columns]) >= need) & (rest >= need)
            i, j = np.nonzero(wide)
            need, i, j = need[i, j], i + at, j + begins[b]
            upper = i < j
            i, j, need = i[upper], j[upper], need[upper]
            i, j = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)
            told = (leader[i] == leader[j]) & (shared[i] >= 0) & (shared[j] >= 0)
            most = np.minimum(shared[i], shared[j]) + np.minimum(n[i] - shared[i], n[j] - shared[j])
            linked = told & (shared[i] + shared[j] - leader_n[j] >= need)
            apart = _bits_apart(sketches, i, j) if len(i) else np.zeros(0, np.int64)
            keep = linked | ((~told | (most >= need)) & (apart <= n[i] + n[j] - 2 * need))
            parts.append((i[keep], j[keep], linked[keep], apart[keep]))
    i, j, linked, apart = (np.concatenate(c) for c in zip(*parts))
    if not len(i):
        return i, j, linked
    joined = {r: r for r in np.unique(root).tolist()}

    def find(r: int) -> int:
        while joined[r] != r:
            joined[r] = joined[joined[r]]
            r = joined[r]
        return r

    keep = np.zeros(len(i), bool)
    for at in np.lexsort((apart, ~linked)).tolist():
        a, b = find(int(root[i[at]])), find(int(root[j[at]]))
        if a != b:
            keep[at] = True
            if linked[at] or forest:
                joined[a] = b
    return i[keep], j[keep], linked[keep]


def jaccard_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of every row.

    component_id is the smallest doc_id reachable by links (similarity at least
    the rule's), class_id the smallest with the same set. A null text, or one
    without words, has no shingle and is linked with nothing but itself. Rows
    without doc_id are returned with null ids and link nothing. Repeated rows
    are all returned; rows of one id with different texts are judged one by one
    and share the id.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    try:
        table = scratch.write(_encoded(docs.select("doc_id", "text"), rule), "runs")
        zipped = F.explode(F.arrays_zip("doc_ids", "sizes", "keys")).alias("row")
        features = table.select(zipped).select(F.col("row.doc_ids").alias("doc_id"), F.col("row.sizes").alias("n"), F.col("row.keys").alias("key"))
        features = scratch.write(features, "features")
        ids = scratch.write(_component_ids(table, features, rule, scratch), "ids")
    except BaseException:
        scratch.keep()
        raise
    scratch.keep("features", "ids")
    linked = features.where("doc_id is not null and n > 0").join(ids, "key").select("doc_id", "n", "component_id", "class_id")
    alone = features.where("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")


def _component_ids(table: DataFrame, features: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """key, class_id and component_id of every class."""
    classes = features.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("class_id"))
    candidates = scratch.write(_candidates(table, rule, scratch), "candidates")
    scratch.release("runs", "totals")
    near = scratch.write(_lists(candidates, rule), "near")
    sets = candidates.where("key is not null").groupBy("key").agg(F.first("values").alias("values"), F.first("sketch").alias("sketch"))
    sets = scratch.write(sets, "sets")
    scratch.release("candidates")

    need = F.ceil(rule.above * (F.col("n") + F.col("leader_n")) / F.lit(rule.above + rule.below))
    rest = F.least(F.col("n") - F.col("place"), F.col("leader_n") - F.col("leader_place"))
    stars = near.where((F.col("leader") != F.col("key")) & (rest >= need) & (F.least("n", "leader_n") >= need))
    first = scratch.write(stars.select(F.col("leader").alias("left"), F.col("key").alias("right")).distinct(), "first")
    told = scratch.write(_compare(first, sets, rule), "answers")
    edges = told.where("linked").select(F.col("left").alias("u"), F.col("right").alias("v"))
    roots = scratch.write(components(edges, scratch, "first-stars"), "first-roots")

    asked = told.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"))
    # Pairs that could connect the lists come first; after their links few lists are still open, and those are searched whole.
    for turn, forest in (("second", True), ("third", False)):
        found = scratch.write(_open_pairs(near, sets, roots, told, rule, forest), turn)
        open_pairs = scratch.write(
            found.where("not linked").select("left", "right").join(asked, ["left", "right"], "left_anti"), f"{turn}-open"
        )
        verified = scratch.write(_compare(open_pairs, sets, rule), f"{turn}-answers")
        late = verified.where("linked").select(F.col("left").alias("u"), F.col("right").alias("v"))
        late = scratch.write(late.union(found.where("linked").select(F.col("left").alias("u"), F.col("right").alias("v"))), f"{turn}-late")
        asked = asked.union(open_pairs)
        if not late.isEmpty():
            edges = edges.union(late)
            roots = scratch.write(components(edges, scratch, f"{turn}-stars"), f"{turn}-roots")
    named = classes.join(roots, F.col("key") == F.col("node"), "left").select("key", "class_id", F.coalesce("root", "key").alias("root"))
    # most classes are alone; only those with a root are grouped
    several = named.where(F.col("root") != F.col("key")).select("root").distinct()
    least = named.join(several, "root", "left_semi").groupBy("root").agg(F.min("class_id").alias("component_id"))
    return named.join(least, "root", "left").select("key", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """`docs` rows, one of each component: that of the smallest doc_id. Rows without words or id all stay.

    Rows of one id (repeated ones, say) stay together.
    """
    found = jaccard_components(docs, rule).where("doc_id <> component_id").select(F.col("doc_id").alias("__later")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("__later"), "left_anti")
