"""Repeated runs of lines, found by a distributed suffix array over line ids.

Every document is the sequence of its lines with words. Prefix doubling names
the runs of 1, 2, 4, ... lines that start at each place, in sorted order, from
the names of their halves; places of one name form an interval of the suffix
array whose common prefix has that length. A run counts as repeated when its
first lines, as many as hold MIN_WORDS words, share such an interval with an
earlier place. It is then followed line by line to the end of the common prefix
with an earlier place, as long as no run that starts one line later reaches as
far with MIN_WORDS words of its own; so all lines of the maximal repeated runs
are met, and all but the first copies are deleted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.scratch import Scratch
from postmill.llm.textkit import hashes, mix, owners, runs, signed

#: Words that a run of lines has at least.
MIN_WORDS = 10
#: Runs whose names stand in more places than this are compared in PARTS parts first.
COMMON, PARTS = 1000, 64
#: A text, among rows of one id.
ROW = ["doc_id", "t"]
PLACE = [*ROW, "pos"]
#: What tells a run of lines.
RUN = ["need", "x", "y", "further", "chain"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__t", F.xxhash64("text"))


def _chains(line: np.ndarray, size: np.ndarray, after: np.ndarray, more: np.ndarray) -> pa.ListArray:
    """Hashes of the first 1, 2, ... `more` lines from `after` on, of each place."""
    offsets = np.concatenate([[0], np.cumsum(more)])
    out, chain = np.zeros(offsets[-1], np.uint64), np.zeros(len(more), np.uint64)
    for k in range(more.max(initial=0)):
        on = np.flatnonzero(more > k)
        at = after[on] + k
        chain[on] = mix(mix(chain[on] + line[at]) + size[at].astype(np.uint64))
        out[offsets[on] + k] = chain[on]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(signed(out)))


def lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines with words: their place among those of the document, 64-bit hash and length, `need`, the number
    of lines from there on that hold `min_words` words (null if the rest holds fewer), and `more`, a hash for each
    further line of all lines after the `need` ones up to it, while those after the place's own hold fewer words."""

    def split(batches):
        for batch, texts in runs(batches, "text"):
            word_starts, _, _ = texts.words()
            starts, ends, offsets = texts.lines()
            before, upto = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
            spoken = upto > before
            text = owners(offsets)[spoken]
            starts, ends, before, upto = starts[spoken], ends[spoken], before[spoken], upto[spoken]
            if not len(text):
                continue
            cuts = np.searchsorted(text, np.arange(len(texts) + 1))
            last = cuts[text + 1] - 1
            reach = np.searchsorted(upto, before + min_words)
            at = np.arange(len(text))
            need = np.where(reach <= last, reach - at + 1, 0)
            stop = np.minimum(np.searchsorted(upto, upto + min_words), last + 1)
            more = np.where(need > 0, np.maximum(stop - at - need, 0), 0)
            line, size = hashes(texts.sums(), starts, ends), ends - starts
            whole = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(whole), batch.column(1).take(whole), pa.array((at - cuts[text]).astype(np.int32)),
                    pa.array(need.astype(np.int32), mask=need == 0), pa.array(signed(line)), pa.array(size.astype(np.int32)),
                    _chains(line, size, at + need, more),
                ],
                names=[*PLACE, "need", "line", "size", "more"],
            )

    rows = _keyed(docs).where("doc_id is not null and text is not null").select("doc_id", F.col("__t").alias("t"), "text")
    return rows.mapInArrow(split, "doc_id long, t long, pos int, need int, line long, size int, more array<long>")


def _named(pairs: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """`pairs` whose (x, y) occurs more than once, with `name`: whole numbers in the order of (x, y), and `n`, how often it occurs."""
    several = pairs.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1")
    names = scratch.write(several.orderBy("x", "y").withColumn("name", F.monotonically_increasing_id()), f"names-{label}")
    return pairs.drop("n").join(names, ["x", "y"]).drop("x", "y")


def _ahead(places: DataFrame, steps) -> DataFrame:
    """`places` with the name `steps` lines on as `y`; places without one there are left out."""
    there = places.select("doc_id", "t", F.col("pos").alias("at"), F.col("name").alias("y"))
    return places.withColumn("at", F.col("pos") + steps).join(there, [*ROW, "at"]).drop("at")


def _later(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Places of `found` whose run also starts at an earlier one.

    A run is in no more places than `among`, the count of its rarer half. Runs
    that may be common have a first place in each of PARTS parts, and the least of
    those goes back to the parts, so that no task gets all places of a run.
    """
    place = F.struct(*PLACE)
    rare = found.where(F.col("among") <= COMMON)
    first = rare.groupBy(*RUN).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    common = found.where(F.col("among") > COMMON).withColumn("part", F.pmod(F.xxhash64(*PLACE), F.lit(PARTS)))
    parts = scratch.write(common.groupBy(*RUN, "part").agg(F.min(place).alias("first")), "parts")
    firsts = parts.select(*RUN, "part").join(parts.groupBy(*RUN).agg(F.min("first").alias("first")), RUN)
    both = rare.join(first, RUN).unionByName(common.join(firsts, [*RUN, "part"]).drop("part"))
    return both.where(place > F.col("first"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, t, pos, need): places whose run of `need` lines, `min_words` words or more, also starts at an earlier place.

    Each place comes with the shortest such run and with the longer ones that no
    run from the next place reaches the end of; together they cover the maximal ones. Earlier is a smaller doc_id, or a smaller place of the same text. Doubling ends
    when no place needs longer names: a run has a word in each line, so names of
    `min_words` lines are the longest. Names that occur once are dropped at once.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    singles = lines(docs, min_words).withColumnRenamed("line", "x").withColumnRenamed("size", "y")
    places = scratch.write(_named(singles, scratch, "1").distinct(), "places-1")
    found = places.where("need = 1").select(*PLACE, "need", "more", F.col("name").alias("x"), F.col("name").alias("y"), F.col("n").alias("among"))
    length = 1
    while places.where(F.col("need") > length).limit(1).count():
        inner = places.where((F.col("need") > length) & (F.col("need") <= 2 * length))
        there = places.select("doc_id", "t", F.col("pos").alias("at"), F.col("name").alias("y"), F.col("n").alias("m"))
        ends = inner.withColumn("at", F.col("pos") + F.col("need") - length).join(there, [*ROW, "at"])
        found = found.unionByName(ends.select(*PLACE, "need", "more", F.col("name").alias("x"), "y", F.least("n", "m").alias("among")))
        if not places.where(F.col("need") > 2 * length).limit(1).count():
            break
        doubled = _ahead(places, length).withColumnRenamed("name", "x")
        length *= 2
        places = scratch.write(_named(doubled, scratch, str(length)), f"places-{length}")
    found = scratch.write(found, "found")
    reach = F.posexplode(F.concat(F.array(F.lit(0).cast("long")), "more")).alias("further", "chain")
    found = found.select(*PLACE, "need", "x", "y", "among", reach)
    return _later(found, scratch).select(*PLACE, (F.col("need") + F.col("further")).alias("need"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, prefix: str = "") -> DataFrame:
    """`docs` with every text rid of its repeated lines, and n_lines, n_removed_lines (lines with words), named with `prefix`.

    Blank lines stay; a text may become empty. Rows without id or text are
    returned as they are, with no lines counted. Equal rows are one document; rows
    of one id with other texts come in order of a hash of theirs. Extra columns stay.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    marks = repeated_runs(docs, min_words, scratch).groupBy("doc_id", "t").agg(F.collect_list(F.struct("pos", "need")).alias("__marks"))
    marks = scratch.write(marks.withColumnsRenamed({"doc_id": "__doc", "t": "__u"}), "marks")
    keyed = _keyed(docs)
    same = (F.col("doc_id") == F.col("__doc")) & (F.col("__t") == F.col("__u"))
    joined = keyed.join(marks, same, "left").drop("__t", "__u", "__doc")
    names = docs.columns
    at = names.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def rebuild(batches):
        for batch, texts in runs(batches, "text"):
            out, counts, removed = [], [], []
            for text, doc, marks in zip(batch.column(at).to_pylist(), batch.column(names.index("doc_id")).to_pylist(), batch.column(len(names)).to_pylist()):
                if text is None or doc is None:
                    out.append(text)
                    counts.append(0)
                    removed.append(0)
                    continue
                parts = text.split("\n")
                spoken = [i for i, part in enumerate(parts) if part.strip(" \t\n\r\x0b\x0c")]
                gone = {spoken[k] for mark in marks or () for k in range(mark["pos"], mark["pos"] + mark["need"])}
                out.append("\n".join(part for i, part in enumerate(parts) if i not in gone) if gone else text)
                counts.append(len(spoken))
                removed.append(len(gone))
            columns = [batch.column(i) if i != at else pa.array(out, pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*names, f"{prefix}n_lines", f"{prefix}n_removed_lines"])

    return joined.mapInArrow(rebuild, f"{fields}, {prefix}n_lines long, {prefix}n_removed_lines long")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed_lines and kept_sha256 of every document."""
    cleaned = without_repeats(docs.select("doc_id", "text"), min_words)
    return cleaned.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
