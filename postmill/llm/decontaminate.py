"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity.

A window of a document is as many shingles long as the benchmark item it is held
against. Windows are formed where a document has enough of an item's shingles in
reach; their fingerprints must share a block with the item's and lie within
the radius; the weighted shingle similarity then decides. Everything is Spark
expressions over arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.binding import let
from postmill.llm.scratch import Scratch

SHINGLE = 5
SIMILARITY = 0.8
#: Bits that fingerprints may differ in. A pair of similarity 0.8 differs in 8 to 12 on average and is lost with
#: a chance of 0.00001 at most; 0.00012 where a text has four of an item's five shingles and no more.
RADIUS = 24
#: Fingerprints within the radius agree in one of RADIUS + 1 blocks at least.
BLOCKS = RADIUS + 1
#: Rows of a side that is broadcast, at most; beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Lower-case words, runs without ASCII white space."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\r\x0b\x0c"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def text_hashes(text: Column, size: int) -> Column:
    """Shingle hashes of a text; its words are split once."""
    return let(words(text), lambda w: shingle_hashes(w, size))


def shingle_hashes(w: Column, size: int) -> Column:
    """Hash of each run of `size` words, in order; none where there are fewer words. `w` should be bound."""
    count = F.size(w) - size + 1
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))


def fingerprint(values: Column) -> Column:
    """64-bit SimHash of shingle hashes; a repeated shingle weighs as often as it occurs."""
    def made(bag: Column) -> Column:
        def bit(b: Column) -> Column:
            ones = F.size(F.filter(bag, lambda h: F.getbit(h, b) == 1))
            return F.when(2 * ones > F.size(bag), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))

        bits = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
        return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))

    return let(values, made)


def blocks(print64: Column) -> Column:
    """The bits of each block, marked with the block's number."""
    cuts = [round(64 * k / BLOCKS) for k in range(BLOCKS + 1)]
    return F.array(*(
        F.shiftrightunsigned(print64, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) + F.lit(16 * k)
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))
    ))


def overlap(left: Column, right: Column) -> Column:
    """Size of the intersection of two bags of hashes."""
    def count(bag: Column, h: Column) -> Column:
        return F.size(F.filter(bag, lambda x: x == h))

    def both(pair: Column) -> Column:
        common = F.array_intersect(pair.l, pair.r)
        return F.aggregate(common, F.lit(0), lambda acc, h: acc + F.least(count(pair.l, h), count(pair.r, h)))

    return let(F.struct(left.alias("l"), right.alias("r")), both)


def _needed(n: Column) -> Column:
    """Least overlap of two bags of n shingles for the similarity; a smaller other bag needs no less than 0.8 n."""
    return F.ceil(F.lit(2 * SIMILARITY / (1 + SIMILARITY)) * n - F.lit(1e-9)).cast("int")


def item_shingles(benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """Items with their shingle size (five words, or all of a shorter item), hashes and rarest probes."""
    base = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).dropDuplicates()
    base = base.withColumn("k", F.least(F.size("w"), F.lit(SHINGLE)))
    hashed = F.coalesce(*(F.when(F.col("k") == k, let(F.col("w"), lambda w: shingle_hashes(w, k))) for k in range(1, SHINGLE + 1)))
    items = base.select("item_id", "k", hashed.alias("ih")).withColumn("n", F.size("ih"))
    # A bag that shares 0.8 n shingles misses 0.2 n at most: one of any n - 0.8 n + 1 is in it.
    least = F.ceil(F.lit(SIMILARITY) * F.col("n") - F.lit(1e-9)).cast("int")
    items = items.withColumn("probes", F.array_distinct(F.slice(F.array_sort("ih"), 1, F.col("n") - least + 1)))
    return scratch.write(items, "items")


def _sized(df: DataFrame) -> DataFrame:
    """Marked for broadcast only where its rows, counted, are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, hamming, similarity): the best window of each document for each item it leaks.

    Whole texts are searched. Null and empty texts and items have no shingle and
    match nothing; repeated rows give one result; a document shorter than an item
    is one window. Of equal windows the first is given. Benchmark items need ids.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    items = item_shingles(benchmark.where("item_id is not null"), scratch)
    sizes = [row.k for row in items.select("k").distinct().orderBy("k").collect()]
    found = [_leaks_of_size(docs, items.where(F.col("k") == k), k, scratch) for k in sizes]
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start int, hamming int, similarity double")
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _leaks_of_size(docs: DataFrame, items: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    probes = items.select("item_id", F.explode("probes").alias("h"))
    hashed = texts.select("doc_id", F.explode(text_hashes(F.col("text"), k)).alias("h"))
    hits = hashed.join(_sized(probes), "h").select("doc_id", "item_id").distinct()
    hits = scratch.write(hits, f"hits-{k}")
    near = hits.select("doc_id").distinct()
    near = texts.join(_sized(near), "doc_id", "left_semi").select("doc_id", text_hashes(F.col("text"), k).alias("h"))
    pairs = near.join(_sized(hits), "doc_id").join(_sized(items.select("item_id", "ih", "n")), "item_id")
    windows = pairs.select("doc_id", "item_id", "ih", "h", "n", F.explode(window_starts()).alias("start"))
    windows = windows.select(
        "doc_id", "item_id", "start", "ih", F.slice("h", F.col("start") + 1, F.col("n")).alias("window")
    )
    printed = windows.withColumn("wp", fingerprint(F.col("window"))).withColumn("ip", fingerprint(F.col("ih")))
    printed = printed.where(F.arrays_overlap(let(F.col("wp"), blocks), let(F.col("ip"), blocks)))
    near = printed.withColumn("hamming", F.bit_count(F.col("wp").bitwiseXOR(F.col("ip")))).where(F.col("hamming") <= RADIUS)
    shared = near.withColumn("shared", overlap(F.col("window"), F.col("ih")))
    union = F.size("window") + F.size("ih") - F.col("shared")
    scored = shared.select("doc_id", "item_id", "start", "hamming", (F.col("shared") / union).alias("similarity"))
    best = F.max_by(F.struct("start", "hamming", "similarity"), F.struct("similarity", -F.col("start"), -F.col("hamming")))
    best = scored.where(F.col("similarity") >= SIMILARITY - 1e-12).groupBy("doc_id", "item_id").agg(best.alias("b"))
    return best.select("doc_id", "item_id", "b.start", "b.hamming", "b.similarity")


def window_starts() -> Column:
    """Starts of windows of n shingles that hold enough of the item's shingles.

    A best window can be moved to start at one of the item's shingles, or to end
    with the text; so only those starts are tried.
    """
    size, n = F.size("h"), F.col("n")
    need = F.least(_needed(n), F.ceil(F.lit(SIMILARITY) * n - F.lit(1e-9)).cast("int"))
    at = F.filter(F.transform("h", lambda h, i: F.when(F.array_contains("ih", h), i)), lambda i: i.isNotNull())
    last = F.greatest(size - n, F.lit(0))

    def enough(places: Column) -> Column:
        return F.transform(
            places, lambda p, j: F.when(F.get(places, j + need - 1) <= F.least(p, last) + n - 1, F.least(p, last))
        )

    return F.array_distinct(F.filter(let(at, enough), lambda p: p.isNotNull()))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that leak an item."""
    leaking = leaks(docs, benchmark).select(F.col("doc_id").alias("__leaking")).distinct()
    return docs.join(leaking, F.col("doc_id") == F.col("__leaking"), "left_anti")
