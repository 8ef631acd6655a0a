"""Mixing to target weights: iterative proportional fitting of token weights.

Tokens are counted by cell (source, language, topic). Raking scales the cells
until their sums meet the targets of each source, language and topic; documents
are then sampled by the probabilities that give those sums. No cell gives more
than its tokens; sums that cannot be met are told by `marginals` and logged.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.scratch import Scratch

DIMENSIONS = ("source", "lang", "topic")
#: Share of all tokens that the sample is to hold.
BUDGET = 0.6
#: Targets are the shares of what is there to this power, so that rare values gain.
TEMPER = 0.7
TOLERANCE = 1e-3
#: Rounds that must bring the worst sum nearer by a hundredth at least.
PATIENCE = 10
#: Steps of an octave in which ratios are counted when a scale is sought, and the octaves.
STEPS, LOWEST, HIGHEST = 512, -20, 40
#: Topics are told by this many words, of some letters, that stand in this share of the documents at most (and in two at least).
TOPICS, LETTERS, TOPIC_SHARE = 24, 4, 0.05
#: Rounds of raking that are planned together and written as one table.
STRIDE = 3
#: Goals that are named in a message.
LOGGED = 20

log = logging.getLogger(__name__)


def topic_words(docs: DataFrame, share: float = TOPIC_SHARE) -> list[str]:
    """The words that tell topics, learnt from all of `docs`: the most widespread of those that are not general.

    A word counts once for each document; one that stands in more than `share` of the documents tells no topic.
    Words are runs of letters and other signs between blanks, as they are written. Ties go to the lesser word.
    """
    most = max(2.0, share * docs.count())
    told = docs.select(F.explode(F.array_distinct(F.split("text", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    told = told.where((F.col("n") >= 2) & (F.col("n") <= most) & F.col("word").rlike(f"^\\p{{L}}{{{LETTERS},}}$"))
    return [row.word for row in told.orderBy(F.desc("n"), "word").limit(TOPICS).collect()]


def topic(text: Column, told: list[str]) -> Column:
    """The first word of `told` that a text holds; 'other' without one, 'empty' for a null or empty text."""
    kind = F.when(text.isNull() | (text == ""), "empty")
    for word in told:
        kind = kind.when(F.contains(text, F.lit(word)), word)
    return kind.otherwise("other")


def with_topics(docs: DataFrame) -> DataFrame:
    """`docs` with `__topic`: its column `topic` where it has one ('' for null), else told by words learnt from it."""
    if "__topic" in docs.columns:
        return docs
    if "topic" in docs.columns:
        return docs.withColumn("__topic", F.coalesce(F.col("topic").cast("string"), F.lit("")))
    return docs.withColumn("__topic", topic(F.col("text"), topic_words(docs)))


def n_tokens(text: Column) -> Column:
    """Words of a text, runs without ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _named(docs: DataFrame) -> list[Column]:
    return [F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("__topic").alias("topic")]


def cells(docs: DataFrame) -> DataFrame:
    """Tokens of each cell of source, language and topic."""
    docs = with_topics(docs)
    return docs.select(*_named(docs), n_tokens(F.col("text")).alias("n")).groupBy(*DIMENSIONS).agg(F.sum("n").alias("n"))


def sides(table: DataFrame) -> DataFrame:
    """dimension, value and tokens of every value of every dimension."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS))).alias("side")
    return table.select(each, "n").groupBy("side.dimension", "side.value").agg(F.sum("n").alias("n"))


def _targets(table: DataFrame, dimension: str, total: float, temper: float) -> DataFrame:
    """Tempered shares of a dimension's values, that add up to `total`."""
    raised = table.groupBy(dimension).agg(F.pow(F.sum("n").cast("double"), F.lit(temper)).alias("goal"))
    norm = raised.agg(F.sum("goal").alias("norm")).first().norm or 1.0
    return raised.select(dimension, (F.col("goal") * F.lit(total / norm)).alias("goal"))


def _reachable(held: DataFrame, total: float) -> DataFrame:
    """Goals of `held` (dimension, value, n, goal) that add up to `total`, none over its tokens.

    The values of a dimension share what others lack, in proportion.
    """
    sums = {r.dimension: r for r in held.groupBy("dimension").agg(
        F.max(F.col("goal") > F.col("n")).alias("over"), F.sum("n").cast("double").alias("n"), F.sum("goal").alias("goal")
    ).collect()}
    scales = _scales(held, F.col("dimension"), F.col("goal"), F.col("n").cast("double"), {d: min(total, r.n) for d, r in sums.items()})
    scale = F.lit(1.0)
    for dimension, row in sums.items():
        if row.goal and (row.over or abs(row.goal - total) > TOLERANCE * TOLERANCE * total):
            scale = F.when(F.col("dimension") == dimension, scales[dimension]).otherwise(scale)
    return held.select("dimension", "value", F.least(F.col("n").cast("double"), F.col("goal") * scale).alias("goal"))


def _rounds(current: DataFrame, dimensions: list[str], count: int, bounded: bool) -> DataFrame:
    """`count` rounds over cells that carry the goals of their values; `__off` is the worst sum of the last round before it is scaled."""
    for turn in range(count):
        for place, dimension in enumerate(dimensions):
            value = Window.partitionBy(dimension)
            full = F.lit(bounded) & (F.col("weight") >= F.col("n"))
            n, goal = F.col("n").cast("double"), F.col(f"__goal_{dimension}")
            current = current.withColumns({
                "__full": F.sum(F.when(full, n).otherwise(0.0)).over(value), "__free": F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).over(value),
            })
            have = F.col("__full") + F.col("__free")
            factor = (
                F.when((have < goal) & (F.col("__free") > 0), (goal - F.col("__full")) / F.col("__free"))
                .when(have < goal, 1.0).when(have > 0, goal / have).otherwise(0.0)
            )
            off = F.when(goal > 0, F.abs(have / goal - 1)).otherwise(0.0)
            current = current.withColumns({
                "weight": F.col("weight") * factor, "__off": off if place == 0 else F.greatest("__off", off),
            }).drop("__full", "__free")
    return current


def rake(table: DataFrame, goals: dict[str, DataFrame], scratch: Scratch, rounds: int | None = None, tolerance: float = TOLERANCE, bounded: bool = False) -> DataFrame:
    """`table` (cells with n) with `weight`, whose sums meet `goals` of every dimension; if `bounded`, the sums of least(n, weight).

    The cells of a value meet for its sum: one for each combination of the other dimensions' values, however many documents they
    stand for. STRIDE rounds are one written table; no cells are gathered. If bounded, a cell whose
    weight is n or more counts as n, and the others of its value share what is missing. Rounds
    end when no sum is off by more than `tolerance` of its goal, or when the worst
    one came no nearer for PATIENCE rounds, as where goals contradict each other.
    """
    current = table.withColumn("weight", F.col("n").cast("double"))
    for dimension, goal in goals.items():
        current = current.join(goal.select(dimension, F.col("goal").alias(f"__goal_{dimension}")), dimension)
    current = scratch.write(current, "round-0")
    worst: list[float] = []
    done = 0
    while rounds is None or done < rounds:
        count = STRIDE if rounds is None else min(STRIDE, rounds - done)
        following = scratch.write(_rounds(current, list(goals), count, bounded), f"round-{done + count}")
        scratch.release(f"round-{done}")
        done += count
        worst.append(following.where("n > 0").agg(F.max("__off").alias("off")).first().off or 0.0)
        current = following.drop("__off")
        patience = -(-PATIENCE // STRIDE)
        if worst[-1] <= tolerance or len(worst) > patience and min(worst[-patience:]) > 0.99 * min(worst[:-patience]):
            break
    return current.select(*DIMENSIONS, "n", "weight")


def _scales(table: DataFrame, group: Column, value: Column, bound: Column, totals: dict[str, float]) -> dict[str, float]:
    """For each group the factor of `value`, none over `bound`, at which they add up to its total.

    Rows are counted by the factor at which they reach their bound, in steps of a fraction of an octave: one row for each
    step comes back. Between two steps the sum is as good as straight.
    """
    usable = table.select(group.alias("group"), value.alias("value"), bound.alias("bound")).where("value > 0 and bound > 0")
    value, bound = F.col("value"), F.col("bound")
    step = F.greatest(F.lit(LOWEST * STEPS), F.least(F.lit(HIGHEST * STEPS), F.floor(F.log2(bound / value) * STEPS).cast("long")))
    rows = usable.groupBy("group", step.alias("step")).agg(F.sum("bound").alias("bound"), F.sum("value").alias("value")).collect()
    out = {}
    for group, total in totals.items():
        mine = sorted((r.step, r.bound, r.value) for r in rows if r.group == group)
        full, free, scale = 0.0, sum(v for _, _, v in mine), 2.0**HIGHEST
        for at, bounds, values in mine:
            low, high = 2.0 ** (at / STEPS), 2.0 ** ((at + 1) / STEPS)
            below, above = full + low * free, full + bounds + high * (free - values)
            if above >= total * (1 - 1e-12):
                # the sum may have reached the total where all rows were still free
                scale = total / free if not full and below >= total else low + (high - low) * max(total - below, 0.0) / max(above - below, 1e-300)
                if below > total and full:
                    scale = (total - full) / free
                break
            full, free = full + bounds, free - values
        out[group] = scale
    return out


def calibrate(table: DataFrame, total: float) -> DataFrame:
    """`table` with `probability`: weights a token, scaled so that `total` tokens are expected; none over 1."""
    scale = _scales(table, F.lit("all"), F.col("weight"), F.col("n").cast("double"), {"all": total})["all"]
    chance = F.least(F.lit(1.0), F.col("weight") * F.lit(scale) / F.col("n"))
    return table.select(*DIMENSIONS, F.when(F.col("n") > 0, chance).otherwise(F.lit(1.0)).alias("probability"))


def marginals(table: DataFrame, goals: dict[str, DataFrame], chances: DataFrame, tolerance: float = 2 * TOLERANCE) -> DataFrame:
    """dimension, value, n, goal and expected tokens of every value of `goals`, and whether it is `met`."""
    both = table.join(chances, list(DIMENSIONS))
    out = None
    for dimension, goal in goals.items():
        sums = both.groupBy(dimension).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("probability")).alias("expected"))
        rows = goal.join(sums, dimension, "left").select(
            F.lit(dimension).alias("dimension"), F.col(dimension).alias("value"), F.coalesce("n", F.lit(0)).alias("n"),
            "goal", F.coalesce("expected", F.lit(0.0)).alias("expected"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("met", F.abs(F.col("expected") - F.col("goal")) <= F.col("goal") * F.lit(tolerance))


def probabilities(docs: DataFrame, budget: float = BUDGET, temper: float = TEMPER, goals: dict[str, DataFrame] | None = None) -> DataFrame:
    """Probability of each cell. `goals` (value, goal in tokens) by dimension replace the tempered shares.

    What a value lacks for its goal goes to the others of its dimension. Goals
    that are not met are logged with their number and the furthest ones.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    try:
        table = scratch.write(cells(docs), "cells")
        values = scratch.write(sides(table), "sides")
        raised = F.pow(F.col("n").cast("double"), F.lit(temper))
        norms = {r.dimension: r for r in values.groupBy("dimension").agg(F.sum("n").alias("n"), F.sum(raised).alias("norm")).collect()}
        total = budget * float(norms["source"].n if norms else 0)
        wanted = {}
        for d in DIMENSIONS:
            share = raised * F.lit(total / (norms[d].norm or 1.0) if norms else 0.0)
            tempered = values.where(F.col("dimension") == d).select(F.col("value").alias(d), share.alias("goal"))
            wanted[d] = (goals or {}).get(d, tempered)
        both = None
        for d, goal in wanted.items():
            mine = values.where(F.col("dimension") == d).join(goal.select(F.col(d).alias("value"), "goal"), "value").select("dimension", "value", "n", "goal")
            both = mine if both is None else both.unionByName(mine)
        within = scratch.write(_reachable(scratch.write(both, "goals"), total), "within")
        within = {d: within.where(F.col("dimension") == d).select(F.col("value").alias(d), "goal") for d in DIMENSIONS}
        chances = scratch.write(calibrate(rake(table, within, scratch, bounded=True), total), "probabilities")
        missed = scratch.write(marginals(table, wanted, chances).where("not met"), "missed")
        count = missed.count()
        if count:
            furthest = missed.orderBy(F.abs(F.col("expected") - F.col("goal")).desc()).limit(LOGGED).collect()
            told = "; ".join(f"{r.dimension} {r.value!r}: {r.expected:.0f} of {r.goal:.0f}, has {r.n}" for r in furthest)
            log.warning("%d goals of the mix are not met, furthest (expected tokens): %s", count, told)
    finally:
        scratch.keep("probabilities")
    return chances


def uniform(seed: int = 0) -> Column:
    """A number in [0, 1) of each row, the same in every run."""
    bits = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed))
    return F.shiftrightunsigned(bits, 11).cast("double") / F.lit(float(1 << 53))


def mixed(docs: DataFrame, table: DataFrame, seed: int = 0) -> DataFrame:
    """`docs` with topic, probability and kept (a fixed draw against it).

    Null sources and languages are values of their own, written as ''. Texts
    without tokens cost nothing and stay. Repeated rows share one draw.
    """
    names = [f"__{d}" for d in DIMENSIONS]
    docs = with_topics(docs)
    rest = [name for name in docs.columns if name != "__topic"]
    keyed = docs.select(*rest, *(column.alias(name) for column, name in zip(_named(docs), names)))
    chances = table.select(*(F.col(d).alias(n) for d, n in zip(DIMENSIONS, names)), F.col("probability").alias("__probability"))
    joined = keyed.join(chances, names)
    return joined.withColumn("__kept", uniform(seed) < F.col("__probability"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, cell, probability and draw of every document; repeated rows are all told, with one draw. Of several topic words the most widespread counts."""
    docs = with_topics(docs.select("doc_id", "text", *DIMENSIONS[:2], *(["topic"] if "topic" in docs.columns else [])))
    out = mixed(docs, probabilities(docs))
    return out.select(
        "doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"),
        F.round("__probability", 6).alias("probability"), F.col("__kept").alias("kept"),
    )


def sample(docs: DataFrame) -> DataFrame:
    """The documents drawn, with all their columns. Repeated rows are drawn or left together; texts without tokens all stay."""
    named = with_topics(docs)
    return mixed(named, probabilities(named)).where("__kept").select(*docs.columns)
