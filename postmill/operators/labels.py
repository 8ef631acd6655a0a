"""Token labels (BIO) from labelled spans, entity features, entity scores.

Tagging is row-local array work: a document carries its own spans, so nothing
is shuffled and a long document stays inside its row.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import vocab
from postmill.functions.binding import let

_BLANKS = r"[\s\p{Z}\x1c-\x1f\x85]+"


def tokens(text: Column) -> Column:
    """Maximal runs of non-blank characters."""
    return F.filter(F.split(text, _BLANKS), lambda t: t != "")


def _is_given(text: Column) -> Column:
    return text.isNotNull() & (F.lower(text) != vocab.NOT_INFORMED) & (text != "")


def _span(text: Column, label: str) -> Column:
    return F.struct(F.trim(text).alias("text"), F.lit(label).alias("label"))


def spans(hard_skills: str, soft_skills: str, salary: str, level: str, contract_type: str) -> Column:
    """Labelled spans of one record in tagging order; blanks and "not informed" dropped."""
    nothing = F.array().cast("array<struct<text:string,label:string>>")

    def listed(name, label):
        text = F.when(F.lower(name) != "nan", F.col(name))
        return F.coalesce(F.transform(F.split(text, ","), lambda s: _span(s, label)), nothing)

    def single(name, label):
        return F.coalesce(F.when(_is_given(F.col(name)), F.array(_span(F.col(name), label))), nothing)

    everything = F.concat(
        listed(hard_skills, "HARD_SKILL"),
        listed(soft_skills, "SOFT_SKILL"),
        single(salary, "SALARY"),
        single(level, "NIVEL"),
        single(contract_type, "CONTRATO"),
    )
    return F.filter(everything, lambda s: _is_given(s["text"]))


def _span_tokens(span_list: Column) -> Column:
    return F.filter(
        F.transform(
            span_list,
            lambda s, i: F.struct(i.alias("ord"), tokens(F.lower(s["text"])).alias("words"), s["label"].alias("label")),
        ),
        lambda s: F.size(s["words"]) > 0,
    )


def span_hits(lowered: Column, span_list: Column) -> Column:
    """Every token run that equals a span: array of (ord, start, size, label), start from 0.

    Positions are first narrowed to tokens that open some span, so the work per
    document is one pass over its tokens plus a few comparisons.
    """

    def find(words):
        def matches(span, i):
            # word by word: `slice` would copy the whole document for every try
            first = F.get(words, i) == F.get(span["words"], F.lit(0))
            rest = F.forall(
                F.transform(span["words"], lambda w, j: F.coalesce(F.get(words, i + j) == w, F.lit(False))),
                lambda same: same,
            )
            return first & ((F.size(span["words"]) == 1) | rest)

        def of_spans(parts, starts):
            def of_span(span):
                return F.transform(
                    F.filter(starts, lambda i: matches(span, i)),
                    lambda i: F.struct(
                        span["ord"].alias("ord"), i.alias("start"),
                        F.size(span["words"]).alias("size"), span["label"].alias("label"),
                    ),
                )

            return F.flatten(F.transform(parts, of_span))

        def with_spans(parts):
            openers = F.transform(parts, lambda s: F.get(s["words"], F.lit(0)))
            starts = let(
                openers,
                lambda first: F.array_compact(
                    F.transform(words, lambda w, i: F.when(F.array_contains(first, w), i))
                ),
            )
            return let(starts, lambda at: of_spans(parts, at))

        return let(_span_tokens(span_list), with_spans)

    return let(lowered, find)


def _tag(hit: Column, position: Column) -> Column:
    return F.concat(F.when(position == hit["start"], "B-").otherwise("I-"), hit["label"])


def winning_tags(hits: Column) -> Column:
    """(pos, tag) of every covered token; the later span, then the later start, wins."""
    covered = F.flatten(
        F.transform(
            hits,
            lambda h: F.transform(
                F.sequence(h["start"], h["start"] + h["size"] - 1),
                lambda p: F.struct(
                    p.alias("pos"), h["ord"].alias("ord"), h["start"].alias("start"), _tag(h, p).alias("tag")
                ),
            ),
        )
    )
    return let(
        F.sort_array(covered),
        lambda c: F.transform(
            F.filter(c, lambda x, i: F.coalesce(F.get(c, i + 1)["pos"] != x["pos"], F.lit(True))),
            lambda x: F.struct(x["pos"].alias("pos"), x["tag"].alias("tag")),
        ),
    )


def bio_tags(size: Column, winners: Column) -> Column:
    """Tags of all tokens: `O` runs between the winning positions."""

    def spread(won):
        filled = F.transform(
            won,
            lambda w, i: F.concat(
                F.array_repeat(F.lit("O"), w["pos"] - F.coalesce(F.get(won, i - 1)["pos"], F.lit(-1)) - 1),
                F.array(w["tag"]),
            ),
        )
        used = F.coalesce(F.get(won, F.size(won) - 1)["pos"], F.lit(-1)) + 1
        return F.concat(F.flatten(filled), F.array_repeat(F.lit("O"), size - used))

    return let(winners, spread)


def tag_documents(documents: DataFrame, text: str = "description", span_list: str = "spans") -> DataFrame:
    """Add `tokens` and `ner_tags` to documents that carry their spans."""
    return (
        documents.withColumn("tokens", tokens(F.col(text)))
        .withColumn("_hits", span_hits(F.transform("tokens", F.lower), F.col(span_list)))
        .withColumn("ner_tags", bio_tags(F.size("tokens"), winning_tags(F.col("_hits"))))
        .drop("_hits")
    )


def training_examples(labelled: DataFrame) -> DataFrame:
    """Labelled records to `{id, tokens, ner_tags}`; records without any tag are dropped."""
    described = labelled.where(F.col("description") != "").withColumn(
        "spans", spans("hard_skills", "soft_skills", "salary", "level", "contract_type")
    )
    # dropped inside a generator: a filter would be pushed below and tag twice
    example = F.array(F.struct("tokens", "ner_tags"))
    kept = F.filter(example, lambda e: F.exists(e["ner_tags"], lambda t: t != "O"))
    return tag_documents(described).select(F.col("id").cast("string").alias("id"), F.inline(kept))


def latest_span_per_token(covered: DataFrame, keys=("doc_id", "pos")) -> DataFrame:
    """Relational form of the overwrite rule for spans kept in a table.

    `covered` has (doc_id, pos, ord, start, tag); one aggregate per token.
    """
    return covered.groupBy(*keys).agg(F.max_by("tag", F.struct("ord", "start")).alias("tag"))


def entity_features(entities: DataFrame) -> DataFrame:
    """Per post: joined hard and soft lists and the last salary of its entity rows.

    `entities` has (post_id, pos, label, word). Any SKILL label, soft ones
    included, is a hard skill; SOFT only applies to labels without SKILL.
    """
    label, word = F.col("label"), F.trim("word")
    is_hard = label.contains("SKILL")
    is_soft = ~is_hard & label.contains("SOFT")
    is_salary = ~is_hard & ~is_soft & label.contains("SALARY")

    def joined(condition):
        return F.array_join(F.sort_array(F.collect_set(F.when(condition, word))), ", ")

    return entities.groupBy("post_id").agg(
        joined(is_hard).alias("hard_skills"),
        joined(is_soft).alias("soft_skills"),
        F.max_by(F.when(is_salary, word), F.when(is_salary, F.col("pos"))).alias("salary"),
    )


# --- scores ------------------------------------------------------------------

def entity_spans(tags: Column) -> Column:
    """Entities of a tag sequence as (label, start, end).

    An entity opens at `B-`, at `I-` after `O`, and where the label changes.
    """

    def walk(seq):
        def kind(tag):
            return F.substr(tag, F.lit(3))

        def opens(tag, i):
            before = F.coalesce(F.get(seq, i - 1), F.lit("O"))
            return (tag != "O") & (
                tag.startswith("B-") | (before == "O") | (kind(before) != kind(tag))
            )

        edges = F.filter(
            F.transform(
                seq,
                lambda t, i: F.struct(
                    i.alias("start"), (t != "O").alias("inside"), opens(t, i).alias("opens"), kind(t).alias("label")
                ),
            ),
            lambda e: e["opens"] | ~e["inside"],
        )

        def close(cuts):
            ended = F.transform(
                cuts,
                lambda e, i: F.struct(
                    F.when(e["opens"], e["label"]).alias("label"),
                    e["start"].alias("start"),
                    (F.coalesce(F.get(cuts, i + 1)["start"], F.size(seq)) - 1).alias("end"),
                ),
            )
            return F.filter(ended, lambda s: s["label"].isNotNull())

        return let(edges, close)

    return let(tags, walk)


def unmasked(tags: Column, mask: Column) -> Column:
    """Tags at the positions whose mask is true."""
    return let(mask, lambda m: F.filter(tags, lambda t, i: F.get(m, i)))


def _whole_entities(codes, sizes, kinds, inside, begins):
    """Row, start, end (exclusive) and kind of every entity in flat tag codes; the last entry of each lookup is for null."""
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    before = np.roll(codes, 1)
    first = np.zeros(len(codes), dtype=bool)
    first[(ends - sizes)[sizes > 0]] = True
    null = codes == len(kinds) - 1
    opens = inside[codes] & (first | ~inside[before] | begins[codes] | (kinds[codes] != kinds[before]))
    edges = np.flatnonzero(opens | ~(inside[codes] | null))
    stops = np.minimum(np.append(edges[1:], len(codes)), ends[row[edges]])
    starts, stops = edges[opens[edges]], stops[opens[edges]]
    shift = (ends - sizes)[row[starts]]
    return row[starts], starts - shift, stops - shift, kinds[codes[starts]]


def _counted(batches):
    """Numbers of gold, predicted and equal entities of each batch of two tag columns, as `entity_spans` finds them."""
    for batch in batches:
        sides = batch.columns
        sizes = [pc.fill_null(pc.list_value_length(side), 0).to_numpy(zero_copy_only=False).astype("int64") for side in sides]
        tags = pa.concat_arrays([side.flatten().cast("string") for side in sides]).dictionary_encode()
        known = tags.dictionary
        kinds = pc.utf8_slice_codeunits(known, 2).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        inside, begins = (found.to_numpy(zero_copy_only=False) for found in (pc.not_equal(known, "O"), pc.starts_with(known, "B-")))
        lookups = np.append(kinds, -1), np.append(inside, False).astype(bool), np.append(begins, False).astype(bool)
        codes = pc.fill_null(tags.indices, len(known)).to_numpy(zero_copy_only=False)
        cut = int(sizes[0].sum())
        g, p = (_whole_entities(part, size, *lookups) for part, size in zip((codes[:cut], codes[cut:]), sizes, strict=True))
        width = int(max(size.max(initial=0) for size in sizes)) + 1
        # a row and a start name one entity of each side
        _, i, j = np.intersect1d(g[0] * width + g[1], p[0] * width + p[1], assume_unique=True, return_indices=True)
        same = (g[2][i] == p[2][j]) & (g[3][i] == p[3][j])
        counts = {"gold": [len(g[0])], "predicted": [len(p[0])], "correct": [int(same.sum())]}
        yield pa.RecordBatch.from_pydict(counts, schema=pa.schema([(name, pa.int64()) for name in counts]))


def entity_scores(tagged: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Micro precision, recall and F1 over exact entities of two tag columns, counted batch by batch."""

    found = tagged.select(gold, predicted).mapInArrow(_counted, "gold bigint, predicted bigint, correct bigint")
    counts = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gold", "predicted", "correct")])

    def ratio(part, whole):
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    precision = ratio(F.col("correct"), F.col("predicted"))
    recall = ratio(F.col("correct"), F.col("gold"))
    return counts.select(
        "gold", "predicted", "correct",
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(2 * F.col("correct"), F.col("gold") + F.col("predicted")).alias("f1"),
    )
