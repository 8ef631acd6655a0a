"""Registered token labels, splits and scores."""

from pyspark.sql import functions as F

from postmill.catalog.adapter import table, text_table
from postmill.operators import labels, split


def document_tokens(spark, sf):
    """Tokens of whole documents with their positions."""
    tokens = text_table(spark, sf, "documents").select("doc_id", F.posexplode(labels.tokens(F.col("text"))))
    return tokens.groupBy("doc_id").agg(
        F.count("*").alias("tokens"), F.sum(F.length("col") * (F.col("pos") % 97 + 1)).alias("weighted")
    )


def _labelled(spark, sf):
    """Documents as labelled records whose spans are words of the document itself.

    Hard skills are the words 3 and 4 as one span and word 6; word 4 in lower
    case is also a soft skill, so that spans overlap; level is the first word.
    """
    tokens = labels.tokens(F.col("text"))
    words = text_table(spark, sf, "documents").withColumn("w", F.transform(tokens, lambda t: F.replace(t, F.lit(","), F.lit(""))))

    def word(i):
        return F.coalesce(F.get("w", F.lit(i)), F.lit(""))

    return words.select(
        F.col("doc_id").cast("string").alias("id"),
        F.replace("text", F.lit(","), F.lit("")).alias("description"),
        F.concat(word(3), F.lit(" "), word(4), F.lit(", "), word(6)).alias("hard_skills"),
        F.when(F.col("doc_id") % 2 == 0, F.lower(word(4))).otherwise("nan").alias("soft_skills"),
        F.when(F.col("doc_id") % 3 == 0, "Não informado").otherwise(word(7)).alias("salary"),
        word(0).alias("level"),
        F.lit(None).cast("string").alias("contract_type"),
    )


def label_spans(spark, sf):
    spans = _labelled(spark, sf).select(
        "id",
        F.posexplode(labels.spans("hard_skills", "soft_skills", "salary", "level", "contract_type")).alias("ord", "span"),
    )
    return spans.select("id", "ord", F.col("span.text").alias("text"), F.col("span.label").alias("label"))


def training_examples(spark, sf):
    examples = labels.training_examples(_labelled(spark, sf))
    return examples.select(
        "id", F.size("tokens").alias("tokens"), F.md5(F.array_join("ner_tags", " ")).alias("digest"),
        F.size(F.filter("ner_tags", lambda t: t != "O")).alias("tagged"),
    )


def untagged_documents(spark, sf):
    """Whole documents left out because no span occurs in them; three in four have only spans of another alphabet."""
    own = F.col("id").cast("int") % 4 == 0
    given = _labelled(spark, sf)
    silent = given.select("id", "description", *[
        F.when(own, F.col(c)).otherwise(F.concat(F.lit("\u0416"), "id")).alias(c)
        for c in ("hard_skills", "soft_skills", "salary", "level", "contract_type")
    ])
    kept = labels.training_examples(silent).select("id")
    return silent.where("description <> ''").join(kept, "id", "left_anti").select("id")


def latest_span_per_token(spark, sf):
    """Overlapping spans kept in a table: orders as documents, parts as positions."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 3).alias("pos"),
        F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("start"),
        F.concat(F.lit("B-"), F.col("l_partkey").cast("string")).alias("tag"),
    )
    return labels.latest_span_per_token(lines)


def entity_features(spark, sf):
    """Conversation turns as entity rows of a post."""
    turns = table(spark, sf, "conversations")
    label = (
        F.when(F.col("turn") % 4 == 0, "HARD_SKILL").when(F.col("turn") % 4 == 1, "SOFT_SKILL")
        .when(F.col("turn") % 4 == 2, "SALARY").otherwise("SOFT")
    )
    entities = turns.select(
        F.col("conv_id").alias("post_id"), F.col("turn").alias("pos"), label.alias("label"),
        F.concat(F.lit(" "), F.col("role"), F.length("text") % 5, F.lit(" ")).alias("word"),
    )
    return labels.entity_features(entities)


def _tagged(spark, sf):
    """Gold and predicted tags of whole documents, from word lengths."""
    kinds = F.array(*[F.lit(kind) for kind in ("B-HARD_SKILL", "I-HARD_SKILL", "I-SOFT_SKILL", "O", "O")])
    tokens = text_table(spark, sf, "documents").select(
        "doc_id", F.transform(labels.tokens(F.col("text")), lambda t: F.length(t) % 5).alias("k")
    ).withColumn("mask", F.transform("k", lambda k, i: i % 11 != 5))
    gold = F.transform("k", lambda k: F.get(kinds, k))
    predicted = F.transform("k", lambda k, i: F.get(kinds, F.when(i % 7 == 0, (k + 1) % 5).otherwise(k)))
    return tokens.select(
        "doc_id", labels.unmasked(gold, F.col("mask")).alias("gold"), labels.unmasked(predicted, F.col("mask")).alias("predicted")
    )


def entity_spans(spark, sf):
    found = _tagged(spark, sf).select("doc_id", F.explode(labels.entity_spans(F.col("gold"))).alias("s"))
    return found.groupBy("doc_id", F.col("s.label").alias("label")).agg(
        F.count("*").alias("n"), F.sum(F.col("s.start") * 3 + F.col("s.end")).alias("places")
    )


def entity_scores(spark, sf):
    scores = labels.entity_scores(_tagged(spark, sf))
    return scores.select(
        "gold", "predicted", "correct", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    )


def ordered_split(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    parts = split.ordered_split(rows, "o_orderkey")
    return parts.groupBy("part").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")
    )


def ordered_split_of_labels(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", "quality")
    return split.ordered_split(rows, "doc_id", 0.37)


_TOKENS_SQL = r"list_filter(regexp_split_to_array({text}, '\s+'), lambda x: x <> '')"

_LABELLED_SQL = rf"""
labelled AS (
  SELECT doc_id, w, coalesce(w[4], '') || ' ' || coalesce(w[5], '') AS h1, coalesce(w[7], '') AS h2,
    CASE WHEN doc_id % 2 = 0 THEN lower(coalesce(w[5], '')) ELSE '' END AS s1,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(w[8], '') END AS sal, coalesce(w[1], '') AS lev
  FROM (SELECT doc_id, list_transform({_TOKENS_SQL.format(text="text")}, lambda t: replace(t, ',', '')) AS w FROM documents)),
spans AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ord, trim(txt) AS txt, label FROM (
    SELECT doc_id, 1 AS k, h1 AS txt, 'HARD_SKILL' AS label FROM labelled UNION ALL
    SELECT doc_id, 2, h2, 'HARD_SKILL' FROM labelled UNION ALL SELECT doc_id, 3, s1, 'SOFT_SKILL' FROM labelled UNION ALL
    SELECT doc_id, 4, sal, 'SALARY' FROM labelled UNION ALL SELECT doc_id, 5, lev, 'NIVEL' FROM labelled)
  WHERE trim(txt) <> '')"""

_TAGS_SQL = rf"""
{_LABELLED_SQL},
docs AS (SELECT doc_id, {_TOKENS_SQL.format(text="replace(text, ',', '')")} AS w FROM documents),
tokens AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM docs),
parts AS (SELECT doc_id, ord, label, list_filter(string_split(lower(txt), ' '), lambda x: x <> '') AS p FROM spans),
hits AS (SELECT t.doc_id, t.pos AS start, s.ord, s.label, len(s.p) AS n
  FROM tokens t JOIN parts s ON s.doc_id = t.doc_id AND s.p[1] = lower(t.tok)
       LEFT JOIN tokens t2 ON t2.doc_id = t.doc_id AND t2.pos = t.pos + 1
  WHERE len(s.p) = 1 OR (len(s.p) = 2 AND s.p[2] = lower(t2.tok))),
covered AS (
  SELECT doc_id, start AS pos, ord, start, 'B-' || label AS tag FROM hits UNION ALL
  SELECT doc_id, start + 1, ord, start, 'I-' || label FROM hits WHERE n = 2),
won AS (SELECT doc_id, pos, arg_max(tag, ord * 1000000 + start) AS tag FROM covered GROUP BY 1, 2),
tagged AS (SELECT t.doc_id, count(*) AS tokens, string_agg(coalesce(tag, 'O'), ' ' ORDER BY t.pos) AS tags,
    count(tag) AS tagged FROM tokens t LEFT JOIN won w ON w.doc_id = t.doc_id AND w.pos = t.pos GROUP BY 1)"""

_ENTITY_SQL = rf"""
tokens AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS i
  FROM (SELECT doc_id, {_TOKENS_SQL.format(text="text")} AS w FROM documents)),
kinds AS (SELECT doc_id, i, length(tok) % 5 AS g, (length(tok) + CASE WHEN i % 7 = 0 THEN 1 ELSE 0 END) % 5 AS p
  FROM tokens WHERE i % 11 <> 5),
sides AS (SELECT 'gold' AS side, doc_id, i, g AS k FROM kinds UNION ALL SELECT 'predicted', doc_id, i, p FROM kinds),
named AS (SELECT side, doc_id, row_number() OVER (PARTITION BY side, doc_id ORDER BY i) - 1 AS pos, k = 0 AS b,
  CASE WHEN k < 2 THEN 'HARD_SKILL' WHEN k = 2 THEN 'SOFT_SKILL' ELSE 'O' END AS label FROM sides),
marked AS (SELECT *, CASE WHEN label <> 'O' AND (b OR label <> lag(label, 1, 'O') OVER w) THEN 1 ELSE 0 END AS opens
  FROM named WINDOW w AS (PARTITION BY side, doc_id ORDER BY pos)),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY side, doc_id ORDER BY pos) AS entity FROM marked),
entities AS MATERIALIZED (SELECT side, doc_id, entity, label, min(pos) AS start, max(pos) AS stop FROM grouped
  WHERE label <> 'O' GROUP BY 1, 2, 3, 4)"""

QUERIES = [
    ("document_tokens", document_tokens, rf"""
SELECT doc_id, count(*) AS tokens, CAST(sum(length(tok) * (i % 97 + 1)) AS BIGINT) AS weighted
FROM (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS i
      FROM (SELECT doc_id, {_TOKENS_SQL.format(text="text")} AS w FROM documents)) GROUP BY 1"""),
    ("label_spans", label_spans, f"""
WITH {_LABELLED_SQL}
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(ord AS INTEGER) AS ord, txt AS text, label FROM spans"""),
    ("training_examples", training_examples, f"""
WITH {_TAGS_SQL}
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(tokens AS INTEGER) AS tokens, md5(tags) AS digest,
       CAST(tagged AS INTEGER) AS tagged FROM tagged WHERE tagged > 0"""),
    ("untagged_documents", untagged_documents, f"""
WITH {_TAGS_SQL}
SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE replace(text, ',', '') <> ''
  AND NOT (doc_id % 4 = 0 AND doc_id IN (SELECT doc_id FROM tagged WHERE tagged > 0))"""),
    ("latest_span_per_token", latest_span_per_token, """
SELECT l_orderkey AS doc_id, l_partkey % 3 AS pos,
       arg_max('B-' || l_partkey, l_linenumber * 100000000000 + l_partkey) AS tag
FROM lineitem GROUP BY 1, 2"""),
    ("entity_features", entity_features, """
WITH e AS (SELECT conv_id, turn, turn % 4 AS k, role || (length(text) % 5) AS word FROM conversations)
SELECT conv_id AS post_id, coalesce(string_agg(DISTINCT CASE WHEN k < 2 THEN word END, ', ' ORDER BY CASE WHEN k < 2 THEN word END), '') AS hard_skills,
       coalesce(string_agg(DISTINCT CASE WHEN k = 3 THEN word END, ', ' ORDER BY CASE WHEN k = 3 THEN word END), '') AS soft_skills,
       arg_max(CASE WHEN k = 2 THEN word END, CASE WHEN k = 2 THEN turn END) AS salary
FROM e GROUP BY 1"""),
    ("entity_spans", entity_spans, f"""
WITH {_ENTITY_SQL} SELECT doc_id, label, count(*) AS n, CAST(sum(start * 3 + stop) AS BIGINT) AS places
FROM entities WHERE side = 'gold' GROUP BY 1, 2"""),
    ("entity_scores", entity_scores, f"""
WITH {_ENTITY_SQL},
counts AS (SELECT (SELECT count(*) FROM entities WHERE side = 'gold') AS gold,
  (SELECT count(*) FROM entities WHERE side = 'predicted') AS predicted,
  (SELECT count(*) FROM entities g JOIN entities p ON g.side = 'gold' AND p.side = 'predicted' AND g.doc_id = p.doc_id
     AND g.label = p.label AND g.start = p.start AND g.stop = p.stop) AS correct)
SELECT gold, predicted, correct, round(correct / predicted, 6) AS precision, round(correct / gold, 6) AS recall,
       round(2 * correct / (gold + predicted), 6) AS f1 FROM counts"""),
    ("ordered_split", ordered_split, """
SELECT CASE WHEN n <= floor(total * 0.9) THEN 'train' ELSE 'test' END AS part, count(*) AS n,
       min(o_orderkey) AS first, max(o_orderkey) AS last
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n, count(*) OVER () AS total FROM orders) GROUP BY 1"""),
    ("ordered_split_of_labels", ordered_split_of_labels, """
SELECT doc_id, quality, CASE WHEN n <= floor(total * 0.37) THEN 'train' ELSE 'test' END AS part
FROM (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS total FROM labels)"""),
]
