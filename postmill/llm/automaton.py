"""Language-model scores from a weighted backoff automaton whose n-grams are counted over the whole corpus.

States are the histories seen in training: the root, the start and each known
word. A state has a weighted arc for each token seen after it and a failure arc, weighted
too, to the root, which has an arc for every token. A text is read once from left to
right; the weights passed add up to its log-probability.

No task ever holds the model: texts are dealt over runs, a run asks for the counts of its own
n-grams, and gets back the sums over all runs, from which it builds the part of
the automaton that its texts can reach.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.exchange import BUCKET_KEYS, answers, asked_fields, cuts, pack, questions, rows_of, unpack
from postmill.llm.scratch import Scratch, shuffle_partitions
from postmill.llm.textkit import FOLDED, PLACES, hashes, mix, runs

#: Added to the count of each token and of the unknown one.
FLOOR = 0.1
#: Tokens' worth of trust in the root: p(w | h) = (c(hw) + TRUST p(w)) / (c(h) + TRUST).
TRUST = 8.0
RUN_BYTES, RUN_ROWS = 4 << 20, 1 << 15
#: Runs that one task scores, about.
TASK_RUNS = 8
SECTIONS = ("words", "pairs")
#: Tokens that one lane of the traversal reads.
LANE = 256

END, START = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)


def _word_keys(vocabulary: np.ndarray) -> np.ndarray:
    return mix(vocabulary * PLACES[2] + PLACES[3])


class Run:
    """Texts as ranks in the run's own vocabulary: words in order of their hashes, end and start among them.

    `ids` are the tokens of all texts, each text closed by its end; `counts` are tokens of each text.
    """

    def __init__(self, vocabulary: np.ndarray, ids: np.ndarray, counts: np.ndarray, held: np.ndarray):
        self.vocabulary, self.ids, self.counts, self.held = vocabulary, ids, counts, held
        self.end, self.start = np.searchsorted(vocabulary, END), np.searchsorted(vocabulary, START)
        self.begins = np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.trained = np.repeat(~held, counts)
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[self.begins] = self.start
        pairs = before * len(vocabulary) + ids
        keys = np.sort(pairs * 2 + self.trained)
        pairs = keys >> 1
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
        self.pairs = pairs[first]
        own = np.add.reduceat(keys & 1, first) if len(first) else first
        words = np.bincount(ids[self.trained], minlength=len(vocabulary))
        words[self.start] = (~held).sum()
        #: Hashes and counts of what the run asks for, by section: words, then pairs of history and token.
        left, right = np.divmod(self.pairs, len(vocabulary))
        self.asked = [
            (_word_keys(vocabulary), words),
            (mix(vocabulary[left] * PLACES[0] + vocabulary[right] * PLACES[1]), own),
        ]
        self.orders = [np.argsort(values) for values, _ in self.asked]


def encoded(docs: DataFrame) -> DataFrame:
    """One row for each run of whole texts: their ids, held-out marks, token counts, vocabulary and tokens."""

    def encode(batches):
        for batch, texts in runs(batches, "text", RUN_BYTES, RUN_ROWS):
            starts, ends, offsets = texts.words()
            values = hashes(texts.sums(FOLDED), starts, ends)
            counts = np.diff(offsets)
            places = np.arange(len(values)) + np.repeat(np.arange(len(counts)), counts)
            tokens = np.full(len(values) + len(counts), END, np.uint64)
            tokens[places] = values
            order = np.argsort(tokens)
            ranked = tokens[order]
            fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
            vocabulary = ranked[fresh]
            at = int(np.searchsorted(vocabulary, START))
            ids = np.empty(len(tokens), np.int64)
            ids[order] = np.cumsum(fresh) - 1
            ids[ids >= at] += 1
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            counts = counts + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().hex]), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([pack(held)], pa.binary()), pa.array([pack(counts)], pa.binary()),
                    pa.array([pack(np.insert(vocabulary, at, START))], pa.binary()), pa.array([pack(ids)], pa.binary()),
                    pa.array([len(ids)], pa.int64()), pa.array([int(counts[~held].sum())], pa.int64()),
                ],
                names=["run", "doc_ids", "held", "counts", "vocabulary", "ids", "tokens", "train_tokens"],
            )

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0, F.lit(False)).alias("held")
    fields = "run string, doc_ids array<long>, held binary, counts binary, vocabulary binary, ids binary, tokens long, train_tokens long"
    return docs.select("doc_id", "text", held).mapInArrow(encode, fields)


def _run(row: dict) -> Run:
    vocabulary, ids = unpack(row["vocabulary"], 1)[0], unpack(row["ids"], 1)[0].astype(np.int64)
    return Run(vocabulary, ids, unpack(row["counts"], 1)[0].astype(np.int64), unpack(row["held"], 1)[0].astype(bool))


def counted(table: DataFrame, buckets: int) -> DataFrame:
    """For each run and bucket the training counts over all runs of what the run asks for."""

    def ask(batches):
        for row in rows_of(batches):
            run = _run(row)
            sections = [(keys[order], counts[order]) for (keys, counts), order in zip(run.asked, run.orders)]
            yield from questions(row["run"], sections, SECTIONS, buckets)

    asked = table.select("run", "held", "counts", "vocabulary", "ids").mapInArrow(ask, asked_fields(SECTIONS))
    return answers(asked, SECTIONS, buckets)


class Automaton:
    """Arcs over the vocabulary of one run. State 0 is the root, state 1 + i the history i.

    `root` are weights of the root's arcs. `arcs` are the other ones, as sorted state
    and token pairs with their weights; `failure` are weights of the failure arcs, which lead to the root.
    """

    def __init__(self, run: Run, words: np.ndarray, pairs: np.ndarray, train_tokens: int, known: int, trust: float = TRUST):
        self.size = len(run.vocabulary)
        chance = (words + FLOOR) / (train_tokens + FLOOR * (known + 1))
        self.root = np.log10(chance)
        left, right = np.divmod(run.pairs, self.size)
        seen = pairs > 0
        left, right = left[seen], right[seen]
        self.arcs = run.pairs[seen] + self.size
        self.weight = np.log10((pairs[seen] + trust * chance[right]) / (words[left] + trust))
        self.failure = np.concatenate([[0.0], np.log10(trust / (words + trust))])
        #: The state that a token leads to: its history, or the root where training has none.
        self.following = np.where(words > 0, np.arange(self.size) + 1, 0)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights passed and states reached from `state` by `token`: failure arcs are followed until an arc is found."""
        weight = np.zeros(len(state))
        waiting = np.flatnonzero(state > 0)
        key = state[waiting] * self.size + token[waiting]
        at = np.minimum(np.searchsorted(self.arcs, key), max(len(self.arcs) - 1, 0))
        found = self.arcs[at] == key if len(self.arcs) else np.zeros(len(key), bool)
        weight[waiting[found]] = self.weight[at[found]]
        weight[waiting[~found]] = self.failure[state[waiting[~found]]]
        rooted = state == 0
        rooted[waiting[~found]] = True
        weight[rooted] += self.root[token[rooted]]
        return weight, self.following[token]

    def traverse(self, run: Run) -> np.ndarray:
        """Weight of each token of the run, read from left to right.

        Texts are cut into lanes that advance together. A state is fixed by the last token, so a lane
        that starts within a text reads the token before it first.
        """
        out = np.zeros(len(run.ids))
        lanes = -(-run.counts // LANE)
        text = np.repeat(np.arange(len(lanes)), lanes)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = run.begins[text] + turn * LANE
        left = np.minimum(run.counts[text] - turn * LANE, LANE)
        state = np.full(len(at), 1 + run.start) if run.start < self.size else np.zeros(len(at), np.int64)
        state = np.where(self.following[run.start] > 0, state, 0)
        inner = turn > 0
        state[inner] = self.step(np.zeros(inner.sum(), np.int64), run.ids[at[inner] - 1])[1]
        order = np.argsort(-left, kind="stable")
        at, left, state = at[order], left[order], state[order]
        for step in range(LANE):
            live = int(np.searchsorted(-left, -step, "left"))
            if not live:
                break
            places = at[:live] + step
            out[places], state[:live] = self.step(state[:live], run.ids[places])
        return out


def _scores(row: dict, run: Run, totals: list[np.ndarray], train_tokens: int, known: int):
    words, pairs = (t.astype(np.float64) for t in totals)
    automaton = Automaton(run, words, pairs, train_tokens, known)

    def total(weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights.astype(np.longdouble), run.begins).astype(np.float64)

    seen = np.add.reduceat((words[run.ids] > 0).astype(np.int64), run.begins)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row["doc_ids"], pa.int64()), pa.array(run.held), pa.array(run.counts), pa.array(seen),
            pa.array(np.full(len(seen), train_tokens)), pa.array(total(automaton.root[run.ids])), pa.array(total(automaton.traverse(run))),
        ],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A null or empty text is one token, its end. Rows without doc_id are not held out and
    train the model; repeated rows train it each time and are all returned. Without
    any training text every token is unknown and both scores are 0. Hashes of 64 bits tell words and
    pairs of words apart.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "automaton")
    table = scratch.write(encoded(docs.select("doc_id", "text")), "runs")
    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    count, tokens, train_tokens = table.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("train_tokens"), F.lit(0))).first()
    if not count:
        return spark.createDataFrame([], fields)
    parts = shuffle_partitions(spark)
    buckets = max(parts, -(-tokens // BUCKET_KEYS))
    totals_of = scratch.write(counted(table, buckets), "counts")
    # the start has a count where any text trains, but is no token
    known = totals_of.agg(F.sum("positive")).first()[0] - (train_tokens > 0)

    def score(batches):
        row = run = totals = places = None
        for following in rows_of(batches):
            if following["bucket"] < 0:
                if run is not None:
                    yield _scores(row, run, totals, train_tokens, known)
                row, run = following, _run(following)
                totals = [np.zeros(len(keys), np.uint64) for keys, _ in run.asked]
                places = [(order, cuts(keys[order], buckets)) for (keys, _), order in zip(run.asked, run.orders)]
            else:
                at = following["bucket"]
                for total, (order, cut), section in zip(totals, places, SECTIONS):
                    if following[section]:
                        total[order[cut[at] : cut[at + 1]]] = unpack(following[section], 1)[0]
        if run is not None:
            yield _scores(row, run, totals, train_tokens, known)

    names = ("doc_ids", "held", "counts", "vocabulary", "ids", "words", "pairs")
    heads = table.select("run", F.lit(-1).alias("bucket"), *names[:5], F.lit(None).cast("binary").alias("words"), F.lit(None).cast("binary").alias("pairs"))
    rest = totals_of.select(
        "run", "bucket", F.lit(None).cast("array<long>").alias("doc_ids"), *(F.lit(None).cast("binary").alias(n) for n in names[1:5]), "words", "pairs"
    )
    dealt = heads.unionByName(rest).repartition(max(parts, -(-count // TASK_RUNS)), "run").sortWithinPartitions("run", "bucket")
    return dealt.mapInArrow(score, fields)


#: Tokens are words, then a blank for the end and two for the start; crc32 is folded bit by bit, -1 standing for a shift.
SCORES_SQL = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS row, doc_id,
           coalesce(xor(list_reduce(
               list_prepend(4294967295::BIGINT, flatten(list_transform(
                   string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]
               ))),
               lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END
           ), 4294967295::BIGINT) % 10 = 0, false) AS held_out,
           list_append(regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'
           ), ' ') AS tokens
    FROM documents
), placed AS (
    SELECT row, held_out, unnest(tokens) AS token, unnest(list_prepend('  ', tokens[:-2])) AS history FROM texts
), words AS (
    SELECT token, count(*) AS c FROM placed WHERE NOT held_out GROUP BY token
), histories AS (
    SELECT history, count(*) AS c FROM placed WHERE NOT held_out GROUP BY history
), pairs AS (
    SELECT history, token, count(*) AS c FROM placed WHERE NOT held_out GROUP BY history, token
), sizes AS (
    SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM words
), weighed AS (
    SELECT row, coalesce(words.c, 0) > 0 AS known, histories.c AS h, coalesce(pairs.c, 0) AS joint,
           (coalesce(words.c, 0) + {FLOOR}::DOUBLE) / (sizes.n + {FLOOR}::DOUBLE * (sizes.v + 1)) AS chance
    FROM placed CROSS JOIN sizes LEFT JOIN words USING (token) LEFT JOIN histories USING (history) LEFT JOIN pairs USING (history, token)
), summed AS (
    SELECT row, count(*) AS n_tokens, sum(CASE WHEN known THEN 1 ELSE 0 END) AS n_known, fsum(log10(chance)) AS base_score,
           fsum(log10(CASE WHEN h IS NULL THEN chance WHEN joint > 0 THEN (joint + {TRUST}::DOUBLE * chance) / (h + {TRUST}::DOUBLE)
                           ELSE {TRUST}::DOUBLE / (h + {TRUST}::DOUBLE) * chance END)) AS score
    FROM weighed GROUP BY row
)
SELECT doc_id, held_out, n_tokens::BIGINT AS n_tokens, n_known::BIGINT AS n_known, sizes.n::BIGINT AS train_tokens, base_score, score
FROM texts JOIN summed USING (row) CROSS JOIN sizes
"""
