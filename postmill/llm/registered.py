"""Queries of the operators; each is (name, query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmill.llm import audit, automaton, chat, decontaminate, jaccard, language, linedup, mixing, pii, quality, secrets, suffixes, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), jaccard.Rule(size=4, above=85))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.line_dedup(_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_dedup(_table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_chats(chat.attack(_table(spark, sf_dir, "conversations"))))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.lm_scores(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = (
    ("op1_ngram_jaccard", op1_ngram_jaccard, None),
    ("op2_quality_rules", op2_quality_rules, None),
    ("op3_line_dedup", op3_line_dedup, None),
    ("op4_suffix_dedup", op4_suffix_dedup, None),
    ("op5_secret_scans", op5_secret_scans, None),
    ("op6_chat_formatting", op6_chat_formatting, chat.DIGESTS_SQL),
    ("op7_mixing", op7_mixing, None),
    ("op8_pii", op8_pii, None),
    ("op9_language_id", op9_language_id, None),
    ("op10_decontamination", op10_decontamination, None),
    ("op11_filter_audit", op11_filter_audit, audit.AUDIT_SQL),
    ("op12_lm_scoring", op12_lm_scoring, automaton.SCORES_SQL),
    ("op13_whitening", op13_whitening, None),
)
