"""Registered queries: each operator over its whole table, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.llm import (
    decontaminate,
    filter_audit,
    hard_negatives,
    language_id,
    line_dedup,
    ngram_join,
    packing,
    pii_surrogates,
    quality_fm,
    quality_rules,
    secret_scan,
    substring_dedup,
    url_filter,
)

# Users pass a secret of their own; the same key gives the same surrogates.
SURROGATE_KEY = "registered query"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text with surrogates for personal data."""
    return pii_surrogates.replace_entities(_table(spark, d, "documents"), SURROGATE_KEY)


def op2_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    """Documents with passages of benchmark items: a row per document and item."""
    return decontaminate.contaminated(_table(spark, d, "documents"), _table(spark, d, "benchmark"))


def op3_url_filter(spark: SparkSession, d: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filter.judge(_table(spark, d, "pages"), url_filter.rule_table(spark))


def op4_quality_fm(spark: SparkSession, d: str) -> DataFrame:
    """Quality score of every document."""
    return quality_fm.classify(_table(spark, d, "documents"), _table(spark, d, "labels"))


def op5_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Lines removed from every document, and a digest of the text that stays."""
    return line_dedup.summary(_table(spark, d, "documents"))


def op6_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    """Counts and verdicts of every document."""
    return quality_rules.judge(_table(spark, d, "documents"), _table(spark, d, "labels"))


def op7_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document's pieces, placed in windows of 4,096 tokens."""
    return packing.pack(_table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    return ngram_join.near_duplicates(_table(spark, d, "documents"))


def op9_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Words removed from every document, and a digest of those that stay."""
    rows = substring_dedup.dedup_substrings(_table(spark, d, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Secrets of every document, with linked weak candidates."""
    return secret_scan.scan(_table(spark, d, "documents"))


def op11_language_id(spark: SparkSession, d: str) -> DataFrame:
    """Language of every document."""
    return language_id.identify(_table(spark, d, "documents"))


def op12_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every source, order of the five filters and step."""
    return filter_audit.audit(_table(spark, d, "documents"), _table(spark, d, "labels"))


def op13_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Hard negatives of every fiftieth vector and its positives."""
    return hard_negatives.mine(_table(spark, d, "embeddings"))


QUERIES = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_decontaminate": op2_decontaminate,
    "op3_url_filter": op3_url_filter,
    "op4_quality_fm": op4_quality_fm,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_ngram_join": op8_ngram_join,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_language_id": op11_language_id,
    "op12_filter_audit": op12_filter_audit,
    "op13_hard_negatives": op13_hard_negatives,
}

#: DuckDB SQL of the queries that SQL can express; the others have brute-force tests.
ORACLE: dict[str, str] = {
    "op3_url_filter": url_filter.ORACLE_SQL,
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op8_ngram_join": ngram_join.ORACLE_SQL,
    "op9_substring_dedup": substring_dedup.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
