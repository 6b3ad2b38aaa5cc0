"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_text, langid, mixing, neardup, oracle, pii, quality, sharding, substrings, tokens
from .common import read


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_all(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_all(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(read(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_all(read(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def base_of_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can express."""
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_of_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can express."""
    return op10_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


OPERATORS = (op1_decontamination, op2_token_output, op3_mixing, op4_quality_rules, op5_language_id, op6_minhash_neardup, op7_suffix_dedup, op8_sharding, op9_html_extraction, op10_pii)
QUERIES = {f.__name__: f for f in (*OPERATORS, base_of_quality_rules, base_of_pii)}
SQL = {"op3_mixing": mixing.ORACLE, "op6_minhash_neardup": oracle.NEAR, "op7_suffix_dedup": oracle.REPEATS, "base_of_quality_rules": oracle.QUALITY_BASE, "base_of_pii": oracle.PII_BASE}
