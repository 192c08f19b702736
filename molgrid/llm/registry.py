"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from molgrid.llm import addressable, alignment, chaining, decontaminate, html, packing, pii, quality, simhash, suffixes, token_counts, toxicity, turns
from molgrid.llm.common import table

#: A parameter of the operators that need a vocabulary; the files stay outside the repository.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
UNIGRAM_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Stands for the secret that a user passes to the operator.
PSEUDONYM_KEY = b"molgrid pseudonyms: replace this key"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), UNIGRAM_VOCABULARY)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.linked(table(spark, sf_dir, "documents"), VOCABULARY, PIECES)


def op12_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addressable.report(table(spark, sf_dir, "documents"), VOCABULARY)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.report(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_pii_pseudonyms": op4_pii_pseudonyms,
        "op5_quality_rules": op5_quality_rules,
        "op6_html_extraction": op6_html_extraction,
        "op7_toxicity": op7_toxicity,
        "op8_simhash_dedup": op8_simhash_dedup,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_token_counts": op10_token_counts,
        "op11_token_alignment": op11_token_alignment,
        "op12_token_codes": op12_token_codes,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontaminate.ORACLE_SQL,
        "op5_quality_rules": quality.ORACLE_SQL,
        "op13_conversation_repair": turns.ORACLE_SQL,
    }
