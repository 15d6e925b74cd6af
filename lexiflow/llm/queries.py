"""The package's registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiflow.llm import (bpe_tokens, decontaminate, hmm_lm, lexical_search, pii_crf, quality_rules, secret_scan, simhash, suffix_dedup,
                          token_alignment, toxicity, url_filter, warc_zip)
from lexiflow.llm.common import table


def tokenizer() -> tuple[str, str]:
    """Ranks file and pattern of the registered encoding."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.report(table(spark, sf_dir, "pages", "page_id", "url"))


def op3_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tokens.digests(table(spark, sf_dir, "documents", "doc_id", "text"), *tokenizer())


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.report(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def near_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity columns of ``op10_decontaminate``."""
    return op10_decontaminate(spark, sf_dir).select("doc_id", "n_near", "near_items")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.report(table(spark, sf_dir, "documents", "doc_id", "text"),
                                  public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_suffix_dedup, op2_url_filter, op3_hmm_lm, op4_quality_rules, op5_byte_bpe, op6_simhash, op7_pii_crf,
        op8_warc_zip, op9_secret_scan, op10_decontaminate, near_terms,
        op11_toxicity, op12_token_alignment, op13_lexical_search)}

ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": quality_rules.SQL, "op8_warc_zip": warc_zip.SQL, "op10_decontaminate": decontaminate.SQL,
    "near_terms": decontaminate.NEAR_SQL,    "op13_lexical_search": lexical_search.SQL}
