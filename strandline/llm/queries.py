"""The queries of this subpackage: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, decontam, html_extract, importance, interaction, lang_id, license_scan, minhash, pii, quality_rules, substring_dedup, token_counts
from .columns import table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file, on whichever machine asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(chat_format.format_chats(chat_format.with_probe(table(spark, sf_dir, "conversations"))))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_rules.judge(documents, quality_rules.learn(documents, table(spark, sf_dir, "labels")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.query(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.digest(importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.digest(interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat_format.SQL,
        "op5_benchmark_decontamination": decontam.SQL,
        "op10_substring_dedup": substring_dedup.SQL,
        "op11_license_scan": license_scan.sql(),
        "op12_importance_resampling": importance.SQL,
        "op13_filter_interaction": interaction.SQL,
    }
