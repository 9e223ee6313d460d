"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphshift.llm import bpe, chat, decontaminate, language_model, lines, quality, rules, search, secrets, simhash, substrings, token_counts, whitening
from glyphshift.llm._shared import documents


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(spark, sf_dir)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(documents(spark, sf_dir))


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(documents(spark, sf_dir), words=lines.WORDS)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.report(documents(spark, sf_dir))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_secret_scan,
        op3_token_counts,
        op4_quality_rules,
        op5_decontamination,
        op6_simhash_neardup,
        op7_preference_format,
        op8_substring_dedup,
        op9_byte_bpe,
        op10_line_dedup,
        op11_embedding_whitening,
        op12_lm_scoring,
        op13_ranked_search,
    )
}
ORACLES = {
    "op4_quality_rules": rules.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op7_preference_format": chat.ORACLE,
    "op8_substring_dedup": substrings.ORACLE,
    "op10_line_dedup": lines.ORACLE,
    "op13_ranked_search": search.ORACLE,
}
