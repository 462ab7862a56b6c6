"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    decontamination,
    html_text,
    jaccard_join,
    quality_crf,
    quality_rules,
    sharding,
    source_divergence,
    substring_dedup,
    token_alignment,
    token_counts,
    toxicity,
    word_bpe,
)
from .common import fold_remainder, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.find_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words_repeated",
        "n_words_removed",
        "first_ids",
        F.size("spans").alias("n_spans"),
        "spans",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = fold_remainder(F.col("doc_id"), 3)
    scored = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder != 1)
    return scored.select("doc_id", (remainder == 1).alias("held_out"), "score", "predicted")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = fold_remainder(F.col("doc_id"), 5)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_crf.classify(docs, table(spark, sf_dir, "labels"), remainder != 0)
    return scored.select("doc_id", (remainder == 0).alias("held_out"), "score", "predicted")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.audit(table(spark, sf_dir, "documents"), a, b, public_tokenizers.PATTERN)


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_byte_bpe,
        op3_jaccard_join,
        op4_token_counts,
        op5_sharding,
        op6_html_text,
        op7_toxicity,
        op8_quality_rules,
        op9_decontamination,
        op10_quality_crf,
        op11_token_alignment,
        op12_word_bpe,
        op13_source_divergence,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_jaccard_join": jaccard_join.ORACLE_SQL,
    "op8_quality_rules": quality_rules.ORACLE_SQL,
    "op13_source_divergence": source_divergence.ORACLE_SQL,
}
