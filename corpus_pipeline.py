"""From raw documents to token ids, in stages that each write Parquet.

``run`` applies the stages to the table documents.  What a stage returns is
written under the folder in ``spark.checkpoint.dir`` and read again as the next
one's documents.  Rows without text fail the quality classifier, and an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontamination, jaccard_join, quality_crf, substring_dedup
from tidemark.llm.common import fold_remainder, table
from tidemark.operators.checkpoints import new_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    learn = fold_remainder(F.col("doc_id"), 5) != 0
    return quality_crf.classify(docs, table(spark, sf_dir, "labels"), learn).where("predicted = 1").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each class of near copies."""
    return jaccard_join.one_of_each_class(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with passages that an earlier one holds cut out."""
    return substring_dedup.without_repeats(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with passages of the benchmark cut out."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of all documents."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("jaccard_join", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", cut_benchmark_passages),
    ("byte_bpe", encode_and_decode),
]

#: The stages are a trained model, min-hashing and tokenisation: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in sf_dir."""
    folder = new_folder(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
