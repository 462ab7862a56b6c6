"""Token counts from batch encoding in Arrow functions.

The functions give lengths only.  Texts go to the encoder in batches of about
the same number of bytes.  A text of more than ``long_bytes`` is split where the
pre-tokeniser must split in any case: before a space that stands between two
letters.  The parts are rows of their own, dealt to all tasks, and their counts
are added up.  Special strings hold no space, so no split hits one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import column_of, slices, small_batches

LONG_BYTES = 1 << 16
BATCH_BYTES = 1 << 18

_SAFE = regex.compile(r"(?<=\p{L}) (?=\p{L})")
_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """A tokenizer file, read once by each Python worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        _loaded[path] = own
    return _loaded[path]


def safe_parts(text: str, size: int) -> list[str]:
    """Parts of at least ``size`` characters, cut only at safe places."""
    parts, at = [], 0
    while len(text) - at > size and (m := _SAFE.search(text, at + size)):
        parts.append(text[at : m.start()])
        at = m.start()
    return [*parts, text[at:]]


def count_tokens(docs: DataFrame, path: str, long_bytes: int = LONG_BYTES, limit: int = 1024) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    A null or empty text has no bytes and no tokens.  Rows that repeat an id
    or a text are rows of their own; null ids stay null; an empty table gives
    no rows.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn(
        "n_bytes", F.octet_length("text").cast("long")
    )

    def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for part in slices(batch, most=BATCH_BYTES):
                found = own.encode_batch_fast(column_of(part, "text").to_pylist(), add_special_tokens=False)
                lengths = pa.array([len(f) for f in found], pa.int64())
                kept = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(column_of(part, n) for n in kept), lengths], [*kept, "n_tokens"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = safe_parts(row.pop("text"), long_bytes // 2)
                yield pa.RecordBatch.from_pydict(
                    {**{k: [v] * len(parts) for k, v in row.items()}, "nth": list(range(len(parts))), "text": parts},
                    schema=pa.schema([*(batch.schema.field(n) for n in row), ("nth", pa.int32()), ("text", pa.string())]),
                )

    short = texts.where(F.col("n_bytes") <= long_bytes).mapInArrow(
        counts_of, "doc_id long, n_bytes long, n_tokens long"
    )
    # Rows equal in id and text share a key: their parts are added up together and divided again.
    key = ["doc_id", "n_bytes", "digest"]
    parts = (
        texts.where(F.col("n_bytes") > long_bytes)
        .withColumn("digest", F.md5(F.col("text").cast("binary")))
        .select(*key, "text")
        .mapInArrow(split, "doc_id long, n_bytes long, digest string, nth int, text string")
        .repartition(*key, "nth")
    )
    long = (
        parts.mapInArrow(counts_of, "doc_id long, n_bytes long, digest string, nth int, n_tokens long")
        .groupBy(*key)
        .agg(F.sum("n_tokens").alias("total"), F.count_if(F.col("nth") == 0).alias("copies"))
        .select(
            "doc_id",
            "n_bytes",
            F.expr("total div copies").alias("n_tokens"),
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))),
        )
        .drop("col")
    )
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
