"""Byte-level BPE encoding of overlapping chunks, and decoding.

A text of more than ``chunk_chars`` characters is cut into chunks that overlap.
The chunks are rows of their own, dealt to all tasks.  Each is split into
pre-tokens by the pattern on its own; where a chunk begins in the middle of a
pre-token its first boundaries may be wrong.  The pattern never looks back, so
from the first boundary that two neighbouring chunks share in their overlap on,
both agree: there the texts are stitched.  The pieces between such points are
encoded, and their ids put together in order.  Where no boundary is shared (one
pre-token longer than the overlap) the two chunks stay one piece.  Short texts
are one piece and aren't shuffled.

Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_of, slices, small_batches

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 9

_loaded: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; a Python worker reads it once."""
    if (ranks_path, pattern) not in _loaded:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _loaded[ranks_path, pattern] = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
    return _loaded[ranks_path, pattern]


def chunk_bounds(text: str, at_end: bool, overlap: int, pattern: regex.Pattern) -> tuple[list[int], list[int]]:
    """Pre-token boundaries in the first and in the last ``overlap`` characters.

    Unless the text ends here, its last pre-token may go on: that end is no boundary.
    """
    starts = [m.start() for m in pattern.finditer(text)]
    starts = starts + [len(text)] if at_end else starts
    return [b for b in starts if b <= overlap], [b for b in starts if b >= len(text) - overlap]


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """One row per row of docs: doc_id and ids array<int>.

    A null text is the empty one, without ids.  Special strings are ordinary
    text.  Rows that repeat an id or a text are rows of their own; null ids
    stay null; an empty table gives no rows.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    long = F.length("text") > chunk_chars

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = [np.array(own.encode_ordinary(t), np.int32) for t in column_of(part, "text").to_pylist()]
                offs = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(ids)))
                kept = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(column_of(part, n) for n in kept), lists], [*kept, "ids"])

    short = texts.where(~long).mapInArrow(ids_of, "doc_id long, ids array<int>")

    # Rows equal in id and text are encoded once and given out as often as they came.
    whole = (
        texts.where(long)
        .groupBy("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "text")
        .agg(F.count("*").alias("copies"))
    )
    step = chunk_chars - overlap
    key = ["doc_id", "digest"]

    def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(n) for n in range(3)]
            for row, text in enumerate(column_of(batch, "text").to_pylist()):
                starts = range(0, len(text), step)
                kept = [c.take(pa.array([row] * len(starts))) for c in own]
                parts = [pa.array([text[s : s + chunk_chars] for s in starts]), pa.array([len(text) <= s + chunk_chars for s in starts])]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(range(len(starts)), pa.int32()), *parts], [*key, "copies", "nth", "text", "at_end"])

    chunks = (
        whole.select(*key, "copies", "text")
        .mapInArrow(chunks_of, "doc_id long, digest string, copies long, nth int, text string, at_end boolean")
        .repartition(*key, "nth")
    )

    def bounds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        for batch in batches:
            found = [
                chunk_bounds(t, end, overlap, split)
                for t, end in zip(column_of(batch, "text").to_pylist(), column_of(batch, "at_end").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *(column_of(batch, n) for n in (*key, "copies", "nth", "text")),
                    pa.array([f[0] for f in found], pa.list_(pa.int32())),
                    pa.array([f[1] for f in found], pa.list_(pa.int32())),
                ],
                [*key, "copies", "nth", "text", "head", "tail"],
            )

    bounds = chunks.mapInArrow(
        bounds_of, "doc_id long, digest string, copies long, nth int, text string, head array<int>, tail array<int>"
    )
    # A stitch is the first boundary, counted from this chunk's start, that the chunk before has too.
    in_order = Window.partitionBy(*key).orderBy("nth")
    stitched = bounds.withColumn("tail", F.lag("tail").over(in_order)).withColumn(
        "stitch",
        F.when(F.col("nth") == 0, F.lit(0)).otherwise(
            F.array_min(F.array_intersect("head", F.transform("tail", lambda b: b - step)))
        ),
    )
    # Chunks without a stitch go on with the piece before; the overlap is cut away.
    pieces = (
        stitched.withColumn("piece", F.count("stitch").over(in_order))
        .withColumn("next", F.lead("stitch").over(in_order))
        .withColumn("last", F.lead("nth").over(in_order).isNull())
        .select(
            *key,
            "copies",
            "piece",
            "nth",
            F.expr("""substring(text, coalesce(stitch, 0) + 1, CASE WHEN last THEN length(text)
                ELSE %d + coalesce(next, 0) - coalesce(stitch, 0) END)""" % step).alias("text"),
        )
        .groupBy(*key, "copies", "piece")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda c: c.text), "").alias("text"))
    )
    encoded = pieces.mapInArrow(ids_of, "doc_id long, digest string, copies long, piece long, ids array<int>")
    joined = encoded.groupBy(*key, "copies").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda c: c.ids)).alias("ids")
    )
    again = joined.select("doc_id", "ids", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("col")
    return short.unionByName(again)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Replace ids by the bytes they stand for (column ``decoded``), one row per row.

    Null or empty ids give no bytes; an id the ranks don't have is an error.
    """
    kept = [c for c in encoded.columns if c not in ("ids", "decoded")]

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(ranks_path, pattern)
        for batch in batches:
            out = [own.decode_bytes(ids or []) for ids in column_of(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(column_of(batch, n) for n in kept), column_of(batch, "ids"), pa.array(out, pa.binary())],
                [*kept, "ids", "decoded"],
            )

    schema = encoded.select(*kept, "ids").schema.add("decoded", "binary")
    return encoded.select(*kept, "ids").mapInArrow(bytes_of, schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, decode and give doc_id, n_tokens, ids_sha256 and decoded_sha256 per row."""
    decoded = decode(encode(docs, ranks_path, pattern), ranks_path, pattern)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
