"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text.  A word's start is a cut where the
hash of the 16 bytes before it is the least among the starts of the words
around it.  Cuts so depend on nearby bytes alone: after an insertion the
chunks are the same again some words later, and a passage that two texts share
falls into the same chunks in either, but for a few words at its ends.

Chunks are told apart by 64-bit digests.  A digest's first holder is the row
with the least doc_id.  Neighbouring repeated chunks form runs; a run of at
least ``min_words`` words is a repeated passage, and is cut out of all rows but
its first holder.

Scale: pass one counts digests (partial sums on the map side; a digest that
very many texts share is a few rows after that).  Pass two makes the chunks
again and joins them with the repeated digests; its one frequent side is split
by skew handling.  Only then are the spans of each row brought to its text.
No pairs of texts are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_of, fresh, segment_hashes, slices, small_batches, split_words, text_buffers

#: Words that a cut is the least among on either side.
REACH = 3
#: Most words of a chunk; text that repeats itself has no natural cuts.
MOST_WORDS = 64
#: Least words of a passage that is cut out.  Of a passage of 51 words between other words 28 are found as often as 22.
MIN_WORDS = 28

GEAR = np.random.default_rng(7).integers(0, 1 << 16, 256, dtype=np.uint16)
_LAST = np.iinfo(np.uint32).max


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash (16 bits) of the 16 bytes up to it: h = 2 h + gear[byte]."""
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        rolled = h.copy()
        rolled[width:] += h[:-width] << np.uint16(width)
        h = rolled
    return h


def chunk_starts(data: np.ndarray, offs: np.ndarray, words: np.ndarray, doc: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Which words begin a chunk: a text's first one, cuts, and every MOST_WORDS-th without one."""
    n = len(words)
    h = np.full(n, _LAST, np.uint32)
    inner = np.flatnonzero(words - offs[doc] >= 16)  # the hash sees no other text's bytes
    h[inner] = gear_hashes(data)[words[inner] - 1]
    cut = np.ones(n, bool)
    for k in range(1, reach + 1):
        if k < n:
            near = doc[k:] == doc[:-k]
            cut[k:] &= ~near | (h[k:] < h[:-k])
            cut[:-k] &= ~near | (h[:-k] <= h[k:])
    cut |= np.concatenate([[True], doc[1:] != doc[:-1]])
    at = np.flatnonzero(cut)
    since = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    return cut | ((since > 0) & (since % MOST_WORDS == 0))


def chunks_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digest, text number, start and end (bytes inside the text) of each chunk.

    A chunk goes from its first word's start to its last word's end: white
    space between chunks belongs to none.
    """
    words, ends, doc = split_words(data, offs)
    if len(words) == 0:
        return np.zeros(0, np.uint64), doc, words, ends
    at = np.flatnonzero(chunk_starts(data, offs, words, doc))
    last = np.append(at[1:], len(words)) - 1
    starts, stops, text = words[at], ends[last], doc[at]
    return segment_hashes(data, starts, stops), text, starts - offs[text], stops - offs[text]


def keyed(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs and two columns of these names: 128 bits of a row's id and text."""
    text = F.col("text")
    return docs.withColumns({names[0]: F.xxhash64("doc_id", text), names[1]: F.xxhash64(F.lit(1), text, "doc_id")})


def chunk_rows(docs: DataFrame, kept: list[str], spans: bool) -> DataFrame:
    """digest, the kept columns and, with ``spans``, span (start and end in one number) of every chunk of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                digest, text, start, stop = chunks_of(*text_buffers(column_of(part, "text")))
                at = pa.array(text)
                own = [column_of(part, n).take(at) for n in kept] + ([pa.array((start << 32) | stop)] if spans else [])
                yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), *own], names)

    names = ["digest", *kept, *(["span"] if spans else [])]
    return docs.select(*kept, "text").where("text IS NOT NULL").mapInArrow(rows, ", ".join(f"{n} long" for n in names))


def runs(text: bytes, marked: list[tuple[int, int]], min_words: int) -> tuple[list[tuple[int, int]], int]:
    """Runs of neighbouring chunks with enough words, and how many words they have."""
    found: list[list[int]] = []
    for start, stop in marked:
        if found and not text[found[-1][1] : start].strip(b"\t\n\v\f\r "):
            found[-1][1] = stop
        else:
            found.append([start, stop])
    kept = [(s, e, len(text[s:e].split())) for s, e in found]
    kept = [(s, e, n) for s, e, n in kept if n >= min_words]
    return [(s, e) for s, e, _ in kept], sum(n for _, _, n in kept)


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans and the white space after each."""
    kept, at = [], 0
    for start, stop in [*spans, (len(text), len(text))]:
        piece = text[at:start]
        kept.append(piece.lstrip(b"\t\n\v\f\r ") if at else piece)  # the space before the span stays
        at = stop
    return b"".join(kept)


def repeated_digests(docs: DataFrame) -> DataFrame:
    """digest and first_id (least doc_id) of all chunks that occur more than once."""
    chunks = chunk_rows(docs, ["doc_id"], spans=False)
    return chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1").drop("n")


def marks(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """k and l (128 bits of a row's id and text) and marks: its chunks with a repeated digest.

    A set, as rows equal in id and text all bring the same: no more than the text's own chunks.
    """
    chunks = chunk_rows(keyed(docs.select("doc_id", "text"), ["k", "l"]), ["k", "l"], spans=True)
    return chunks.join(repeated, "digest").groupBy("k", "l").agg(F.collect_set(F.struct("span", "digest", "first_id")).alias("marks"))


def _cleaned(docs: DataFrame, min_words: int, how: str, out: list[str]) -> DataFrame:
    """docs' columns with text without its repeated passages, and words repeated and removed, spans and first holders as ``out``."""
    small_batches(docs.sparkSession)
    (k, l, own_marks) = fresh(docs, "k", "l", "marks")
    marked = marks(docs, repeated_digests(docs)).toDF(k, l, own_marks)
    joined = keyed(docs, [k, l]).join(marked, [k, l], how)
    kept = [c for c in docs.columns if c != "text"]
    pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def clean_text(doc_id: int | None, text: str | None, marks: list[dict] | None) -> tuple:
        if not marks:
            return text, 0, 0, [], []
        raw, seen, every, later = text.encode(), set(), [], []
        for span, digest, first_id in sorted({(m["span"], m["digest"], m["first_id"]) for m in marks}, key=lambda m: m[0]):
            place = (span >> 32, span & 0xFFFFFFFF)
            every.append(place)
            if first_id != doc_id or digest in seen:
                later.append(place)
            seen.add(digest)
        _, repeated_words = runs(raw, every, min_words)
        spans, removed = runs(raw, later, min_words)
        first = {m["first_id"] for m in marks if any(s <= m["span"] >> 32 < e for s, e in spans)} - {None}
        cut = cut_out(raw, spans).decode() if spans else text
        return cut, repeated_words, removed, [{"start": s, "end": e} for s, e in spans], sorted(first)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = (column_of(part, n).to_pylist() for n in ("doc_id", "text", own_marks))
                found = list(zip(*map(clean_text, *own), strict=True))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pair), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(column_of(part, n) for n in kept), *map(pa.array, found, kinds)], [*kept, "text", *out]
                )

    span = T.StructType().add("start", "integer").add("end", "integer")
    schema = docs.select(*kept).schema.add("text", "string").add(out[0], "long").add(out[1], "long")
    schema = schema.add(out[2], T.ArrayType(span)).add(out[3], T.ArrayType(T.LongType()))
    return joined.select(*kept, "text", own_marks).mapInArrow(clean, schema)


def find_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs that hold a repeated passage.

    Columns: doc_id, text_crc (CRC of the whole text), text (without the
    passages cut out), n_words_repeated (in passages that other places hold
    too), n_words_removed (not at the first holder), spans (bytes removed:
    start, end) and first_ids (first holders of what was removed).

    Null, empty and blank texts have no passages.  Rows equal in id and text
    are listed as repeats of each other, but what they hold first stays in
    all of them.  Rows that share an id but not the text keep what they share
    with each other.  Null ids are first holders only among themselves.  Within
    one text, all but the first of repeated passages go.  An empty table gives
    no rows.  A very long text is worked on whole by one task.  Other columns
    are ignored.
    """
    own = docs.select("doc_id", "text", F.crc32(F.col("text").cast("binary")).alias("text_crc"))
    found = _cleaned(own, min_words, "inner", ["n_words_repeated", "n_words_removed", "spans", "first_ids"])
    return found.where("n_words_repeated > 0").select(
        "doc_id", "text_crc", "text", "n_words_repeated", "n_words_removed", "spans", "first_ids"
    )


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with every repeated passage cut out of all rows but its first holder; no row goes.

    n_chars, where docs has it, is counted again for texts that changed.  Edge
    cases as in find_repeats; a text that is all repeats becomes empty.  Other
    columns stay, whatever their names.
    """
    out = fresh(docs, "repeated", "removed", "spans", "first_ids")
    cleaned = _cleaned(docs, min_words, "left", out)
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(out[1]) > 0, n).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)
