"""Helpers shared by the text operators: session settings and Arrow/numpy views of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.checkpoints import written as materialise  # noqa: F401

#: Text of one numpy pass; its temporaries take about 60 times as much.
SLICE_BYTES = 1 << 20
#: Rows of one Arrow batch between Spark and Python; texts are long.
BATCH_ROWS = 1000

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small; leaves a smaller setting as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These column names, with underscores in front until df has none of them (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def fold_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets between them; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with at most so many bytes of text, or one row."""
    _, offs = text_buffers(batch.column(batch.schema.get_field_index(column)))
    at, rows = 0, batch.num_rows
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def per_text(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of the byte-wise values of each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def split_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes that aren't white space."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    word = ~WHITE[data]
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; segments are in order and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    full = np.flatnonzero(ends > starts)
    if len(full) == 0:
        return out
    s, e = starts[full], ends[full]
    values = np.zeros(len(data) + 1, np.uint64)
    values[:-1] = BYTE_VALUE[data]
    place = np.arange(len(data))
    place[s[0] :] -= np.repeat(s, np.diff(np.append(s, len(data))))
    values[:-1] *= _POWERS[place & 0xFFFF]
    pairs = np.empty(2 * len(s), np.int64)
    pairs[0::2], pairs[1::2] = s, e
    out[full] = mixed(np.add.reduceat(values, pairs)[::2] + (e - s).astype(np.uint64))
    return out


def window_hashes(words: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of so many words, and the number of each one's first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[:n].copy()
    for k in range(1, width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : n + k]
    at = np.flatnonzero(text[:n] == text[width - 1 :])
    return mixed(h[at]), at


def split_lines(data: np.ndarray, offs: np.ndarray, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (without the line feed) and text number of each line that has a word."""
    if len(data) == 0:
        return (np.zeros(0, np.int64),) * 3
    starts = np.unique(np.concatenate([offs[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[ends - 1] == 10)
    words = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[words], ends[words]
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def again(keys: np.ndarray, text: np.ndarray, first_too: bool) -> np.ndarray:
    """Which keys occur earlier in the same text (or, first_too, elsewhere in it)."""
    order = np.lexsort((keys, text))
    same = (keys[order][1:] == keys[order][:-1]) & (text[order][1:] == text[order][:-1])
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    if first_too:
        out[order[:-1][same]] = True
    return out


def byte_characters() -> list[str]:
    """The characters that stand for the bytes 0 to 255 in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the others for the characters from 256 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each stretch, one stretch after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Pieces:
    """Arrays of different lengths in one flat array that grows."""

    def __init__(self, kind: type) -> None:
        self.flat, self.starts, self.lengths = np.zeros(1024, kind), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.values = self.count = 0

    def __len__(self) -> int:
        return self.count

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        """Append pieces of these lengths that lie in values one after the other."""
        values_then, count_then = self.values + len(values), self.count + len(lengths)
        if values_then > len(self.flat):
            self.flat = np.append(self.flat[: self.values], np.zeros(2 * values_then - self.values, self.flat.dtype))
        if count_then > len(self.starts):
            more = np.zeros(2 * count_then - self.count, np.int64)
            self.starts, self.lengths = np.append(self.starts[: self.count], more), np.append(self.lengths[: self.count], more)
        self.flat[self.values : values_then] = values
        self.starts[self.count : count_then] = self.values + np.cumsum(lengths) - lengths
        self.lengths[self.count : count_then] = lengths
        self.values, self.count = values_then, count_then

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of these numbers one after the other, and their lengths."""
        lengths = self.lengths[numbers]
        return self.flat[gathered(self.starts[numbers], lengths)], lengths
