"""Benchmark decontamination by the q-gram lemma.

A benchmark item of n characters that stands in a text with at most e edits
shares at least (n - q + 1) - q e of its q-grams with the text there, and their
diagonals (place in the text less place in the item) differ by at most e.  For
every text the shared q-grams are counted in diagonal bands of width 2 e that
overlap by e, so that any such match lies in one band whole.  Bands with enough
q-grams are kept, and a banded alignment finds the match and its edits.

Items of fewer than q characters allow no edits; their one gram is the whole
item, and it counts only between characters that are no letters or digits.

Characters are compared in lower case, and any white space counts as a space;
places are those of the text itself.  Only whole items within the edit budget
count: an excerpt of an item is not reported.

Scale: the texts are read once, and nothing is shuffled.  The benchmark goes to
the tasks in blocks of at most about ``block_chars`` characters, one Python
worker (some 50 bytes a character) a block after the other in the same stage, so
a benchmark of many blocks takes more memory a task but no further scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_of, fresh, slices, small_batches

Q = 12
#: Edits allowed, as a share of an item's characters.
EDIT_SHARE = 0.05
#: Characters of the benchmark that are sent to the tasks at once.
BLOCK_CHARS = 4 << 20
#: Bits of the filter that most of a text's q-grams don't pass.
FILTER_BITS = 22

#: White space up to U+3000; the last entry stands for all code points beyond.
_WHITE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def characters(text: str) -> np.ndarray:
    """Code points in lower case, with plain spaces; one for each of the text's own."""
    low = "\u0130".join(part.lower() for part in text.split("\u0130"))  # the one letter whose lower case is two characters stays
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points == 0x3C2, np.uint32(0x3C3), points)  # lower() makes a sigma final by what follows
    return np.where(_WHITE[np.minimum(points, np.uint32(0x3001))], np.uint32(32), points)


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams (q at least 1), by doubling and one overlap."""
    h, width = points.astype(np.uint64) + np.uint64(1), 1
    if len(h) < q:
        return np.zeros(0, np.uint64)
    while width < q:
        step = min(width, q - width)
        h = mixed_pair(h[:-step], h[step:])
        width += step
    return h


def mixed_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class Index:
    """A block of the benchmark: its items, and where each q-gram stands in them."""

    q: int
    items: list[np.ndarray]
    edits: np.ndarray
    needed: np.ndarray
    grams: np.ndarray  # distinct hashes, ascending
    first: np.ndarray  # where a hash's entries begin below
    item: np.ndarray
    place: np.ndarray
    passes: np.ndarray  # by the hash's leading bits


def build_index(items: list[np.ndarray], q: int, edit_share: float) -> Index:
    n = np.array([len(x) for x in items], np.int64)
    edits = np.minimum((n * edit_share).astype(np.int64), np.maximum(n - q, 0) // q)  # the lemma says nothing beyond
    needed = n - q + 1 - q * edits
    hashes = [gram_hashes(x, q) for x in items]
    every = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
    place = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, np.int64)])
    order = np.argsort(every, kind="stable")
    grams, first = np.unique(every[order], return_index=True)
    passes = np.zeros(1 << FILTER_BITS, bool)
    passes[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Index(q, items, edits, needed, grams, np.append(first, len(every)), item[order].astype(np.int32), place[order].astype(np.int32), passes)


def build_indexes(texts: list[str], q: int, edit_share: float) -> list[tuple[Index, list[int]]]:
    """An index of the items of at least q characters, one for each lesser length, and the items' numbers in texts."""
    items = [characters(t) for t in texts]
    own = [min(len(x), q) for x in items]
    lengths = sorted(set(own) - {0}, reverse=True)
    parts = [[n for n, k in enumerate(own) if k == length] for length in lengths]
    return [(build_index([items[n] for n in part], length, edit_share), part) for length, part in zip(lengths, parts, strict=True)]


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """The best match of the whole item in text on diagonals low to high: (edits, start, end).

    A banded alignment that may start and end anywhere in the text; None if it
    takes over ``most`` edits.
    """
    n, width, far = len(item), high - low + 1, 1 << 30
    for d in range(max(low, 0), min(high, len(text) - n) + 1):  # a diagonal without edits needs no table
        if text[d] == item[0] and np.array_equal(text[d : d + n], item):
            return 0, d, d + n
    at = np.arange(low, high + 1)  # the text place that stands before row 0
    usable = (at >= 0) & (at <= len(text))
    cost, start = np.where(usable, 0, far), at.copy()
    padded = np.concatenate([text, np.zeros(1, text.dtype)])
    slots = np.arange(width)
    for i in range(n):
        j = at + i  # the text character matched with item[i]
        inside = (j >= 0) & (j < len(text))
        step = cost + np.where(inside & (padded[np.clip(j, 0, len(text))] == item[i]), 0, 1)
        step[~inside] = far
        up = np.append(cost[1:] + 1, far)  # item[i] has no partner
        new = np.where(up < step, up, step)
        origin = np.where(up < step, np.append(start[1:], 0), start)
        # Text characters without a partner: each slot from the best one to its left.
        base = new - slots
        best = np.minimum.accumulate(base)
        source = np.maximum.accumulate(np.where(base == best, slots, 0))
        cost, start = best + slots, origin[source]
        cost = np.where(cost >= far // 2, far, cost)
    end = at + n
    ok = (end >= 0) & (end <= len(text)) & (cost <= most)
    if not ok.any():
        return None
    k = int(np.argmin(np.where(ok, cost, far)))
    return int(cost[k]), int(start[k]), int(end[k])


def matches_in(texts: list[str], indexes: list[tuple[Index, list[int]]], q: int = Q) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of every item found in the texts; overlapping finds of an item count once."""
    points = [characters(t) for t in texts]
    found = [(text, numbers[item], *place) for index, numbers in indexes for text, item, *place in matches_of(points, index)]
    short = {n for index, numbers in indexes if index.q < q for n in numbers}
    return sorted(f for f in found if f[1] not in short or stands_alone(texts[f[0]], f[2], f[3]))


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit goes on before or after."""
    return not (text[start - 1 : start].isalnum() or text[end : end + 1].isalnum())


def matches_of(points: list[np.ndarray], index: Index) -> list[tuple[int, int, int, int, int]]:
    q = index.q
    offs = np.cumsum([0, *map(len, points)])
    whole = np.concatenate([*points, np.zeros(0, np.uint32)])
    hashes = gram_hashes(whole, q)
    if len(hashes) == 0 or len(index.grams) == 0:
        return []
    at = np.flatnonzero(index.passes[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    slot = np.minimum(np.searchsorted(index.grams, hashes[at]), len(index.grams) - 1)
    real = index.grams[slot] == hashes[at]
    at, slot = at[real], slot[real]
    text = np.searchsorted(offs, at, "right") - 1
    inner = at + q <= offs[text + 1]
    at, slot, text = at[inner], slot[inner], text[inner]
    count = index.first[slot + 1] - index.first[slot]
    hit = np.repeat(np.arange(len(at)), count)
    entry = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count) + index.first[slot][hit]
    item, place, text = index.item[entry], index.place[entry], text[hit]
    diagonal = at[hit] - offs[text] - place
    half = np.maximum(index.edits[item], 1)
    found: list[tuple[int, int, int, int, int]] = []
    # Bands [k h, (k + 2) h): each diagonal is in two.
    band = np.concatenate([diagonal // half, diagonal // half - 1])
    text2, item2 = np.tile(text, 2), np.tile(item, 2)
    order = np.lexsort((band, item2, text2))
    t, i, b = text2[order], item2[order], band[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])]) if len(t) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    number = np.diff(np.append(begin, len(t)))
    last: dict[tuple[int, int], int] = {}
    for k in begin[number >= index.needed[i[begin]]]:
        here, what, h = int(t[k]), int(i[k]), int(max(index.edits[i[k]], 1))
        low, high = int(b[k]) * h - h, int(b[k]) * h + 3 * h
        if last.get((here, what), -1) > low + len(index.items[what]) // 2:
            continue  # the band beside it has found this one
        hit_at = align(index.items[what], points[here], low, high, int(index.edits[what]))
        if hit_at:
            edits, start, end = hit_at
            if start < last.get((here, what), -1):
                continue
            last[here, what] = end
            found.append((here, what, start, end, edits))
    return found


def blocks_of(benchmark: DataFrame, block_chars: int) -> list[int]:
    """Block numbers; an item's block follows from its id and the benchmark's size."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    return list(range(max(1, -(-size // block_chars))))


FINDS = T.ArrayType(
    T.StructType().add("item_id", "long").add("start", "integer").add("end", "integer").add("edits", "integer"), containsNull=False
)


def with_finds(docs: DataFrame, benchmark: DataFrame, name: str, q: int, edit_share: float, block_chars: int) -> DataFrame:
    """docs and, in the column ``name``, the places of items in each row's text, in order."""
    small_batches(docs.sparkSession)
    items = benchmark.select("item_id", "text").where("text <> ''")
    numbers = blocks_of(items, block_chars)
    kept = docs.columns
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))

    def of_block(rows: DataFrame, number: int) -> DataFrame:
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), len(numbers)) == number).collect()  # about block_chars
        sent = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in block])

        def finds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = [i for i, _ in sent.value]
            indexes = build_indexes([t for _, t in sent.value], q, edit_share)
            for batch in batches:
                for part in slices(batch):
                    before = column_of(part, name).to_pylist() if number else [[] for _ in range(part.num_rows)]
                    for text, item, start, end, edits in matches_in([t or "" for t in column_of(part, "text").to_pylist()], indexes, q):
                        before[text].append({"item_id": ids[item], "start": start, "end": end, "edits": edits})
                    yield pa.RecordBatch.from_arrays([*(column_of(part, c) for c in kept), pa.array(before, kind)], [*kept, name])

        return rows.mapInArrow(finds, docs.select("*").schema.add(name, FINDS))  # add changes the schema it is called on

    return reduce(of_block, numbers, docs)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row per place of an item in a row of docs: doc_id, text_crc, item_id, start, end, edits.

    start and end are characters of the text.  Null and empty texts and items
    have no places.  Rows equal in id and text give equal rows; null ids of
    documents and items stay null; items that share a text are all found.
    Without docs or items there are no rows.  A very long text is worked on
    whole by one task, at some 60 times its own memory.  Other columns are
    ignored.
    """
    found = with_finds(docs.select("doc_id", "text").where("text <> ''"), benchmark, "found", q, edit_share, block_chars)
    return found.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("text_crc"), F.explode("found").alias("f")).select(
        "doc_id", "text_crc", "f.*"
    )


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """docs with every benchmark passage cut out; no row goes.

    n_chars, where docs has it, is counted again for texts that changed.  Edge
    cases as in find_leaks; other columns stay, whatever their names.
    """
    (name,) = fresh(docs, "found")
    joined = with_finds(docs, benchmark, name, q, edit_share, block_chars)
    # Fold the spans in order: what lies before each is kept, and the next begins where the furthest has ended.
    cut = F.expr(f"""aggregate(array_sort(transform(`{name}`, s -> struct(s.start AS start, s.end AS end))), struct('' AS kept, 0 AS at),
        (a, s) -> struct(concat(a.kept, substring(text, a.at + 1, greatest(s.start - a.at, 0))) AS kept, greatest(a.at, s.end) AS at),
        a -> concat(a.kept, substring(text, a.at + 1, length(text))))""")
    changed = F.size(name) > 0
    new = {"text": F.when(changed, cut).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length(cut).cast(kind)).otherwise(F.col("n_chars"))
    return joined.withColumns(new).select(*docs.columns)
