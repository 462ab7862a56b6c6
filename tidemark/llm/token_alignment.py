"""Two tokenizers' tokens of the same texts, aligned by their bytes.

A is a byte-level BPE file of the ``tokenizers`` library, B a ``sentencepiece``
model that adds a space in front; both see the same bytes, a space and the text.
Where a token of A and one of B end at the same byte, a group ends.

**Encoding.** A space after anything but white space begins a new token in both
vocabularies (a pattern never looks back, no piece has a space behind another
character), so texts are cut there, and the distinct units of a pass are encoded once.

**Diagonal run skipping.** The end offsets of all tokens of a pass lie in one array
per tokenizer.  Lanes of some units each are walked side by side: at the lane's
current index shift, stretches of 1, 2, 4, ... ends are compared, so that one-to-one
stretches are jumped over in a few steps.  At the first ends that differ, the token
that lags is stepped over until both end together; that is the irregular group, and
it sets the shift from which the next stretch is probed.

**Counts over the corpus.** Each pass writes a dictionary of its distinct id pairs with the
number of its texts that hold them, and its rows refer to the dictionary.  Only dictionaries
are summed and joined; the values come back to the pass by its number.  What is
written goes to the folder that the cluster shares and is read twice.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.checkpoints import new_folder

from .common import Pieces, byte_characters, column_of, gathered, slices, small_batches, text_buffers

#: Bytes of text in one pass.
PASS_BYTES = 1 << 21
#: Units in one lane.
LANE_UNITS = 64
#: A worker forgets the units it knows when they are so many, or hold so many tokens.
MOST_UNITS = 300_000
MOST_TOKENS = 4_000_000

_SPACE = "▁"
_loaded: dict[tuple[str, str, str], Tokenizers] = {}


def shared_ends(ends_a: np.ndarray, ends_b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of A and of B end where one of the other ends.

    ``from_a`` and ``from_b`` are the first tokens of the lanes and, last, the
    numbers of tokens: there both have an end in common.
    """
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    at_a, at_b, to_a, to_b = from_a[:-1].copy(), from_b[:-1].copy(), from_a[1:], from_b[1:]
    width = np.ones(len(at_a), np.int64)
    lanes = np.flatnonzero(at_a < to_a)
    while len(lanes):
        a, b = at_a[lanes], at_b[lanes]
        probed = np.minimum(width[lanes], np.minimum(to_a[lanes] - a, to_b[lanes] - b))
        first = np.cumsum(probed) - probed
        in_a, in_b = gathered(a, probed), gathered(b, probed)
        differs = np.flatnonzero(ends_a[in_a] != ends_b[in_b])
        run = np.minimum(np.append(differs, len(in_a))[np.searchsorted(differs, first)] - first, probed)
        ran = gathered(first, run)
        cut_a[in_a[ran]] = cut_b[in_b[ran]] = True
        a, b = a + run, b + run
        whole = run == probed
        width[lanes] = np.where(whole, 2 * width[lanes], 1)
        open_ = np.flatnonzero(~whole)
        while len(open_):
            end_a, end_b = ends_a[a[open_]], ends_b[b[open_]]
            together = end_a == end_b
            met = open_[together]
            cut_a[a[met]] = cut_b[b[met]] = True
            a[met] += 1
            b[met] += 1
            a[open_] += end_a < end_b
            b[open_] += end_b < end_a
            open_ = open_[~together]
        at_a[lanes], at_b[lanes] = a, b
        lanes = lanes[a < to_a[lanes]]
    return cut_a, cut_b


class Tokenizers:
    """Both vocabularies, the bytes of their tokens, and the units met so far."""

    def __init__(self, json_path: str, model_path: str, pattern: str) -> None:
        with open(json_path, encoding="utf-8") as lines:
            file = json.load(lines)
        if file["normalizer"] or file["pre_tokenizer"].get("type") != "ByteLevel" or file["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{json_path} isn't a byte-level vocabulary of unchanged text")
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = file["model"]["vocab"]
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in vocabulary.items()}
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in file["model"]["merges"]]
        if len(ranks) != len(vocabulary) or made != list(range(256, 256 + len(made))):
            raise ValueError(f"the ids of {json_path} don't follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        in_b = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(_SPACE in p.lstrip(_SPACE) for p in in_b):
            raise ValueError(f"{model_path} has pieces with a space behind another character")
        self.single_space = self.b.piece_to_id(_SPACE)
        as_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(in_b)]
        self.bytes_b = Pieces(np.uint8)
        self.bytes_b.add(np.frombuffer(b"".join(as_bytes), np.uint8), np.array([len(p) for p in as_bytes]))
        in_a = sorted(ranks, key=ranks.__getitem__)
        self.length_a, self.length_b = np.array([len(t) for t in in_a]), np.array([len(t) for t in as_bytes])
        self.size_a, self.size_b = len(in_a), len(as_bytes)
        shown = [f"{i}{after}" for after, size in ((",", self.size_a), ("|", self.size_a), (",", self.size_b), (";", self.size_b)) for i in range(size)]
        self.shown = np.array(shown, "S")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids_a, self.ids_b, self.right = Pieces(np.int32), Pieces(np.int32), Pieces(np.bool_)

    def learn(self, units: list[str]) -> None:
        """Encode units, which begin with a space, and keep their ids and whether B's bytes are theirs."""
        found_a = [self.a.encode_ordinary(u) for u in units]
        found_b = [f or [self.single_space] for f in self.b.encode([u[1:] for u in units], num_threads=1)]
        for kept, found in (self.ids_a, found_a), (self.ids_b, found_b):
            kept.add(np.fromiter(chain.from_iterable(found), np.int32), np.array(list(map(len, found))))
        encoded = [u.encode() for u in units]
        length = np.array(list(map(len, encoded)))
        ids, tokens = self.ids_b.take(np.arange(len(self.known), len(self.known) + len(units)))
        ends = np.append(0, np.cumsum(self.length_b[ids]))[np.append(0, np.cumsum(tokens))]
        right = np.diff(ends) == length
        of_ids = np.repeat(right, tokens)
        got = self.bytes_b.take(ids[of_ids])[0]
        want = np.frombuffer(b"".join(u for u, r in zip(encoded, right, strict=True) if r), np.uint8)
        wrong = np.bincount(np.repeat(np.flatnonzero(right), length[right])[got != want], minlength=len(units))
        self.right.add(right & (wrong == 0), np.ones(len(units), np.int64))
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))


def loaded(json_path: str, model_path: str, pattern: str) -> Tokenizers:
    """Both tokenizers, read once by each Python worker."""
    key = json_path, model_path, pattern
    if key not in _loaded:
        _loaded[key] = Tokenizers(*key)
    return _loaded[key]


def unit_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where units begin: each text, and each space behind a byte that surely ends no white space."""
    before = np.zeros(len(data), np.uint8)
    before[1:] = data[:-1]
    at = np.flatnonzero((data == 0x20) & (before > 0x20))
    last, second, third = data[at - 1], data[at - 2], data[at - 3]
    white = ((last == 0x85) | (last == 0xA0)) & (second == 0xC2)  # two bytes
    white |= (last >= 0x80) & np.isin(third, (0xE1, 0xE2, 0xE3)) & np.isin(second, (0x80, 0x81, 0x9A))  # three, and some that aren't
    starts = np.zeros(len(data) + 1, bool)
    starts[at[~white]] = True
    starts[offs] = True
    return np.flatnonzero(starts[:-1])


def aligned_pass(own: Tokenizers, texts: pa.Array) -> dict[str, np.ndarray | list]:
    """The columns of a pass, one value per text; every text begins with a space and goes on."""
    if len(own.known) > MOST_UNITS or max(own.ids_a.values, own.ids_b.values) > MOST_TOKENS:
        own.forget()
    data, offs = text_buffers(texts)
    starts = unit_starts(data, offs)
    units = pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]
    ).dictionary_encode()
    distinct = units.dictionary.to_pylist()
    new = [u for u in distinct if u not in own.known]
    if new:
        own.learn(new)
    place = np.fromiter(map(own.known.__getitem__, distinct), np.int64, len(distinct))[units.indices.to_numpy()]
    text = np.searchsorted(offs, starts, "right") - 1
    wrong = np.bincount(text[~own.right.flat[place]], minlength=len(texts)) > 0
    stay = ~wrong[text]
    place, text = place[stay], text[stay]

    ids_a, tokens_a = own.ids_a.take(place)
    ids_b, tokens_b = own.ids_b.take(place)
    ends_a, ends_b = np.cumsum(own.length_a[ids_a]), np.cumsum(own.length_b[ids_b])
    before_a, before_b = np.append(0, np.cumsum(tokens_a)), np.append(0, np.cumsum(tokens_b))
    of_text = np.searchsorted(text, np.arange(len(texts) + 1))
    nth = np.arange(len(text)) - of_text[text]
    lanes = np.append(np.flatnonzero(nth % LANE_UNITS == 0), len(text))
    cut_a, cut_b = shared_ends(ends_a, ends_b, before_a[lanes], before_b[lanes])

    from_a, from_b = before_a[of_text], before_b[of_text]
    n_a, n_b = np.diff(from_a), np.diff(from_b)
    groups_before = np.append(0, np.cumsum(cut_a))
    n_groups = np.diff(groups_before[from_a])

    # In writing, a token stands behind all tokens of earlier groups, B's also behind A's of its own.
    last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
    group_a = groups_before[:-1]
    group_b = np.append(0, np.cumsum(cut_b))[:-1]
    written = np.empty(len(ids_a) + len(ids_b), np.int64)
    written[np.arange(len(ids_a)) + np.append(0, last_b + 1)[group_a]] = ids_a + np.where(cut_a, own.size_a, 0)
    written[np.arange(len(ids_b)) + (last_a + 1)[group_b]] = 2 * own.size_a + ids_b + np.where(cut_b, own.size_b, 0)
    bounds = from_a + from_b
    groups = [own.shown[written[s:e]].tobytes().translate(None, b"\0")[:-1].decode() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]

    # Bytes of two tokens overlap once for each end of either: at the ends of A, and at those of B that aren't A's.
    inner_b = np.flatnonzero(~cut_b)
    link_a = np.concatenate([np.arange(len(ids_a)), np.searchsorted(ends_a, ends_b[inner_b])])
    link_b = np.concatenate([np.searchsorted(ends_b, ends_a), inner_b])
    pairs = pa.array(ids_a[link_a].astype(np.int64) * own.size_b + ids_b[link_b]).dictionary_encode()
    size = max(len(pairs.dictionary), 1)
    links = np.sort((np.searchsorted(from_a, link_a, "right") - 1) * size + pairs.indices.to_numpy())
    begins = np.flatnonzero(np.append(True, links[1:] != links[:-1])[: len(links)])
    times = np.diff(np.append(begins, len(links)))
    links = links[begins]
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups, "groups": groups,
        "links": links % size, "times": times, "links_from": np.searchsorted(links // size, np.arange(len(texts) + 1)),
        "pairs": pairs.dictionary.to_numpy(), "holders": np.bincount(links % size, minlength=len(pairs.dictionary)),
    }


COUNTS = "n_a long, n_b long, n_groups long, n_links long"
_ROWS = f"pass long, doc_id long, {COUNTS}, groups string, links array<int>, times array<int>, pairs array<long>, holders array<int>"


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def passes(docs: DataFrame, json_path: str, model_path: str, pattern: str, digest: bool) -> DataFrame:
    """One row per row of docs with its counts, groups (or their digest) and links.

    ``links`` are numbers of pairs (A's id times the size of B's vocabulary, plus B's) in the
    dictionary of the pass, ``times`` how often the text has each.  The dictionary,
    with the number of texts that hold each pair, is on the first row of a pass.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.concat(F.lit(" "), F.coalesce(F.col("text"), F.lit(""))).alias("text"))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done = loaded(json_path, model_path, pattern), 0
        for batch in batches:
            for part in slices(batch, most=PASS_BYTES):
                number = TaskContext.get().partitionId() * (1 << 32) + done
                done += 1
                yield rows_of_pass(own, part, number, digest)

    return texts.mapInArrow(rows_of, _ROWS)


def rows_of_pass(own: Tokenizers, part: pa.RecordBatch, number: int, digest: bool) -> pa.RecordBatch:
    """A pass as rows; a text that is empty but for its space has no tokens."""
    texts = column_of(part, "text")
    full = np.flatnonzero(np.diff(text_buffers(texts)[1]) > 1)
    found = aligned_pass(own, texts.take(pa.array(full))) if len(full) else None
    counts = {n: np.zeros(len(texts), np.int64) for n in ("n_a", "n_b", "n_groups", "n_links")}
    groups, from_ = np.full(len(texts), "", object), np.zeros(len(texts) + 1, np.int64)
    none = np.zeros(0, np.int64)
    links = times = pairs = holders = none
    if found:
        for n in counts:
            counts[n][full] = found[n]
        groups[full] = [hashlib.sha256(g.encode()).hexdigest() if g and digest else g for g in found["groups"]]
        from_[full + 1] = np.diff(found["links_from"])
        from_ = np.cumsum(from_)
        links, times, pairs, holders = (found[n] for n in ("links", "times", "pairs", "holders"))
    first = np.append(0, np.full(len(texts), len(pairs)))
    missing = pa.array(np.arange(len(texts)) > 0)
    dictionary = [
        pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(v, kind), mask=missing)
        for v, kind in ((pairs, pa.int64()), (holders, pa.int32()))
    ]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(texts), number)), column_of(part, "doc_id"), *(pa.array(c) for c in counts.values()), pa.array(groups, pa.string()),
            lists(links, from_, pa.int32()), lists(times, from_, pa.int32()), *dictionary,
        ],
        ["pass", "doc_id", *counts, "groups", "links", "times", "pairs", "holders"],
    )


def align(docs: DataFrame, json_path: str, model_path: str, pattern: str) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links and the text ``groups``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: decimal ids of A and B, group by group.
    A null or empty text, and one whose bytes B doesn't give back, has zeros and
    the empty string.  Special strings are plain text.  Rows that repeat an id or a text are rows of
    their own; null ids stay null; an empty table gives no rows; other columns are ignored.  No row
    is shuffled; a very long text is a pass of its own, in memory of some 100 times its bytes.
    """
    return passes(docs, json_path, model_path, pattern, digest=False).drop("pass", "links", "times", "pairs", "holders")


def link_values(saved: DataFrame, size_b: int) -> DataFrame:
    """For each pass and place in its dictionary the pair's count over all texts, doubled, plus one if it is A's highest."""
    places = saved.where(F.col("pairs").isNotNull()).select("pass", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "entry"))
    places = places.select("pass", "place", F.col("entry.pairs").alias("pair"), F.col("entry.holders").alias("holders"))
    counted = places.groupBy("pair").agg(F.sum("holders").alias("count"))
    of_a = Window.partitionBy(F.expr(f"pair div {size_b}"))  # no more than B's vocabulary
    valued = counted.select("pair", (2 * F.col("count") + (F.col("count") == F.max("count").over(of_a)).cast("long")).alias("value"))
    return places.join(valued, "pair").select("pass", "place", "value")


def audit(docs: DataFrame, json_path: str, model_path: str, pattern: str) -> DataFrame:
    """``align`` with a digest of the groups, and each text's links measured over all texts.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256 (empty without tokens).  An id pair's count is the number of rows that hold
    it linked; ``n_best`` are links whose count is the highest of their A id,
    ``count_sum`` adds counts over links.  Nulls, empty tables, repeated rows (each
    counts) and other columns are as in ``align``.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "alignment")
    passes(docs, json_path, model_path, pattern, digest=True).write.parquet(folder)
    values = link_values(spark.read.parquet(folder), sentencepiece.SentencePieceProcessor(model_file=model_path).get_piece_size())
    rows = spark.read.parquet(folder).select("pass", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "times")

    def measured(left: pa.Table, right: pa.Table) -> pa.Table:
        value = np.zeros(len(right), np.int64)
        value[right["place"].to_numpy()] = right["value"].to_numpy()
        left = left.combine_chunks()
        total = {n: np.zeros(len(left) + 1, np.int64) for n in ("n_best", "count_sum")}
        if len(left):
            links, times = left["links"].chunk(0), left["times"].chunk(0).flatten().to_numpy()
            bounds = np.append(0, np.cumsum(np.diff(links.offsets.to_numpy())))
            of_link = value[links.flatten().to_numpy()]
            for n, what in (("n_best", of_link & 1), ("count_sum", of_link >> 1)):
                summed = np.append(0, np.cumsum(what * times))[bounds]
                total[n] = np.diff(summed)
        kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*(left[n] for n in kept), pa.array(total["n_best"]), pa.array(total["count_sum"]), left["groups"]], [*kept, "n_best", "count_sum", "groups_sha256"])

    together = rows.groupBy("pass").cogroup(values.groupBy("pass"))
    return together.applyInArrow(measured, f"doc_id long, {COUNTS}, n_best long, count_sum long, groups_sha256 string")
