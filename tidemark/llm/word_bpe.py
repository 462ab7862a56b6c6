"""Word BPE in batched numpy merge rounds, and decoding.

The vocabulary is a file of the ``tokenizers`` library for lower-case words with a
word-end suffix.  Runs of characters without ASCII white space are the units of
the work: neither the normaliser nor the pre-tokeniser joins anything across white
space, and special strings hold none.  The distinct units of a slice of texts are
normalised and pre-tokenised; the symbols of all their distinct words lie in one
flat array.  In each round the pairs of neighbouring symbols are looked up by binary
search in the sorted keys of the merges, every word's pair of the lowest rank
is merged wherever the word has it, and words without a pair leave the array.  Only
pairs beside a merge are looked up again.

A merge makes all its places in a word at once.  That equals merging one place after
the other, as the library does, if no merge takes a symbol that a later merge makes;
where a file doesn't hold to that, one place of a word is merged a round.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Pieces, byte_characters, column_of, gathered, slices, small_batches, split_words, text_buffers

#: Bytes of text in one pass.
PASS_BYTES = 1 << 21
#: A worker forgets the units it knows when they are so many, or hold so many ids.
MOST_UNITS = 400_000
MOST_IDS = 4_000_000

_NO_RANK = np.int32(2**31 - 1)
_loaded: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """A vocabulary, read once by each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


class WordBpe:
    """The vocabulary and merges of a file as arrays, and the units met so far."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as lines:
            file = json.load(lines)
        model, own = file["model"], Tokenizer.from_file(path)
        kinds = [n["type"] for n in file["normalizer"]["normalizers"]]
        split = file["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or (split["type"], split["behavior"], split["invert"]) != ("Split", "Removed", True):
            raise ValueError(f"{path} isn't a vocabulary of lower-case words without white space")
        self.normalise, self.pre_tokenise = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        # In lower-case ASCII text the classes are short; the space is that between units.
        pattern = split["pattern"]["Regex"] + "| "
        self.ascii_words = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII).findall
        self.latin_words = regex.compile(pattern).findall
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.around_special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if self.special else lambda text: [text]
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in (*ids.items(), *self.special.items())}
        characters = byte_characters()
        self.inner = np.array([ids[c] for c in characters], np.int64)
        self.last = np.array([ids[c + suffix] for c in characters], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(self.tokens) + 1
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        self.rank = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.rank]
        latest = np.full(self.size, -1, np.int64)
        latest[self.made] = np.arange(len(merges))  # of equal products the last assignment stays
        self.at_once = bool(np.all(np.maximum(latest[left], latest[right]) < np.arange(len(merges))))
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = Pieces(np.int32)

    def ranks_at(self, symbols: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at these places; there is no pair across words."""
        out = np.full(len(at), _NO_RANK, np.int32)
        inside = np.flatnonzero(at + 1 < len(symbols))
        inside = inside[words[at[inside]] == words[at[inside] + 1]]
        pairs = symbols[at[inside]] * self.size + symbols[at[inside] + 1]
        found = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        hit = self.keys[found] == pairs if len(self.keys) else np.zeros(len(pairs), bool)
        out[inside[hit]] = self.rank[found[hit]]
        return out

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order, and the offsets between words; no word is empty."""
        offs = np.cumsum([0, *map(len, words)])
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        symbols[offs[1:] - 1] = self.last[data[offs[1:] - 1]]
        number = np.repeat(np.arange(len(words)), np.diff(offs))
        rank = self.ranks_at(symbols, number, np.arange(len(symbols)))
        over: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            length = np.diff(np.append(first, len(symbols)))
            lowest = np.repeat(np.minimum.reduceat(rank, first), length)
            going = lowest != _NO_RANK
            over.append((number[~going], symbols[~going]))
            symbols, number, rank = symbols[going], number[going], rank[going]
            at = np.flatnonzero(rank == lowest[going])
            if not len(at):
                break
            if self.at_once:  # of places that overlap (aaa) every second one
                begins = np.flatnonzero(np.append(True, np.diff(at) != 1))
                at = at[(np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))) % 2 == 0]
            else:
                at = at[np.append(True, number[at[1:]] != number[at[:-1]])]
            symbols[at] = self.made[rank[at]]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            symbols, number, rank = symbols[stays], number[stays], rank[stays]
            at = at - np.arange(len(at))
            beside = np.zeros(len(symbols), bool)
            beside[at] = beside[at[at > 0] - 1] = True
            beside = np.flatnonzero(beside)
            rank[beside] = self.ranks_at(symbols, number, beside)
        if not over:
            return np.zeros(0, np.int32), offs
        number = np.concatenate([n for n, _ in over])
        order = np.argsort(number, kind="stable")
        return np.concatenate([s for _, s in over])[order].astype(np.int32), np.searchsorted(number[order], np.arange(len(words) + 1))

    def words_of(self, units: list[str]) -> tuple[list[str | int], np.ndarray]:
        """The words and the ids of special strings of all units in order, and how many each unit has.

        Units go through the normaliser together, with a space between them;
        those with special strings or with white space beyond ASCII go alone.
        Words of Latin letters are found by this module's patterns, as their
        classes are the same in all versions of Unicode, others by the library.
        """
        everything = "\n".join(units)
        any_special = any(s in everything for s in self.special)
        alone, plain, latin, other = [], [], [], []
        for k, unit in enumerate(units):
            if any_special and any(s in unit for s in self.special):
                alone.append(k)
            elif unit.isascii():
                plain.append(k)
            elif len(unit.split()) != 1 or unit[0].isspace() or unit[-1].isspace():
                alone.append(k)
            else:
                (latin if max(unit) < "\u0250" else other).append(k)
        words: list[str | int] = []
        counts = np.zeros(len(units), np.int64)

        def joined(those: list[int]) -> str:
            return " ".join(map(units.__getitem__, those))

        for those, text, words_in in (plain, joined(plain).lower(), self.ascii_words), (latin, self.normalise(joined(latin)), self.latin_words):
            if those:
                found = words_in(text)
                ends = np.flatnonzero(np.fromiter(map(" ".__eq__, found), bool, len(found)))
                counts[those] = np.diff(np.concatenate([[-1], ends, [len(found)]])) - 1
                words += [w for w in found if w != " "]
        if other:
            text = self.normalise(joined(other))
            places = [place for _, place in self.pre_tokenise(text)]
            spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == ord(" "))
            unit = np.searchsorted(spaces, np.fromiter((s for s, _ in places), np.int64, len(places)))
            counts[other] = np.bincount(unit, minlength=len(other))
            words += [text[s:e] for s, e in places]
        for k in alone:
            before = len(words)
            for part in self.around_special(units[k]):
                text = "" if part in self.special else self.normalise(part)
                words += [self.special[part]] if part in self.special else [text[s:e] for _, (s, e) in self.pre_tokenise(text)]
            counts[k] = len(words) - before
        order = [*plain, *latin, *other, *alone]
        ends = np.cumsum(counts[order])
        starts = np.zeros(len(units), np.int64)
        starts[order] = ends - counts[order]
        return list(map(words.__getitem__, gathered(starts, counts).tolist())), counts

    def learn(self, units: list[bytes]) -> None:
        """Encode units and keep their ids."""
        flat, counts = self.words_of([u.decode() for u in units])
        distinct = set(flat)
        special = [w for w in distinct if isinstance(w, int)]
        plain = list(distinct.difference(special))
        found = Pieces(np.int32)
        ids, offs = self.merged([w.encode() for w in plain])
        found.add(ids, np.diff(offs))
        found.add(np.array(special, np.int32), np.ones(len(special), np.int64))
        number = dict(zip([*plain, *special], range(len(distinct)), strict=True))
        ids, lengths = found.take(np.fromiter(map(number.__getitem__, flat), np.int64, len(flat)))
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        self.ids.add(ids, np.diff(ends))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and the offsets between texts."""
        if len(self.known) > MOST_UNITS or self.ids.values > MOST_IDS:
            self.forget()
        data, offs = text_buffers(texts)
        starts, ends, text = split_words(data, offs)
        between = np.append(0, np.cumsum(ends - starts))
        inside = np.zeros(len(data) + 1, np.int32)
        inside[starts] += 1
        inside[ends] -= 1
        plain = data[np.cumsum(inside[:-1]).astype(bool)].tobytes()
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(between), pa.py_buffer(plain)]).dictionary_encode()
        distinct = units.dictionary.to_pylist()
        new = [u for u in distinct if u not in self.known]
        if new:
            self.learn(new)
        place = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        ids, lengths = self.ids.take(place[units.indices.to_numpy()] if len(place) else place)
        return ids, np.append(0, np.cumsum(lengths))[np.searchsorted(text, np.arange(len(texts) + 1))]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of docs: doc_id and ids array<int>.

    A null text is the empty one, without ids.  Special strings in a text are
    their ids.  Rows that repeat an id or a text are rows of their own; null ids
    stay null; an empty table gives no rows.  Other columns are ignored.  No row is
    shuffled; a text longer than a slice is one pass of its own, in memory of some
    60 times its bytes.
    """
    small_batches(docs.sparkSession)

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(path)
        for batch in batches:
            for part in slices(batch, most=PASS_BYTES):
                ids, offs = own.encode(column_of(part, "text"))
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([column_of(part, "doc_id"), lists], ["doc_id", "ids"])

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(ids_of, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add the text that the ids stand for (column ``decoded``), one row per row.

    The file names no decoder, so the text is the tokens with a space between
    them.  Null or empty ids give the empty text; an unknown id is an error.
    """
    kept = [c for c in encoded.columns if c not in ("ids", "decoded")]

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(path).tokens
        for batch in batches:
            ids = column_of(batch, "ids")
            out = [" ".join(map(tokens.__getitem__, i or ())) for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(column_of(batch, n) for n in kept), ids, pa.array(out, pa.string())], [*kept, "ids", "decoded"])

    return encoded.select(*kept, "ids").mapInArrow(texts_of, encoded.select(*kept, "ids").schema.add("decoded", "string"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode and give doc_id, n_tokens, ids_sha256 and decoded_sha256 per row."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decode(encode(docs, path), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
