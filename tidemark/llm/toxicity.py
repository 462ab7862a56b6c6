"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text: one of windows taken at
equal steps from all of the ordinary texts, one of the same windows and the
words that set toxic texts apart.  A window of a document is compressed with either; the more it gains from the
toxic dictionary, the more likely it is toxic.  The gains of a document's
windows are summed up in a few numbers, and a logistic curve fitted on labelled
rows turns these into a score.

Only a small share of a toxic text's words is toxic.  The toxic dictionary is
therefore made of the stems that set toxic samples apart from ordinary ones.  As
both share the ordinary windows, other words gain next to nothing.  This list
replaces training on whole toxic windows, which tells little (README).

Labels are learned from at most ``sample`` rows of either label (those with the
smallest hash of their id), which bounds what the driver gets.  Scoring reads
every text whole, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_of, slices, small_batches

#: Labelled rows of either label that training reads at most; longer texts than this teach nothing.
SAMPLE = 2000
SAMPLE_CHARS = 200_000
WINDOW_WORDS = 6
#: Bytes of ordinary windows in both dictionaries, and of toxic words (the most telling first) in one.
DICTIONARY_BYTES = 12000
TOXIC_BYTES = 4000
#: A telling word: its least different surroundings in toxic texts, its least z value
#: against ordinary ones, and how many times as frequent as there it is at least.
LEAST_PLACES = 3
LEAST_Z = 5
LEAST_RATIO = 4
THRESHOLD = 0.7
#: Bytes that a window gains from the toxic dictionary to count as a clear case.
CLEAR = (1, 2, 3, 4)
FEATURES = 2 * len(CLEAR) + 2
LEVEL = 6

_WORDS = re.compile(r"\S+")


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def windows(text: str) -> list[bytes]:
    """Windows of WINDOW_WORDS words that cover the whole text; a last one may be shorter."""
    words = _WORDS.findall(text)
    return [f" {' '.join(words[i : i + WINDOW_WORDS])} ".encode() for i in range(0, len(words), WINDOW_WORDS)]


def compressors(model: Model) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    made = []
    for content in (model.ordinary, model.toxic):
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made[0], made[1]


def gains(texts: list[str], ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> np.ndarray:
    """For each text, of its windows' gains in bytes: share and log count of those of at least each of CLEAR, the mean, the top ones' mean."""
    out = np.zeros((len(texts), FEATURES))
    for row, text in zip(out, texts, strict=True):
        found = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text)], float)
        if len(found):
            clear = [np.count_nonzero(found >= least) for least in CLEAR]
            row[:] = *(n / len(found) for n in clear), *(math.log1p(n) for n in clear), found.mean(), np.sort(found)[-3:].mean()
    return out


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the constant last) of a ridge logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


def stem_counts(texts: list[str]) -> tuple[Counter, int]:
    """In how many different surroundings words with a stem of four to seven letters stand, and the number of all.

    Words of up to three letters count whole, with a space after them.  A word between the same two words counts once, so copies of a text add nothing.
    """
    seen: set[tuple[str, str, str]] = set()
    for text in texts:
        words = [x.strip(".,;:!?\"'()").lower() for x in text.split()]
        around = ["", *words, ""]
        seen.update(zip(around, words, around[2:], strict=False))
    found = Counter(w for _, w, _ in seen)
    count: Counter = Counter()
    for word, n in found.items():
        for stem in {word[:k] for k in (4, 5, 6, 7, len(word))} if len(word) > 3 else {f"{word} "} if word else ():
            count[stem] += n
    return count, len(seen)


def telling_words(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Stems that stand in clearly more surroundings in toxic texts, the most telling first."""
    (mine, n), (other, m) = stem_counts(toxic), stem_counts(ordinary)
    if not n or not m:
        return []
    found = []
    for word, k in mine.items():
        o = other[word]
        pooled = (k + o + 1) / (n + m + 2)
        z = (k / n - o / m) / math.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
        if k >= LEAST_PLACES and z > LEAST_Z and k * m > LEAST_RATIO * o * n:
            found.append((-round(z, 1), -len(word), word))  # of stems as telling, the longest
    chosen: list[str] = []
    for _, _, word in sorted(found):
        if not any(word.startswith(c) or c.startswith(word) for c in chosen):
            chosen.append(word)
    return chosen


def spread_windows(texts: list[str], size: int) -> list[bytes]:
    """Windows of about ``size`` bytes in all, at equal steps from the first text's first to the last one's last."""
    total = sum(len(w) + 1 for t in texts for w in windows(t))
    chosen, seen, taken = [], 0, 0
    for text in texts:
        for w in windows(text):
            if taken * total <= seen * size:
                chosen.append(w)
                taken += len(w) + 1
            seen += len(w) + 1
    return chosen


def dictionaries(toxic: list[str], plain: list[str]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary: common ordinary windows, and after them toxic words in the latter."""
    base = b"\n".join(spread_windows(plain, DICTIONARY_BYTES))
    around: list[bytes] = []
    size = 0
    for stem in telling_words(toxic, plain):
        for word in (stem, stem.capitalize()):
            piece = b" " + word.strip().encode() + b" "
            if size + len(piece) <= TOXIC_BYTES:
                around.append(piece)
                size += len(piece)
    # The end of a dictionary is what its match tables keep best; the filler keeps all other distances equal.
    filler = bytes(1 + (i * i // 7 + i) % 8 for i in range(size))
    return base + b"\n" + filler, base + b"\n" + b"".join(around)


def train(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, label) rows; without rows of both labels every score is 0.

    The curve is fitted on gains of texts that the dictionaries weren't made of:
    each half of the rows is scored with those of the other half.  The model's
    own dictionaries are made of all rows.
    """
    toxic = [t for t, label in rows if label == 1]
    plain = [t for t, label in rows if label == 0]
    if not toxic or not plain:
        return Model(b"", b"", (0.0,) * FEATURES, (1.0,) * FEATURES, (0.0,) * FEATURES + (-30.0,))
    parts, labels = [], []
    for half in (0, 1):
        made = Model(*dictionaries(toxic[half::2], plain[half::2]), (), (), ())
        others = toxic[1 - half :: 2] + plain[1 - half :: 2]
        parts.append(gains(others, *compressors(made)))
        labels += [1.0] * len(toxic[1 - half :: 2]) + [0.0] * len(plain[1 - half :: 2])
    x, y = np.vstack(parts), np.array(labels)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    weights = logistic((x - mean) / scale, y)
    return Model(*dictionaries(toxic, plain), tuple(mean), tuple(scale), tuple(weights))


def score_texts(texts: list[str], model: Model) -> np.ndarray:
    if not model.ordinary:
        return np.zeros(len(texts))
    x = (gains(texts, *compressors(model)) - np.array(model.mean)) / np.array(model.scale)
    w = np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int, chars: int) -> list[tuple[str, int]]:
    """At most ``sample`` (text, label) rows of either label: those with the smallest hash of the id.

    Texts of over ``chars`` characters are left out, which bounds what the driver gets.
    """
    ids = labels.where(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label"))
    ids = ids.dropDuplicates(["doc_id"]).withColumn("h", F.xxhash64("doc_id"))
    one, zero = (ids.where(F.col("label") == v).orderBy("h", "doc_id").limit(sample) for v in (1, 0))
    chosen = F.broadcast(one.unionByName(zero))  # at most 2 x sample ids
    rows = docs.select("doc_id", "text").where(F.length("text") <= chars).join(chosen, "doc_id")
    rows = rows.select("h", "doc_id", "label", "text").dropDuplicates(["doc_id"])
    return [(r.text, r.label) for r in sorted(rows.collect(), key=lambda r: (r.h, r.doc_id))]


def classify(
    docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, threshold: float = THRESHOLD, longest: int = SAMPLE_CHARS
) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1) and predicted (score >= threshold).

    ``learn`` says which rows of labels (doc_id, toxic) may be learned from: at
    most ``sample`` of either label, with texts of at most ``longest`` characters.
    Null labels and ids without a text teach nothing; several labels of an id
    count once.  A null or empty text has no windows and gets the score of no
    gains.  Repeated rows get the same score; an empty table gives no rows.  A
    very long text is scored whole by one task, window after window.
    Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = train(labelled_sample(docs, labels, "toxic", learn, sample, longest))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = score_texts([t or "" for t in column_of(part, "text").to_pylist()], model)
                yield pa.RecordBatch.from_arrays([column_of(part, "doc_id"), pa.array(found)], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(scores, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
