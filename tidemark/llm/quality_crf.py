"""Quality classifier: a linear-chain conditional random field over a text's lines.

Every line gets features of its own characters and of the lines beside it.  The
chain has two states, bad and good.  Weights are fitted on labelled texts, whose
lines all take the text's label.  Forward and backward passes give each line's
probability of being good; their mean, weighted by line length, is the text's
quality, and a logistic curve fitted on the same labelled texts makes it a score.

Training reads at most ``sample`` labelled rows of either label (those with the
smallest hash of their id), which bounds what the driver gets.  Scoring reads
every text whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import again, column_of, segment_hashes, slices, small_batches, split_lines, split_words, text_buffers
from .toxicity import labelled_sample, logistic

#: Labelled rows of either label that training reads at most; longer texts than this teach nothing.
SAMPLE = 1500
SAMPLE_CHARS = 200_000
THRESHOLD = 0.3
#: Lines of a text that are one chain in training; scoring has no such limit.
TRAINING_LINES = 64

_CLASSES = {"symbol": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digit": b"0123456789", "bang": b"!?", "space": b" \t"}
_IS = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features and a constant, for good against bad
    steps: np.ndarray  # 2 x 2: from state to state
    curve: np.ndarray  # of the log odds of the text's quality, and a constant


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, length in bytes and text number of every line that has a word."""
    words, word_ends, word_doc = split_words(data, offs)
    starts, ends, doc = split_lines(data, offs, words)
    if len(starts) == 0:
        return np.zeros((0, 19)), ends, doc
    length = np.maximum(ends - starts, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[ends] - total[starts]) / length

    own = [share(_IS[k][data]) for k in _CLASSES]
    hashes = segment_hashes(data, words, word_ends)
    first, last = np.searchsorted(words, starts), np.searchsorted(words, ends)
    n = last - first
    twice = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])])
    total = np.concatenate([[0], np.cumsum(twice)])
    own.append((total[last] - total[first]) / n)
    repeat = again(hashes, word_doc, first_too=False)
    total = np.concatenate([[0], np.cumsum(repeat)])
    own.append((total[last] - total[first]) / n * np.minimum(n, 50) / 50)
    own.append(again(segment_hashes(data, starts, ends), doc, first_too=False).astype(float))
    own.append(np.log1p(n))
    x = np.stack(own, 1)
    beside = x[:, [0, 1, 3, 5, 7]]
    same = doc[1:] == doc[:-1]
    before, after = np.zeros_like(beside), np.zeros_like(beside)
    before[1:][same] = beside[:-1][same]
    after[:-1][same] = beside[1:][same]
    return np.hstack([x, before, after]), ends - starts, doc


def forward_backward(good: np.ndarray, chain: np.ndarray, steps: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of the state good, and the expected steps between states.

    good: log odds of each line on its own; chain: number of its chain, ascending;
    weight: what each line, and the step to it, counts among the expected steps.
    """
    n = len(good)
    if n == 0:
        return good, np.zeros((2, 2))
    starts = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
    sizes = np.diff(np.append(starts, n))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    own = np.stack([np.zeros(n), good], 1)
    alpha, beta = own.copy(), np.zeros((n, 2))
    most = int(sizes[0])
    live = [starts[: np.searchsorted(-sizes, -t, "left")] + t for t in range(most)]  # chains of more than t lines
    for at in live[1:]:
        alpha[at] += np.logaddexp(alpha[at - 1, :1] + steps[0], alpha[at - 1, 1:] + steps[1])
    for at in reversed(live[1:]):
        ahead = own[at] + beta[at]
        beta[at - 1] = np.logaddexp(steps[:, 0] + ahead[:, :1], steps[:, 1] + ahead[:, 1:])
    both = alpha + beta
    total = np.logaddexp(both[:, 0], both[:, 1])
    expected = np.zeros((2, 2))
    if most > 1:
        at = np.concatenate(live[1:])
        ahead = own[at] + beta[at]
        counts = np.ones(len(at)) if weight is None else weight[at]
        for a in (0, 1):
            for b in (0, 1):
                expected[a, b] = (np.exp(alpha[at - 1, a] + steps[a, b] + ahead[:, b] - total[at]) * counts).sum()
    return np.exp(both[:, 1] - total), expected


def as_buffers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_buffers(pa.array(texts, pa.string()))


def features_of(texts: list[str], at_once: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features of many texts, a few at a time: the byte-wise work takes many times the texts' memory."""
    parts = []
    for at in range(0, len(texts), at_once):
        x, length, doc = line_features(*as_buffers(texts[at : at + at_once]))
        parts.append((x.astype(np.float32), length, doc + at))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def quality_of(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' probabilities; 0 for texts without words."""
    x, length, doc = line_features(data, offs)
    odds = ((x - model.mean) / model.scale) @ model.weights[:-1] + model.weights[-1]
    p, _ = forward_backward(odds, doc, model.steps)
    weight = np.bincount(doc, length, len(offs) - 1)
    return np.bincount(doc, p * length, len(offs) - 1) / np.maximum(weight, 1)


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(rows: list[tuple[str, int]], rounds: int = 150, ridge: float = 1e-3, enough: float = 1e-4) -> Model | None:
    """Weights from (text, label) rows; None without rows of both labels.

    Gradient steps on the chains' log-likelihood, each chain weighted by its
    label, until no part of the gradient is over ``enough``, ``rounds`` at most.
    """
    if len({label for _, label in rows}) < 2:
        return None
    texts = [t for t, _ in rows]
    labels = np.array([label for _, label in rows], float)
    x, _, doc = features_of(texts)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
    chain = doc * (1 << 20) + nth // TRAINING_LINES
    y = labels[doc]
    # Either label weighs the same, whatever its share of the lines.
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    follows = np.flatnonzero(chain[1:] == chain[:-1]) + 1
    seen = np.zeros((2, 2))
    seen[1, 1], seen[0, 0] = (weight * y)[follows].sum(), (weight * (1 - y))[follows].sum()
    w, steps = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, rounds + 1):  # Adam
        p, expected = forward_backward(x @ w, chain, steps, weight)
        grad = np.concatenate([x.T @ (weight * (y - p)), (seen - expected).ravel()]) / len(y)
        grad -= ridge * np.concatenate([w, steps.ravel()])
        if np.abs(grad).max() < enough:
            break
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, steps = w + move[:-4], steps + move[-4:].reshape(2, 2)
    model = Model(mean, scale, w, steps, np.zeros(2))
    quality = np.concatenate([quality_of(model, *as_buffers(texts[at : at + 100])) for at in range(0, len(texts), 100)])
    curve = logistic(log_odds(quality)[:, None], labels)
    return Model(mean, scale, w, steps, curve)


def score_buffers(model: Model | None, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Scores of the texts; texts without words, or without a model, have 0."""
    if model is None:
        return np.zeros(len(offs) - 1)
    score = 1 / (1 + np.exp(-(log_odds(quality_of(model, data, offs)) * model.curve[0] + model.curve[1])))
    words = np.bincount(split_words(data, offs)[2], minlength=len(offs) - 1)
    return np.where(words > 0, score, 0.0)


def classify(
    docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, threshold: float = THRESHOLD, longest: int = SAMPLE_CHARS
) -> DataFrame:
    """docs' own columns, score (0 to 1) and predicted (score >= threshold).

    ``learn`` says which rows of labels (doc_id, quality) may be learned from: at
    most ``sample`` of either label, with texts of at most ``longest`` characters.
    Null labels and ids without a text teach nothing; several labels of an id
    count once.  Null, empty and blank texts score 0.  Repeated rows get the
    same score; an empty table gives no rows.  A very long text is scored whole by
    one task, at some 60 times its own memory.  Columns of docs that are called
    score or predicted are replaced.
    """
    small_batches(docs.sparkSession)
    model = train(labelled_sample(docs, labels, "quality", learn, sample, longest))
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = score_buffers(model, *text_buffers(column_of(part, "text")))
                yield pa.RecordBatch.from_arrays([*(column_of(part, n) for n in kept), pa.array(found)], [*kept, "score"])

    scored = docs.select(*kept).mapInArrow(scores, docs.select(*kept).schema.add("score", "double"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
