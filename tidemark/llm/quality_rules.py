"""Quality rules with thresholds that follow the data.

Features of each text are rates: characters and symbols per word, capitals per
character, repeated lines per line, each with one occurrence added, so that a text
without the trait says how rare it is at least.  For each language and source a
mergeable quantile sketch of every feature is kept: counts in buckets whose width
is at most a 16th of their value.  Sketches of parts are merged by adding counts,
so partial aggregation does most of the work before the shuffle and the result
doesn't depend on order.

A group's limits come from its own sketch, shrunk towards its language's: the
language adds PRIOR rows dealt like all of its own, so small groups follow their
language and large ones themselves.  The upper limit lies REACH times the distance
of the quartiles above the upper quartile (the lower one likewise below), so less
than a quarter of junk doesn't move it much.  A text may exceed a limit by what
chance makes of a count of that size (SIGMAS standard deviations of what the limit
expects in this text) and by nothing else: no limit or allowance is fixed.  A source
whose texts use symbols so has another limit than plain prose, and prose without
any symbol has a limit of a few in a text of the usual length.

Scale: texts are read once and leave as a few integers.  A language and source
with a third of all rows is summed up on the map side; its sketch has at most a
few hundred buckets a feature.  The limits take a row per group, feature and
bucket of the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    WHITE,
    again,
    column_of,
    materialise,
    per_text,
    segment_hashes,
    slices,
    small_batches,
    split_lines,
    split_words,
    text_buffers,
    window_hashes,
)

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Feature: what is counted, and among how many.  Its value is the rate per thousand, of one more than is counted.
FEATURES = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
}
#: Features that may also be too low.
BOTH_SIDES = ("chars_per_word",)
REACH = 1.5
PRIOR = 20
SIGMAS = 4

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def text_counts(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The counts of each text, in the order of _COUNTS."""
    texts = len(offs) - 1
    starts, ends, doc = split_words(data, offs)
    chars = per_text(~WHITE[data] & ((data & 0xC0) != 0x80), offs)
    lines_at, line_end, line_doc = split_lines(data, offs, starts)
    dup = again(segment_hashes(data, lines_at, line_end), line_doc, first_too=False)
    windows, at = window_hashes(segment_hashes(data, starts, ends), doc, WINDOW)
    twice = at[again(windows, doc[at], first_too=True)]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    repeated = np.cumsum(cover)[:-1] > 0
    return [
        np.bincount(doc, minlength=texts),
        chars,
        per_text(_SYMBOL[data], offs),
        np.bincount(line_doc[dup], minlength=texts),
        np.bincount(doc[repeated], minlength=texts),
        np.bincount(line_doc, minlength=texts),
        per_text((data >= 65) & (data <= 90), offs),
    ]


def count_features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each row's whole text; null texts have none."""
    small_batches(docs.sparkSession)
    kept = ["doc_id", "lang", "source"]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = text_counts(*text_buffers(column_of(part, "text")))
                yield pa.RecordBatch.from_arrays(
                    [*(column_of(part, n) for n in kept), *(pa.array(f.astype(np.int64)) for f in found)],
                    [*kept, *_COUNTS],
                )

    schema = docs.select(*kept).schema
    for name in _COUNTS:
        schema = schema.add(name, "long")
    return docs.select(*kept, "text").mapInArrow(counts, schema)


def bucket_of(value: Column) -> Column:
    """The sketch's bucket: how many bits are cut off, times 32, and the five leading bits."""
    cut = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return cut.cast("long") * 32 + F.call_function("shiftright", value, cut)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, feature, bucket, n: the mergeable sketches of all texts that pass the base rules."""
    values = F.array(*(F.struct(F.lit(f).alias("feature"), F.expr(f"1000 * ({k} + 1) div {n}").alias("value")) for f, (k, n) in FEATURES.items()))
    return (
        counts.where(~base_failed())
        .select("lang", "source", F.explode(values).alias("f"))
        .groupBy("lang", "source", "f.feature", bucket_of(F.col("f.value")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def limits(sketch: DataFrame) -> DataFrame:
    """lang, source and for each feature its q75_ and q25_<feature>, from the group's and its language's sketches."""
    of_lang = sketch.groupBy("lang", "feature", "bucket").agg(F.sum("n").alias("n_lang"))
    groups = sketch.select("lang", "source").distinct()
    own = sketch.select(F.col("lang").alias("l"), F.col("source").alias("s"), F.col("feature").alias("f"), F.col("bucket").alias("b"), "n")
    every = groups.select(F.col("lang").alias("g"), "source").join(of_lang, F.col("g").eqNullSafe(F.col("lang"))).drop("g")
    here = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("feature") == F.col("f")) & (F.col("bucket") == F.col("b"))
    group = Window.partitionBy("lang", "source", "feature")
    upto = group.orderBy("bucket")
    ranked = every.join(own, here, "left").select(
        "lang", "source", "feature", "bucket",
        # Thousandths of a row: the group's own, and PRIOR rows of the language.
        (F.sum(F.coalesce("n", F.lit(0))).over(upto) * 1000 + F.call_function("div", F.sum("n_lang").over(upto) * PRIOR * 1000, F.sum("n_lang").over(group))).alias("upto"),
        (F.sum(F.coalesce("n", F.lit(0))).over(group) * 1000 + PRIOR * 1000).alias("total"),
    )
    # Quartiles are taken at the outer ends of their buckets, so their distance is never less than the sketch can tell.
    ends = {"q75": (75, "shiftleft(bucket % 32 + 1, cast(bucket div 32 AS int))"), "q25": (25, "shiftleft(bucket % 32, cast(bucket div 32 AS int))")}

    def quantile(percent: int, end: str, feature: str) -> Column:
        return F.min(F.when((F.col("feature") == feature) & (F.col("upto") * 100 >= F.col("total") * percent), F.expr(end)))

    return ranked.groupBy("lang", "source").agg(*(quantile(percent, end, f).alias(f"{q}_{f}") for f in FEATURES for q, (percent, end) in ends.items()))


def within_limits() -> Column:
    """Whether no feature is over (or under) its group's limit by more than chance."""
    within = F.lit(True)
    for f, (k, n) in FEATURES.items():
        reach = f"{REACH}D * (q75_{f} - q25_{f})"
        most = f"((q75_{f} + {reach}) * {n} / 1000D)"
        within &= F.expr(f"{k} <= {most} + {SIGMAS}D * sqrt({most})")
        if f in BOTH_SIDES:
            least = f"(greatest(q25_{f} - {reach}, 0D) * {n} / 1000D)"
            within &= F.expr(f"{k} >= {least} - {SIGMAS}D * sqrt({least})")
    return within


def apply_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed and kept.

    base_failed: fewer than MIN_WORDS words, or over MAX_REPEAT_PERCENT % of the
    words in repeated windows.  kept: not base_failed and no feature beyond its
    group's limit.  A null or empty text has no words and fails the base.  Null
    languages and sources form groups of their own; repeated rows count as
    often as they occur; an empty table gives no rows.  A very long text is one
    row of one task.  Other columns are ignored.
    """
    counts = materialise(count_features(docs))  # a few integers a text, read twice below
    bounds = limits(sketches(counts)).select(F.col("lang").alias("l"), F.col("source").alias("s"), F.expr("* EXCEPT (lang, source)"))
    return (
        counts.join(bounds, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
        .withColumn("base_failed", base_failed())
        .select("doc_id", *_COUNTS[:5], "base_failed", (~F.col("base_failed") & F.coalesce(within_limits(), F.lit(False))).alias("kept"), *_COUNTS[5:])
    )


#: DuckDB SQL over the view documents.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, text FROM d),
ww AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT r, i, concat_ws(chr(1), word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS win,
             lead(word, 4) OVER o AS last FROM ww WINDOW o AS (PARTITION BY r ORDER BY i)),
tw AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g WHERE last IS NOT NULL),
rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM tw WHERE n > 1) GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lc AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT d.r, doc_id, lang, source, len(w.ws)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(n_lines, 0)::BIGINT AS n_lines, length(regexp_replace(d.text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN lc USING (r)),
base AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM c),
f AS (SELECT r, lang, source, feature, k, n, 1000 * (k + 1) // n AS value
      FROM (SELECT r, lang, source, unnest(['chars_per_word', 'symbols_per_word', 'capitals', 'dup_lines']) AS feature,
                   unnest([word_chars, n_symbols, n_capitals, n_dup_lines]) AS k, unnest([n_words, n_words, word_chars, n_lines]) AS n FROM base WHERE NOT base_failed)),
h AS (SELECT lang, source, feature, 32 * greatest(length(bin(value)) - 5, 0) + (value >> greatest(length(bin(value)) - 5, 0)::INT) AS bucket, count(*) AS n FROM f GROUP BY ALL),
hl AS (SELECT lang, feature, bucket, sum(n) AS n FROM h GROUP BY ALL),
a AS (SELECT s.lang, s.source, hl.feature, hl.bucket, hl.n AS n_lang, coalesce(h.n, 0) AS n
      FROM (SELECT DISTINCT lang, source FROM h) s JOIN hl ON s.lang IS NOT DISTINCT FROM hl.lang
      LEFT JOIN h ON h.lang IS NOT DISTINCT FROM s.lang AND h.source IS NOT DISTINCT FROM s.source AND h.feature = hl.feature AND h.bucket = hl.bucket),
u AS (SELECT lang, source, feature, bucket,
             sum(n) OVER o * 1000 + (20000 * sum(n_lang) OVER o) // sum(n_lang) OVER p AS upto, sum(n) OVER p * 1000 + 20000 AS total
      FROM a WINDOW p AS (PARTITION BY lang, source, feature), o AS (PARTITION BY lang, source, feature ORDER BY bucket)),
q AS (SELECT lang, source, feature, min((bucket % 32 + 1) << (bucket // 32)::INT) FILTER (upto * 100 >= total * 75) AS q75,
             min((bucket % 32) << (bucket // 32)::INT) FILTER (upto * 100 >= total * 25) AS q25 FROM u GROUP BY ALL),
b AS (SELECT lang, source, feature, q75 + 1.5::DOUBLE * (q75 - q25) AS most,
             CASE WHEN feature = 'chars_per_word' THEN greatest(q25 - 1.5::DOUBLE * (q75 - q25), 0) ELSE 0 END AS least FROM q),
e AS (SELECT r, k, most * n / 1000 AS high, least * n / 1000 AS low FROM f JOIN b ON f.feature = b.feature
      AND f.lang IS NOT DISTINCT FROM b.lang AND f.source IS NOT DISTINCT FROM b.source),
v AS (SELECT r, bool_and(k <= high + 4 * sqrt(high) AND k >= low - 4 * sqrt(low)) AS within FROM e GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(within, false) AS kept, n_lines, n_capitals
FROM base LEFT JOIN v USING (r)
"""
