"""How far the sources of a language differ in the terms they use.

One pass over the texts builds block postings in memory: for each language and source
the occurrences of each term and the rows that hold it.  When a block
has ``block_terms`` entries it is written out as a run sorted by term.
Runs are dealt by a hash of language and term; each shard's runs are merged (by
Spark's sorting, a heap merge of sorted runs where they don't fit into memory) into the
frequencies of the terms that enough rows of a language hold.

The divergence of a pair of sources adds f over *all* kept terms, most of which one
of the two doesn't have.  With f(c, d) for a term that occurs c and d times, the sum is

    sum f(c, 0) + sum f(0, d) - terms * f(0, 0) + sum of corrections,
    correction = f(c, d) - f(c, 0) - f(0, d) + f(0, 0),

and a correction isn't zero only where both have the term.  The first sums
need how many terms a source has of each count; the corrections are streamed term
by term through each shard and added up there.  Everything is integer arithmetic;
weights are 1 + floor(10^9 (count + 1) / (all counts + terms)).

Shuffled are the runs' entries (at most one per block, source and term), the kept
frequencies (twice: by source, by term) and sums per pair.  No source or language is a
key by itself: frequencies go by source *and* term, histograms are salted, and
the best terms of a source are cut in each task before they meet.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.checkpoints import new_folder

from .common import column_of, gathered, small_batches

#: Entries (term of a source) of a block in memory.
BLOCK_TERMS = 1 << 20
#: Rows of a language that must hold a term.
LEAST_DOCS = 3
#: Parts into which the histogram of a language is dealt.
SALTS = 64
#: Pairs of entries that are corrected in one numpy pass, and sums kept before they are handed on.
PASS_PAIRS = 1 << 19
MOST_SUMS = 1 << 20

_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


class Block:
    """Postings of some texts: occurrences and rows of each term, by language and source."""

    def __init__(self) -> None:
        self.counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.entries = 0

    def add(self, lang: str, source: str, text: str) -> None:
        occurrences, rows = self.counts.setdefault((lang, source), (Counter(), Counter()))
        terms = text.encode().translate(_LETTERS).split()
        before = len(rows)
        occurrences.update(terms)
        rows.update(set(terms))
        self.entries += len(rows) - before

    def run(self) -> Iterator[pa.RecordBatch]:
        """The entries sorted by term; each source also has one with the empty term and no count."""
        terms, counts, rows, sizes = [], [], [], []
        for occurrences, held in self.counts.values():
            sizes.append(len(occurrences) + 1)
            terms += [pa.array([b""], pa.binary()), pa.array(list(occurrences), pa.binary())]
            counts += [np.zeros(1, np.int64), np.fromiter(occurrences.values(), np.int64, len(occurrences))]
            rows += [np.zeros(1, np.int64), np.fromiter(map(held.__getitem__, occurrences), np.int64, len(occurrences))]
        if not sizes:
            return
        of_key = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        columns = [pa.array(names).take(of_key) for names in zip(*self.counts, strict=True)]
        columns += [pa.concat_arrays(terms).cast(pa.string()), pa.array(np.concatenate(counts)), pa.array(np.concatenate(rows))]
        entries = pa.table(columns, ["lang", "source", "term", "count", "docs"])
        yield from entries.take(pc.sort_indices(entries, [("term", "ascending")])).to_batches(1 << 16)


def runs(docs: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Term-sorted runs of the rows' postings: lang, source, term, count, docs."""
    small_batches(docs.sparkSession)
    texts = docs.select(*(F.coalesce(F.col(n), F.lit("")).alias(n) for n in ("lang", "source", "text")))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            for lang, source, text in zip(*(column_of(batch, n).to_pylist() for n in ("lang", "source", "text")), strict=True):
                block.add(lang, source, text)
                if block.entries >= block_terms:
                    yield from block.run()
                    block = Block()
        yield from block.run()

    return texts.mapInArrow(postings, "lang string, source string, term string, count long, docs long")


def frequencies(docs: DataFrame, least_docs: int = LEAST_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, term, count and lang_count of the kept terms that a source has.

    ``heads`` is true on one row of each language and kept term.  Each source, with or without
    terms, also has a row with the empty term.
    """
    # Shards of (lang, term): counts of its sources and of the language need no other shuffle.
    merged = runs(docs, block_terms).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    return (
        merged.withColumn("held", F.sum("docs").over(of_term))
        .withColumn("lang_count", F.sum("count").over(of_term))
        .withColumn("heads", F.col("source") == F.min("source").over(of_term))
        .where((F.col("held") >= least_docs) | (F.col("term") == ""))
        .select("lang", "source", "term", "count", "lang_count", "heads")
    )


def weight(count: Column, all_counts: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (all_counts + terms)), exact for any counts; 1 without terms."""
    whole = (count + 1).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    total = F.nullif(all_counts + terms, F.lit(0)).cast("decimal(20,0)")
    return F.coalesce(F.lit(1) + F.call_function("div", whole, total), F.lit(1)).cast("long")


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def corrections(kept: DataFrame) -> DataFrame:
    """Sums of corrections over terms that both sources have: lang, source, item, value.

    kept has lang, term, source, its weight p of the term and p0 of absent terms.
    Every term's rows meet in one shard in order; only sums leave it.
    """

    def corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[str, str], int] = {}
        sums: dict[int, int] = {}

        def out() -> pa.RecordBatch:
            names = list(numbers)
            keys = [(names[k >> 32], names[k & 0xFFFFFFFF], v) for k, v in sums.items()]
            sums.clear()
            columns = [[g[0] for g, _, _ in keys], [g[1] for g, _, _ in keys], [h[1] for _, h, _ in keys], [v for _, _, v in keys]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["lang", "source", "item", "value"])

        held: pa.Table | None = None
        for batch in chain(batches, (None,)):
            rows = pa.Table.from_batches([batch]) if batch is not None else None
            rows = held if rows is None else rows if held is None else pa.concat_tables([held, rows])
            if rows is None or not len(rows):
                continue
            langs, terms = (rows[n].combine_chunks().dictionary_encode() for n in ("lang", "term"))
            langs, terms = (x.indices.to_numpy() for x in (langs, terms))
            starts = np.flatnonzero(np.append(True, (langs[1:] != langs[:-1]) | (terms[1:] != terms[:-1])))
            if batch is not None:  # the last term may go on
                held = rows.slice(int(starts[-1]))
                rows, starts = rows.slice(0, int(starts[-1])), starts[:-1]
            if not len(rows):
                continue
            source = np.array([numbers.setdefault(k, len(numbers)) for k in zip(rows["lang"].to_pylist(), rows["source"].to_pylist(), strict=True)])
            p, p0 = rows["p"].to_numpy(), rows["p0"].to_numpy()
            size = np.diff(np.append(starts, len(rows)))
            first, partners = np.repeat(starts, size), np.repeat(size, size)
            ends = np.cumsum(partners)
            at = 0
            while at < len(rows):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PASS_PAIRS, "right")))
                g = np.repeat(np.arange(at, to), partners[at:to])
                h = gathered(first[at:to], partners[at:to])
                g, h = g[g != h], h[g != h]
                if len(g):
                    value = between(p[g], p[h]) - between(p[g], p0[h]) - between(p0[g], p[h]) + between(p0[g], p0[h])
                    key = (source[g] << 32) + source[h]
                    order = np.argsort(key, kind="stable")
                    key, value = key[order], value[order]
                    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    for k, v in zip(key[begins].tolist(), np.add.reduceat(value, begins).tolist(), strict=True):
                        sums[k] = sums.get(k, 0) + v
                    if len(sums) >= MOST_SUMS:
                        yield out()
                at = to
        if sums:
            yield out()

    shards = kept.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return shards.mapInArrow(corrected, "lang string, source string, item string, value long")


def between(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = 200, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: divergence of sources, and the terms that mark a source.

    Part ``pair``: every other source of the language, with the sum of f over all kept terms.
    Part ``term``: the terms a source uses more than its language, with f, up to rank
    ``most_terms`` (the report's length).  Null lang, source and text are empty ones;
    rows that repeat an id or a text all count; sources without terms stay in part ``pair``; a lone
    source has no pairs; an empty table gives no rows; doc_id and other columns are ignored.  A
    very long text is one row of a block.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "frequencies")
    frequencies(docs, least_docs, block_terms).write.parquet(folder)

    def saved() -> DataFrame:
        return spark.read.parquet(folder)

    is_term = F.col("term") != ""
    group = saved().groupBy("lang", "source").agg(F.sum("count").alias("all_counts"), F.count_if(is_term).alias("own_terms"), F.count_if(is_term & F.col("heads")).alias("terms"))
    of_lang = Window.partitionBy("lang")  # a row for each source
    groups = group.withColumn("terms", F.sum("terms").over(of_lang)).withColumn("lang_counts", F.sum("all_counts").over(of_lang))
    groups = groups.withColumn("p0", weight(F.lit(0).cast("long"), F.col("all_counts"), F.col("terms")))
    kept = saved().where(is_term).join(groups, ["lang", "source"]).withColumn("p", weight(F.col("count"), F.col("all_counts"), F.col("terms")))

    # How many terms of a source have each weight, the absent ones with p0.
    present = saved().where(is_term).groupBy("lang", "source", "count").agg(F.count("*").alias("n")).join(groups, ["lang", "source"])
    histogram = present.select("lang", "source", weight(F.col("count"), F.col("all_counts"), F.col("terms")).alias("p"), "n", "p0").unionByName(
        groups.select("lang", "source", F.col("p0").alias("p"), (F.col("terms") - F.col("own_terms")).alias("n"), "p0")
    )
    salted = histogram.withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALTS)).cast("int"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), "terms").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = salted.join(others, ["lang", "salt"]).where(F.col("source") != F.col("item"))
    own = met.groupBy("lang", "source", "item").agg(
        F.sum(F.col("n") * difference(F.col("p"), F.col("q0"))).alias("ahead"),
        F.sum(F.col("n") * difference(F.col("q0"), F.col("p"))).alias("behind"),
        F.max(F.col("terms") * difference(F.col("p0"), F.col("q0"))).alias("absent"),
    )
    parts = (
        own.select("lang", "source", "item", (F.col("ahead") - F.col("absent")).alias("value"))
        .unionByName(own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("behind").alias("value")))
        .unionByName(corrections(kept.select("lang", "term", "source", "p", "p0")))
    )
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    in_order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(in_order))

    marked = kept.withColumn("q", weight(F.col("lang_count"), F.col("lang_counts"), F.col("terms"))).where("p > q")
    marking = (
        marked.select("lang", "source", F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(in_order))
        .where(F.col("rank") <= most_terms)
    )
    named = [pairs.withColumn("part", F.lit("pair")), marking.withColumn("part", F.lit("term"))]
    return named[0].unionByName(named[1]).select("lang", "source", "part", "item", "value", "rank")


ORACLE_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT lang, source, row, term, count(*) AS n
      FROM (SELECT lang, source, row_number() OVER () AS row, unnest(words) AS term FROM
            (SELECT lang, source, words FROM d)) GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS lang_n FROM
      (SELECT lang, source, row, term, n FROM w) GROUP BY lang, term HAVING count(*) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_all FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, sum(w.n)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0)::HUGEINT AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS total
      FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000::HUGEINT * (f.n + 1)) // (f.total + v.v) AS p,
             1 + (1000000000::HUGEINT * (f.lang_n + 1)) // (v.lang_all + v.v) AS q FROM f JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
                    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
         ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
both_parts AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
               FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM both_parts WHERE part = 'pair' OR rank <= 200
"""
