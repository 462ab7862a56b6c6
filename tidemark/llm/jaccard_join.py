"""Join of texts by the Jaccard similarity of their word n-grams, through banded MinHash.

Every text gets a label of min-hashes in each of ``trees`` bands.  Two texts are
candidates if their labels are the same in some band.  The label is as long as
may be: from ``most_depth`` it is shortened, beforehand and for all texts alike,
until the chance that two texts at the threshold share one in any band reaches
the target recall.  No prefix tries are kept, as an LSH forest would.
Candidates are verified exactly on their n-gram sets.

Equal texts are one node, told apart by 128-bit digests.  A bucket never gives
all pairs of its members.  Instead each text goes to a block: the texts whose
least bucket-mate is the same (near copies nearly always have the same one),
split to about ``block`` texts or ``block_bytes`` of text, whichever is less.  A
text that shares a bucket with a text of another block visits that block as a
guest, or is visited, once however many buckets they share.  A task takes blocks
and parts of their guests up to about TASK_ROWS rows or TASK_BYTES of text, works
out similarities as products of incidence matrices, and gives counts of links and
local classes: a few numbers a text, whatever the number of links.

Counting the links of N texts that are all near copies of each other takes N
squared comparisons; they are dealt to tasks as N squared / (2 ``block``) guest
rows.

Classes of the whole (connected texts) come from alternating large-star and
small-star rounds on the local classes, written between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_of, fresh, materialise, mixed, segment_hashes, slices, small_batches, split_words, text_buffers, window_hashes

WORDS = 5
THRESHOLD = 0.8
TREES = 20
MOST_DEPTH = 8
TARGET_RECALL = 0.9995
BLOCK = 512
BLOCK_BYTES = 4 << 20
#: Rows and bytes of text of one verifying task, on average.
TASK_ROWS = 2000
TASK_BYTES = 16 << 20


def prefix_depth(threshold: float, trees: int, most_depth: int, target: float) -> int:
    """The longest prefix with the target recall at the threshold (1 if none has it)."""
    depth = most_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def shingles(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word n-grams and their text numbers, in order; repeats stay.

    A text of fewer words has one n-gram: all its words.
    """
    starts, ends, doc = split_words(data, offs)
    hashes = segment_hashes(data, starts, ends)
    grams, at = window_hashes(hashes, doc, words)
    count = np.bincount(doc, minlength=len(offs) - 1)
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short) == 0:
        return grams, doc[at]
    first = np.searchsorted(doc, short)
    whole = np.array([mixed(np.add.reduce(hashes[f : f + n] * np.arange(1, 2 * n, 2, dtype=np.uint64), keepdims=True))[0] for f, n in zip(first, count[short], strict=True)], np.uint64)
    all_grams, all_docs = np.concatenate([grams, whole]), np.concatenate([doc[at], short])
    order = np.argsort(all_docs, kind="stable")
    return all_grams[order], all_docs[order]


def bucket_keys(grams: np.ndarray, doc: np.ndarray, trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have n-grams, and for each its bucket in every trie."""
    texts, first = np.unique(doc, return_index=True)
    rng = np.random.default_rng(11)
    factor = rng.integers(1, 2**62, (trees, depth), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, (trees, depth), dtype=np.uint64)
    keys = np.zeros((len(texts), trees), np.uint64)
    for t in range(trees):
        key = np.full(len(texts), t + 1, np.uint64)
        for d in range(depth):
            least = np.minimum.reduceat((grams ^ shift[t, d]) * factor[t, d], first)
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least)
        keys[:, t] = key
    return texts, keys


def similar(sets: list[np.ndarray], others: list[np.ndarray], threshold: float, columns: int = 2048) -> np.ndarray:
    """Which sets are at least so similar to which others, exactly."""
    every = np.concatenate([*sets, *others])
    values, code, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    owner = np.repeat(np.arange(len(sets) + len(others)), [len(s) for s in (*sets, *others)])
    at = place[code]
    owner, at = owner[at >= 0], at[at >= 0]
    both = np.zeros((len(sets), len(others)))
    for low in range(0, len(shared), columns):
        here = (at >= low) & (at < low + columns)
        part = np.zeros((len(sets) + len(others), min(columns, len(shared) - low)), np.float32)
        part[owner[here], at[here] - low] = 1
        both += part[: len(sets)] @ part[len(sets) :].T
    size = np.array([len(s) for s in sets])[:, None] + np.array([len(s) for s in others])[None, :]
    return both >= threshold * (size - both) - 1e-9


def local_classes(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least of the numbers (below their count) of each one's class under the links (a symmetric matrix)."""
    label = ids.copy()
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1))
        if (least == label).all():
            return label
        label = least


def verify_block(ids: np.ndarray, guest: np.ndarray, sets: list[np.ndarray], first: bool, threshold: float) -> list[tuple[int, int, int]]:
    """(id, class, links) of every text of a block and its guests that has links here.

    Guests are only compared with the block's own; the own among themselves if ``first``.
    """
    own, visiting = np.flatnonzero(~guest), np.flatnonzero(guest)
    order = np.concatenate([own, visiting])
    links = np.zeros((len(order), len(order)), bool)
    m = len(own)
    if m == 0:
        return []
    compared = order if first else visiting
    if len(compared) == 0:
        return []
    found = similar([sets[i] for i in own], [sets[i] for i in compared], threshold)
    if first:
        links[:m, :] = found
        links[np.arange(m), np.arange(m)] = False
    else:
        links[:m, m:] = found
    links |= links.T
    n = links.sum(1)
    by_id = np.argsort(ids[order])
    label = ids[order][by_id][local_classes(links, np.argsort(by_id))]
    return [(int(ids[order[k]]), int(label[k]), int(n[k])) for k in np.flatnonzero(n)]


def connected(edges: DataFrame) -> DataFrame:
    """id, root of every node of the edges (a, b): root is the least id of its class."""
    def stars(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        to = e.join(least, "a")
        moved = to.where(F.col("b") > F.col("a")) if large else to
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialise(edges.where("a <> b").distinct())
    before, after = None, state(now)
    while before != after:
        now = materialise(stars(stars(now, large=True), large=False))
        before, after = after, state(now)
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )


def text_key() -> list[Column]:
    """128 bits of the text, in two numbers."""
    return [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]


def parts_of(rows: DataFrame, key: str, block: int, block_bytes: int) -> DataFrame:
    """In how many parts the rows of each key are dealt, so that neither rows nor bytes are too many on average."""
    most = F.greatest(F.count("*") / block, F.sum("bytes") / block_bytes)
    return rows.groupBy(key).agg(F.ceil(most).cast("int").alias("parts"))


def text_classes(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, most_depth: int = MOST_DEPTH,
    target_recall: float = TARGET_RECALL, block: int = BLOCK, block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k, l) of all rows with words, and (k, l, class, class_id, n_links, copies) of their texts.

    k and l are 128 bits of the text.  Within, texts go by a number given to each
    when they are first written.
    """
    spark = docs.sparkSession
    small_batches(spark)
    depth = prefix_depth(threshold, trees, most_depth, target_recall)
    k, l = text_key()  # noqa: E741
    texts = docs.select("doc_id", "text").where("text RLIKE '[^ \\\\t-\\\\r]'").withColumns({"k": k, "l": l})

    def bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                grams, doc = shingles(*text_buffers(column_of(part, "text")), words)
                rows, keys = bucket_keys(grams, doc, trees, depth)
                ids = [column_of(part, n).take(pa.array(np.repeat(rows, trees))) for n in ("k", "l")]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *ids], ["bucket", "k", "l"])

    nodes = texts.groupBy("k", "l").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max(F.octet_length("text").cast("long")).alias("bytes")
    )
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()))  # fixed once written
    buckets = materialise(texts.select("k", "l", "text").mapInArrow(bucket_rows, "bucket long, k long, l long").distinct())
    least = buckets.groupBy("bucket").agg(F.min("k").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = materialise(buckets.join(least, "bucket").join(nodes.select("k", "l", "id", "bytes"), ["k", "l"]).drop("k", "l"))
    home = shared.groupBy("id", "bytes").agg(F.min("pivot").alias("home"))
    blocks = materialise(
        home.join(parts_of(home, "home", block, block_bytes), "home")
        .select("id", "bytes", F.xxhash64("home", F.pmod(F.xxhash64("id"), "parts")).alias("block"))
    )
    placed = shared.select("bucket", "id").join(blocks, "id")
    there = placed.select("bucket", F.col("block").alias("at")).distinct()
    # Of two blocks either is visited, by a hash: none of many is visited by all others.
    visited = F.expr("at <> block AND (at < block) = (pmod(xxhash64(least(at, block), greatest(at, block)), 2) = 0)")
    visits = placed.join(there, "bucket").where(visited).select(F.col("at").alias("block"), "id", "bytes").distinct()
    visits = materialise(visits)
    n_own = blocks.groupBy("block").agg(F.count("*").alias("own"))
    busy = n_own.join(parts_of(visits, "block", 2 * block, block_bytes), "block", "left").where("own > 1 OR parts > 0").select(
        "block", F.coalesce("parts", F.lit(1)).alias("parts")
    )
    work = materialise(
        visits.join(busy, "block")
        .select("block", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id", F.lit(True).alias("guest"), "bytes")
        .unionByName(
            blocks.join(busy, "block").select(
                "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", F.lit(False).alias("guest"), "bytes"
            )
        )
    )
    rows, size = work.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    bins = int(max(1, rows // TASK_ROWS, size // TASK_BYTES))

    def gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                grams, doc = shingles(*text_buffers(column_of(part, "text")), words)
                order = np.lexsort((grams, doc))
                grams, doc = grams[order], doc[order]
                new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else doc
                grams, doc = grams[new.astype(bool)], doc[new.astype(bool)]
                offs = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))]).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(offs), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([column_of(part, "id"), sets], ["id", "grams"])

    # Only one row of each text that has work goes on; all others end at this join.
    wanted = nodes.join(blocks.select("id"), "id").select("k", "l", "id", "least")
    sets = (
        texts.join(wanted, ["k", "l"])
        .where(F.col("doc_id").eqNullSafe(F.col("least")))
        .select("id", "text")
        .mapInArrow(gram_sets, "id long, grams array<long>")
    )

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        for (_, part), group in rows.drop_duplicates(["block", "part", "id"]).groupby(["block", "part"], sort=False):
            ids, guest = group["id"].to_numpy(), group["guest"].to_numpy(bool)
            out += verify_block(ids, guest, group["grams"].tolist(), part == 0, threshold)
        return pd.DataFrame(out, columns=["id", "root", "n"]).astype("int64")

    found = materialise(
        work.drop("bytes")
        .join(sets, "id")
        .groupBy(F.pmod(F.xxhash64("block", "part"), F.lit(bins)).alias("bin"))
        .applyInPandas(verify, "id long, root long, n long")
    )
    links = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    roots = connected(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classed = nodes.join(roots, "id", "left").withColumn("class", F.coalesce("root", "id"))
    first = classed.groupBy("class").agg(F.min("least").alias("class_id"))
    of_text = classed.join(first, "class").join(links, "id", "left").select(
        "k", "l", "class", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "copies"
    )
    return texts.select("doc_id", "k", "l"), of_text


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links and n_copies.

    class_id is the least doc_id of the texts connected by links: similarities
    of at least ``threshold`` between the sets of ``words``-word n-grams.
    n_links counts the other different texts linked to the row's text, n_copies
    the rows with its text.  Words are runs of characters other than ASCII
    white space, compared as they are.  A text of fewer words is one n-gram.

    Null texts and texts without words are linked to nothing: class_id is their
    own doc_id, n_copies 1.  Rows that repeat count as copies.  Null ids are
    the least only where a class has no other.  An empty table gives no rows.
    A very long text is worked on by one task at a time.  Other columns are ignored.
    """
    rows, of_text = text_classes(docs, threshold, words)
    found = rows.join(of_text, ["k", "l"]).select("doc_id", "class_id", "n_links", F.col("copies").alias("n_copies"))
    blank = docs.where("text IS NULL OR NOT text RLIKE '[^ \\\\t-\\\\r]'")
    alone = blank.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return found.unionByName(alone)


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """The rows of docs with their class's least doc_id; rows without words stay.

    Of rows that repeat id and text one stays.  Edge cases as in near_duplicates.
    """
    rows, of_text = text_classes(docs, threshold, words)
    # Of texts that share the least id, the one with the least digest leads its class.
    leads = rows.join(of_text, ["k", "l"]).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    t, u, d, k, l, nth = fresh(docs, "t", "u", "d", "k", "l", "nth")  # noqa: E741
    leads = leads.groupBy("class").agg(F.min(F.struct("k", "l", "doc_id")).alias("lead")).select("lead.*").toDF(t, u, d)
    keyed = docs.withColumns(dict(zip((k, l), text_key(), strict=True)))
    kept = keyed.join(leads, (F.col(k) == F.col(t)) & (F.col(l) == F.col(u)) & F.col("doc_id").eqNullSafe(F.col(d)))
    same = Window.partitionBy(t, u, d).orderBy(t)
    kept = kept.withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1).select(*docs.columns)
    return kept.unionByName(docs.where("text IS NULL OR NOT text RLIKE '[^ \\\\t-\\\\r]'"))


#: DuckDB SQL over the view documents: the join by all shared n-grams. The forest's recall of links is 0.9995 at the threshold.
ORACLE_SQL = r"""
WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY least, text) AS id, * FROM (SELECT text, min(doc_id) AS least, count(*) AS copies FROM documents
  WHERE regexp_matches(text, '[^\x20\x09-\x0D]') GROUP BY text)),
w AS (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM n),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
k AS (SELECT id, count(*) AS size FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN k x ON x.id = a JOIN k y ON y.id = b WHERE shared >= 0.8 * (x.size + y.size - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
walk AS (SELECT id, id AS at FROM n UNION SELECT walk.id, e.b FROM walk JOIN e ON walk.at = e.a),
c AS (SELECT walk.id, min(least) AS class_id FROM walk JOIN n ON n.id = walk.at GROUP BY walk.id),
m AS (SELECT a AS id, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, copies AS n_copies FROM documents d JOIN n ON d.text = n.text JOIN c ON c.id = n.id LEFT JOIN m ON m.id = n.id
UNION ALL SELECT doc_id, doc_id, 0, 1 FROM documents WHERE text IS NULL OR NOT regexp_matches(text, '[^\x20\x09-\x0D]')
"""
