"""Tokens, counts and shards against the libraries and brute force."""

import base64
import hashlib
import math
import random
import zlib

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, sharding, token_counts

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")

ODD = [
    "", None, " ", "\n\n", "a", "hello  world \n\n x", "<|endoftext|> in <|endoftext|>text", "héé ñandú ß 日本語 🎉🎉", "don't we'll I'd 'sx", "x" * 3000,
    " " * 700 + "y", "word " * 900, "1234567890" * 200, "\t\t a\r\n b", "a b c",
]


def docs(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t) for i, t in enumerate(texts)], "doc_id long, text string")


def noise(seed, length):
    rng = random.Random(seed)
    return "".join(rng.choice(["a", "bc", " ", "  ", "\n", "'s", "12", "é", "日", "!?", " the", "\t"]) for _ in range(length))


@pytest.fixture(scope="module")
def own():
    with open(MULTI, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (40, 39), (1 << 15, 512)])
def test_ids_are_those_of_the_library_whatever_the_chunks(spark, own, chunk, overlap):
    texts = [*ODD, *(noise(i, 300) for i in range(12))]
    got = {r.doc_id: r.ids for r in bpe.encode(docs(spark, texts), MULTI, public_tokenizers.PATTERN, chunk, overlap).collect()}
    assert got == {i: own.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_digests_and_round_trip(spark, own):
    df = docs(spark, ODD).unionByName(docs(spark, ODD[3:5], 3)).unionByName(spark.createDataFrame([(None, "no id")], "doc_id long, text string"))
    rows = bpe.digests(df, MULTI, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        text = "no id" if r.doc_id is None else ODD[r.doc_id] or ""
        ids = own.encode_ordinary(text)
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256(text.encode()).hexdigest())
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_repeated_long_rows_and_empty_tables(spark, own):
    text = noise(5, 400)
    df = docs(spark, [text]).unionByName(docs(spark, [text]))
    got = bpe.encode(df, MULTI, public_tokenizers.PATTERN, 64, 16).collect()
    assert [r.ids for r in got] == [own.encode_ordinary(text)] * 2
    assert bpe.digests(df.limit(0), MULTI, public_tokenizers.PATTERN).count() == 0
    assert token_counts.count_tokens(df.limit(0), JSON).count() == 0
    assert sharding.assign_shards(df.limit(0)).count() == 0


@pytest.mark.parametrize("long_bytes", [64, 1 << 16])
def test_counts_are_those_of_the_library(spark, long_bytes):
    texts = [*ODD, *(noise(i, 400) for i in range(8)), noise(1, 400)]
    library = Tokenizer.from_file(JSON)
    rows = token_counts.count_tokens(docs(spark, texts).withColumnRenamed("doc_id", "doc_id"), JSON, long_bytes).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 1024) for r in rows)
    twice = token_counts.count_tokens(docs(spark, texts[5:6] * 1).unionByName(docs(spark, texts[5:6])), JSON, 8).collect()
    assert [r.n_tokens for r in twice] == [len(library.encode(texts[5], add_special_tokens=False).ids)] * 2


def test_safe_parts_join_and_cut_only_between_letters(spark):
    text = noise(3, 2000)
    parts = token_counts.safe_parts(text, 50)
    assert "".join(parts) == text and len(parts) > 3
    assert all(regex.match(r" \p{L}", p) and regex.search(r"\p{L}$", q) for q, p in zip(parts, parts[1:], strict=False))


def test_shards_are_balanced_gapless_and_keep_copies_together(spark):
    rng = random.Random(1)
    texts = ["x" * rng.randint(0, 40) + str(i) for i in range(3000)] + ["a copy of some text"] * 200 + [None, ""]
    rows = sharding.assign_shards(docs(spark, texts), shards=6, virtual_nodes=64).collect()
    assert len(rows) == len(texts)
    size = {s: 0 for s in range(6)}
    slots: dict[int, list[int]] = {s: [] for s in range(6)}
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text))
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 6
    assert all(abs(s / mean - 1) < 0.02 for s in size.values())
    assert len({r.shard for r in rows if texts[r.doc_id] == "a copy of some text"}) <= 2


def test_growing_moves_few_rows(spark):
    df = docs(spark, [f"text number {i}" * (1 + i % 7) for i in range(20000)])
    less = {r.doc_id: r.shard for r in sharding.assign_shards(df, shards=24).collect()}
    more = {r.doc_id: r.shard for r in sharding.assign_shards(df, shards=25).collect()}
    assert sum(less[i] != more[i] for i in less) < 2 * len(less) / 25  # at best one row in 25


@pytest.mark.parametrize("fineness", [2, 20, 1000])  # rows placed whole: none or few, some, all
def test_shards_equal_filling_the_ring_byte_by_byte(spark, fineness):
    rng = random.Random(2)
    texts = ["y" * rng.randint(0, 30) + str(i % 150) for i in range(400)] + ["copy"] * 90 + [None, "", "é" * 40] + ["long" * rng.randint(20, 250) for _ in range(9)]
    df = docs(spark, texts)
    place = {r.doc_id: r.p for r in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("p")).collect()}
    places, owners = sharding.ring(5, 8)
    size = {i: len((t or "").encode()) + 8 for i, t in enumerate(texts)}
    total = sum(size.values())
    arc = {i: next((k for k, p in enumerate(places) if p >= place[i]), 0) for i in size}
    clockwise = {a: [owners[(a + n) % len(owners)] for n in range(len(owners))] for a in range(len(owners))}
    large = sorted((i for i in size if size[i] * 5 * fineness >= total), key=lambda i: (-size[i], arc[i], place[i], i))
    held, want = [0] * 5, {}
    for i in large:
        fits = [s for s in clockwise[arc[i]] if held[s] + size[i] <= total * (1 + sharding.SLACK) / 5]
        want[i] = fits[0] if fits else held.index(min(held))
        held[want[i]] += size[i]
    rest = {i for i in size if i not in want}
    most = next(m for m in range(total + 1) if sum(max(0, m - h) for h in held) >= sum(size[i] for i in rest))
    room = [max(0, math.ceil(sharding.level(held, sum(size[i] for i in rest)) * (1 + sharding.SLACK)) - h) for h in held]
    assert not rest or 0 <= math.ceil(sharding.level(held, sum(size[i] for i in rest))) - most <= 1
    for a in sorted({arc[i] for i in rest}):
        node, taken = a, []
        rows = sorted((i for i in rest if arc[i] == a), key=lambda i: (place[i], i))
        for _ in range(sum(size[i] for i in rows)):
            while room[owners[node % len(owners)]] <= 0:
                node += 1
            room[owners[node % len(owners)]] -= 1
            taken.append(owners[node % len(owners)])
        at = 0
        for i in rows:
            want[i] = taken[at + size[i] - size[i] // 2 - 1]
            at += size[i]
    got = {r.doc_id: r.shard for r in sharding.assign_shards(df, shards=5, virtual_nodes=8, fineness=fineness).collect()}
    assert got == want


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_sizes_are_near_equal_though_some_rows_are_long(spark, folder):
    documents = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    rows = sharding.assign_shards(documents).groupBy("shard").agg(F.sum("size").alias("size"), F.max("size").alias("longest")).collect()
    mean = sum(r.size for r in rows) / 24
    assert len(rows) == 24 and all(abs(r.size / mean - 1) < 0.01 or r.size == r.longest > mean for r in rows)


def test_very_long_texts_are_sharded_and_counted(spark):
    long = "many words " * 200_000
    df = docs(spark, [long, long, "short"])
    rows = sharding.assign_shards(df, shards=2, virtual_nodes=4).collect()
    assert sorted(r.size for r in rows) == [13, len(long) + 8, len(long) + 8] and len({r.shard for r in rows if r.size > 100}) == 2
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, JSON).collect()}
    assert counts[0] == counts[1] == len(Tokenizer.from_file(JSON).encode(long, add_special_tokens=False).ids)


def test_clashing_names_of_token_columns(spark, own):
    df = spark.createDataFrame([(1, "some text here", 5, "x", 7), (None, None, 6, "y", 8)], "doc_id long, text string, n_tokens int, ids string, copies int")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.count_tokens(df, JSON, 4).collect())[1][0] == 1
    got = {r.doc_id: r.n_tokens for r in bpe.digests(df, MULTI, public_tokenizers.PATTERN).collect()}
    assert got == {1: len(own.encode_ordinary("some text here")), None: 0}


def test_bounded_loads_fill_clockwise():
    assert sharding.settle({0: 10, 1: 2}, [0, 1], [6, 6]) == [(0, 0, 6, 0), (0, 6, 10, 1), (1, 0, 2, 1)]
    assert sharding.settle({}, [0, 1], [0, 0]) == []
    assert sharding.level([0, 0], 12) == 6 and sharding.level([10, 0, 2], 6) == 4 and sharding.level([3, 3], 0) == 3
    assert sharding.place_whole([(0, 9), (0, 5), (1, 5), (1, 5)], [0, 1], 2, 12) == [0, 1, 1, 0]


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "same", 9, "z"), (1, "same", 8, "y"), (None, "same", 7, "x")], "doc_id long, text string, shard int, arc string")
    rows = sharding.assign_shards(df, shards=2).collect()
    assert len(rows) == 3 and sorted((r.shard, r.slot) for r in rows) == sorted({(r.shard, r.slot) for r in rows})
