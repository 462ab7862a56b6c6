"""Each stage of the corpus pipeline on a small corpus of planted cases."""

import base64
import hashlib
import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_text_dedup import brute, least_edits, repeats_by_brute_force
from tidemark.llm import decontamination, queries, substring_dedup


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def test_stages_take_effect(spark, tmp_path):
    lines = lambda seed, n: "\n".join(" ".join(words(seed * 50 + k, 12)) for k in range(n))
    item, passage = " ".join(words(1, 40)), " ".join(words(2, 60))
    good = {i: lines(i, 8) for i in range(10, 40)}
    junk = {i: lines(i, 8).upper().replace(" ", "!! ") + " %%% $$$" for i in range(40, 60)}
    good[11] = good[10]  # an exact copy
    good[12] = good[10] + " more"  # a near copy
    good[13] += "\n" + passage
    good[14] += "\n" + passage
    good[15] += " " + item
    rows = [(i, t, "en", "s", len(t)) for i, t in {**good, **junk}.items()] + [(90, None, "en", "s", 0), (91, "", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(10, 60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(seen["quality_classifier"]) == set(good)
    assert set(seen["jaccard_join"]) == set(good) - {11, 12}
    cut = seen["substring_dedup"]
    assert set(cut) == set(good) - {11, 12} and passage in cut[13] and len(cut[14].split()) < len(good[14].split()) - 35
    clean = seen["decontamination"]
    assert item not in clean[15] and all(clean[i] == cut[i] for i in cut if i != 15)
    assert {r.doc_id for r in docs.collect()} == set(cut)
    # Every stage against brute force on what it was given.
    near = brute(sorted(seen["quality_classifier"].items()))
    assert set(seen["jaccard_join"]) == {c for c, _ in near.values()}
    given = seen["jaccard_join"]
    changed = repeats_by_brute_force(sorted(given.items()), substring_dedup.MIN_WORDS)
    assert cut == {i: changed[i, t][2] if (i, t) in changed else t for i, t in given.items()}
    budget = int(len(item) * decontamination.EDIT_SHARE)
    assert {i for i in clean if clean[i] != cut[i]} == {i for i in cut if least_edits(item, cut[i]) <= budget} == {15}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: own.encode_ordinary(t) for i, t in clean.items()}
    want = {i: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(clean[i].encode()).hexdigest()) for i, x in ids.items()}
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last} == want and len(last) == len(want)


def test_empty_tables_go_through(spark, tmp_path):
    schemas = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int",
        "benchmark": "item_id long, text string",
    }
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
