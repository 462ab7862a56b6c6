"""Word BPE against the library, and its merge rounds against merging one place after the other."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import word_bpe
from tidemark.llm.common import Pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, " ", "\n\n\t", "Hello  World's DON'T 123 abc-def!!", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|>", "é é É ﬁ", "ΣΊΣΥΦΟΣ İstanbul", "x" * 3000,
    "aaaa aaaaa aaaaaaa", "日本語 テスト 🎉🎉👩‍👩", "a\x1cb\x0bc\x0cd\x85e\xa0f　g", "'s 'S it'LL", "٣٤ ½ Ⅷ", "ạ́ b", "<|endoftext|>", "<|endoftext", " x   x ", "a\x00b",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def noise(seed, length):
    rng = random.Random(seed)
    return "".join(rng.choice(["a", "Bc", " ", "  ", "\n", "'s", "12", "é", "É", "日", "!?", " the", "\t", " ", "é", "<|endoftext|>", "ß", "Я", "‍", "и"]) for _ in range(length))


def test_ids_and_texts_are_those_of_the_library(spark, library):
    texts = [*ODD, *(noise(i, 300) for i in range(40)), "many Words here, " * 40_000]
    rows = word_bpe.decode(word_bpe.encode(docs(spark, texts), PATH), PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False), texts[r.doc_id]


def test_digests_repeated_rows_nulls_and_clashing_columns(spark, library):
    df = spark.createDataFrame([(1, "Same text", 5, "x"), (1, "Same text", 6, "y"), (None, None, 7, "z"), (None, "Other", 8, "w")], "doc_id long, text string, n_tokens int, ids string")
    rows = word_bpe.digests(df, PATH).collect()
    want = []
    for doc_id, text in ((1, "Same text"), (1, "Same text"), (None, ""), (None, "Other")):
        ids = library.encode(text, add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert word_bpe.digests(df.limit(0), PATH).count() == 0


def test_decode_of_null_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, None, "keep"), (2, [], "me"), (3, [320, 49407], "too")], "n int, ids array<int>, decoded string")
    assert [(r.n, r.decoded) for r in word_bpe.decode(df, PATH).orderBy("n").collect()] == [(1, ""), (2, ""), (3, "a</w> <|endoftext|>")]
    with pytest.raises(Exception, match="KeyError"):
        word_bpe.decode(spark.createDataFrame([([10**6],)], "ids array<int>"), PATH).collect()


def one_after_the_other(own, rank, word):
    """Merge the leftmost pair of the lowest rank until there is none."""
    symbols = [*own.inner[list(word[:-1])].tolist(), int(own.last[word[-1]])]
    while pairs := [(rank[a * own.size + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a * own.size + b in rank]:
        low, at = min(pairs)
        symbols[at : at + 2] = [int(own.made[low])]
    return symbols


@pytest.mark.parametrize("at_once", [True, False])
def test_merge_rounds_equal_one_merge_after_the_other(at_once):
    own = word_bpe.WordBpe(PATH)
    assert own.at_once
    own.at_once = at_once
    rng = random.Random(3)
    words = [bytes(rng.choice(b"aaaabcdeinnoorsst\xc3\xa9") for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    words += [b"a" * n for n in range(1, 40)] + [b"haha" * 7, b"nananan"]
    ids, offs = own.merged(words)
    rank = {int(k): int(r) for k, r in zip(own.keys, own.rank, strict=True)}
    assert [ids[offs[k] : offs[k + 1]].tolist() for k in range(len(words))] == [one_after_the_other(own, rank, w) for w in words]
    assert own.merged([])[0].tolist() == []


def test_a_worker_forgets_and_goes_on(monkeypatch, library):
    import pyarrow as pa

    monkeypatch.setattr(word_bpe, "MOST_UNITS", 3)
    own = word_bpe.WordBpe(PATH)
    for k in range(5):
        ids, offs = own.encode(pa.array([f"one two three {k}", "four five"]))
        assert ids.tolist() == [i for t in (f"one two three {k}", "four five") for i in library.encode(t, add_special_tokens=False).ids] and len(offs) == 3
    assert len(own.known) < 12


def test_pieces_grow():
    pieces = Pieces(np.int32)
    for k in range(300):
        pieces.add(np.arange(k % 7 + k % 11 * 10), np.array([k % 7, k % 11 * 10]))
    values, lengths = pieces.take(np.array([599, 0, 25]))
    assert lengths.tolist() == [299 % 11 * 10, 0, 12 % 11 * 10] and values.tolist() == [*range(5, 25), *range(5, 15)]
