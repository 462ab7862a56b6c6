"""Aligned tokens against tokens of whole texts by the libraries and bytes compared one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import token_alignment
from tidemark.llm.common import byte_characters

A, B, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
ODD = [
    "", None, " ", "  ", "x ", " x", "a  b   c", "\n\n a\n  b \t c", "Hello  World's 123 456", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "▁", "é è ﬁ", "日本語 テスト。 次", "🎉🎉 👩‍👩 x",
    "x" * 700, "a\x00b \x07", "a\xa0 b\x85 c　 d e", "« oui »", "ends in space ", "same", "same", "1234567890 " * 30,
]


def noise(seed, length):
    rng = random.Random(seed)
    return "".join(rng.choice(["a", "bc", " ", "  ", "\n", "'s", "12", "é", "日", "!?", " the", "\t", " ing", "tion", "\xa0", "。", " Über"]) for _ in range(length))


@pytest.fixture(scope="module")
def tokens():
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = {c: b for b, c in enumerate(byte_characters())}

    def both(text):
        if not text:
            return [], []
        a = [(i, bytes(byte_of[c] for c in own.id_to_token(i))) for i in own.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()) for i in pieces.encode(text) for p in [pieces.id_to_piece(i)]]
        whole = (" " + text).encode()
        return (a, b) if b"".join(t for _, t in a) == whole == b"".join(t for _, t in b) else ([], [])

    return both


def spans(found):
    at, out = 0, []
    for i, t in found:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(texts, tokens):
    """groups and links of each text by comparing all tokens' byte ranges."""
    out = []
    for text in texts:
        a, b = map(spans, tokens(text))
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for cut in cuts:
            own_a, own_b = ([str(i) for i, _, e in x if low < e <= cut] for x in (a, b))
            groups.append(",".join(own_a) + "|" + ",".join(own_b))
            low = cut
        links = []
        for i, s, e in a:
            links += [(i, j) for j, t, f in b if s < f and t < e]
        out.append((len(a), len(b), ";".join(groups), links))
    return out


def test_groups_and_measures_are_those_of_compared_byte_ranges(spark, tokens):
    texts = [*ODD, *(noise(k, 120) for k in range(30))]
    df = spark.createDataFrame([(None if k == 5 else k, t, k, "z") for k, t in enumerate(texts)], "doc_id long, text string, n_a int, pass string")
    want = brute(texts, tokens)
    count = Counter(p for *_, links in want for p in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    rows = token_alignment.audit(df.repartition(3), A, B, PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n_a, n_b, groups, links = want[5 if r.doc_id is None else r.doc_id]
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        counts = [count[p] for p in links]
        top = sum(count[a, b] == best[a] for a, b in links)
        n_groups = groups.count(";") + 1 if groups else 0
        assert tuple(r)[1:] == (n_a, n_b, n_groups, len(links), top, sum(counts), sha), texts[r.doc_id or 5]
    shown = {5 if r.doc_id is None else r.doc_id: r.groups for r in token_alignment.align(df, A, B, PATTERN).collect()}
    assert shown == {k: w[2] for k, w in enumerate(want)}
    assert shown[10] == shown[11] == "" and shown[20] == shown[21] != ""


def test_units_are_encoded_as_the_whole_text(tokens):
    own = token_alignment.loaded(A, B, PATTERN)
    for k in range(200):
        text = noise(k, 60)
        encoded = (" " + text).encode()
        starts = token_alignment.unit_starts(np.frombuffer(encoded, np.uint8), np.array([0, len(encoded)]))
        units = [encoded[s:e].decode() for s, e in zip(starts, [*starts[1:], len(encoded)], strict=True)]
        own.forget()
        own.learn(list(dict.fromkeys(units)))
        found = own.ids_a.take(np.array([own.known[u] for u in units]))[0].tolist()
        a, b = tokens(text)
        assert found == [i for i, _ in a]
        assert own.ids_b.take(np.array([own.known[u] for u in units]))[0].tolist() == [i for i, _ in b]


def test_long_texts_many_passes_and_empty_tables(spark, tokens, monkeypatch):
    long = "Many words, and a few numbers 12345 like this one; " * 3000
    df = spark.createDataFrame([(k, t) for k, t in enumerate([long, "short", long])], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in token_alignment.audit(df, A, B, PATTERN).collect()}
    a, b = tokens(long)
    assert (rows[0].n_a, rows[0].n_b) == (len(a), len(b)) and tuple(rows[0])[1:] == tuple(rows[2])[1:]
    assert rows[0].n_links == len(a) + len(b) - rows[0].n_groups
    assert token_alignment.audit(df.limit(0), A, B, PATTERN).count() == 0


def test_walks_equal_common_ends():
    rng = np.random.default_rng(5)
    for k in range(60):
        size = int(rng.integers(1, 400))
        share = rng.random()
        both = rng.random(size) < share
        ends = [np.flatnonzero(np.append((both if k % 2 else rng.random(size) < share) | (rng.random(size) < 0.3), True)) for _ in range(2)]
        common = np.intersect1d(*ends)
        middle = common[common < size][::3]
        lanes = [np.unique(np.concatenate([[0], np.searchsorted(e, middle) + 1, [len(e)]])) for e in ends]
        cut_a, cut_b = token_alignment.shared_ends(*ends, *lanes)
        assert ends[0][cut_a].tolist() == ends[1][cut_b].tolist() == common.tolist()
