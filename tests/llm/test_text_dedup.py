"""Near copies, repeated passages and benchmark passages against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard_join, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def edited(base, seed, edits):
    rng, out = random.Random(seed), list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def brute(rows, words_n=5, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = frozenset(tuple(w[k : k + words_n]) for k in range(max(1, len(w) - words_n + 1))) if w else frozenset()
    label = {i: i for i, _ in rows}
    text = dict(rows)
    links = {i: set() for i, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
                if text[a] != text[b]:
                    links[a].add(text[b])
                    links[b].add(text[a])
    return {i: (label[i], len(links[i])) for i in label}


@pytest.fixture(scope="module")
def near_rows():
    base = words(1, 120)
    rows = [" ".join(words(100 + i, 60)) for i in range(20)]
    rows += [edited(base, i, i % 5) for i in range(40)]  # a group of near copies, some too far from others
    rows += [rows[3], rows[3], "a b", "a b", "a b c", "", " \n ", None, edited(words(103, 60), 1, 1)]
    return list(enumerate(rows))


def test_join_equals_brute_force(spark, near_rows):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(docs(spark, near_rows)).collect()}
    assert got == brute(near_rows)


def test_small_blocks_give_the_same(spark, near_rows):
    rows, of_text = jaccard_join.text_classes(docs(spark, near_rows), block=4, block_bytes=3000)
    got = {r.doc_id: (r.class_id, r.n_links) for r in rows.join(of_text, ["k", "l"]).collect()}
    want = brute(near_rows)
    assert got == {i: want[i] for i in got} and len(got) == len(near_rows) - 3


def test_depth_is_shortened_until_the_recall():
    assert jaccard_join.prefix_depth(0.8, 20, 8, 0.9995) == 5
    assert jaccard_join.prefix_depth(0.8, 20, 3, 0.9) == 3
    assert jaccard_join.prefix_depth(0.1, 2, 8, 0.9999) == 1


def test_one_of_each_class_stays(spark, near_rows):
    kept = sorted((r.doc_id for r in jaccard_join.one_of_each_class(docs(spark, near_rows)).collect()))
    want = brute(near_rows)
    blank = [i for i, t in near_rows if not (t or "").strip()]
    assert kept == sorted({c for i, (c, _) in want.items() if i not in blank} | set(blank))


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    text = " ".join(words(5, 30))
    df = spark.createDataFrame([(1, text, "b"), (1, text, "a"), (None, text, "c"), (None, "other words here", "d")], "doc_id long, text string, class_id string")
    assert sorted((r.class_id or -1, r.n_copies) for r in jaccard_join.near_duplicates(df).collect()) == [(-1, 1), (1, 3), (1, 3), (1, 3)]
    assert [r.doc_id for r in jaccard_join.one_of_each_class(df).orderBy("doc_id").collect()] == [None, 1]
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_passages_over_fifty_words_go_but_short_ones_stay(spark):
    passage, short = " ".join(words(7, 60)), " ".join(words(8, 12))
    rows = [(i, " ".join([*words(200 + i, 40 + i), passage if i % 2 else short, *words(300 + i, 50)])) for i in range(12)]
    out = {r.doc_id: r for r in substring_dedup.without_repeats(docs(spark, rows)).collect()}
    assert len(out) == len(rows)
    for i, text in rows:
        if i % 2 == 0 or i == 1:
            assert out[i].text == text and out[i].n_chars == len(text)
        else:
            assert len(out[i].text.split()) <= len(text.split()) - 40 and out[i].n_chars == len(out[i].text)
            kept = Counter(text.split()) - Counter(passage.split())
            assert not kept - Counter(out[i].text.split())  # nothing but the passage went
    found = {r.doc_id: r for r in substring_dedup.find_repeats(docs(spark, rows)).collect()}
    assert sorted(found) == [1, 3, 5, 7, 9, 11]
    assert found[1].n_words_removed == 0 and found[3].first_ids == [1] and found[3].n_words_removed >= 40


def test_chunks_resist_insertions():
    import pyarrow as pa

    from tidemark.llm.common import text_buffers

    base = words(9, 400)
    one, two = " ".join(base), " ".join([*base[:100], "inserted", "words", *base[100:]])
    digest, text, _, _ = substring_dedup.chunks_of(*text_buffers(pa.array([one, two])))
    shared = set(digest[text == 0].tolist()) & set(digest[text == 1].tolist())
    assert len(shared) > 0.9 * (text == 0).sum()


def test_dedup_edge_cases(spark):
    long = " ".join(words(11, 80))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (4, long), (5, long), (None, long), (6, "é " * 500), (7, "x" * 5000)]
    got = [(r.doc_id, r.text) for r in substring_dedup.without_repeats(docs(spark, rows)).collect()]
    assert len(got) == len(rows)
    assert [t for i, t in got if i == 4] == [long, long] and [t for i, t in got if i == 5] == [""] and [t for i, t in got if i is None] == [""]
    assert dict(got)[1] is None and dict(got)[7] == "x" * 5000
    assert substring_dedup.find_repeats(docs(spark, rows).limit(0)).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_leaks_with_edits_are_found_and_only_those(spark):
    rng = random.Random(4)
    items = [(k, " ".join(words(400 + k, 30))) for k in range(8)]
    rows, want = [], {}
    for i in range(40):
        k = i % 8
        text = items[k][1]
        limit = int(len(text) * decontamination.EDIT_SHARE)
        edits = rng.choice([0, 1, limit])
        chars = list(text)
        for _ in range(edits):
            at = rng.randrange(len(chars))
            kind = rng.random()
            chars[at : at + 1] = ["Z"] if kind < 0.4 else [] if kind < 0.7 else [chars[at], "q"]
        planted = "".join(chars).upper() if i % 5 == 0 else "".join(chars).replace(" ", "\n")
        if i % 4 == 3:
            planted = " ".join(words(900 + i, 30))
        else:
            want[i] = k
        rows.append((i, " ".join([*words(500 + i, 20), planted, *words(600 + i, 20)])))
    bench = spark.createDataFrame([*items, (99, None), (98, "short")], "item_id long, text string")
    found = decontamination.find_leaks(docs(spark, rows), bench).collect()
    assert {r.doc_id: r.item_id for r in found} == want and len(found) == len(want)
    text = dict(rows)
    for r in found:
        item = items[r.item_id][1]
        assert levenshtein(text[r.doc_id][r.start : r.end].lower().replace("\n", " "), item) <= r.edits <= len(item) * decontamination.EDIT_SHARE
    blocks = decontamination.find_leaks(docs(spark, rows), bench, block_chars=500).collect()
    assert sorted(blocks) == sorted(found)
    clean = {r.doc_id: r for r in decontamination.without_leaks(docs(spark, rows), bench).collect()}
    assert len(clean) == len(rows) and all((clean[i].text == t) == (i not in want) for i, t in rows)
    assert all(r.n_chars == len(r.text) for r in clean.values())


def test_leak_edge_cases(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over it")], "item_id long, text string")
    rows = [(None, "x the quick brown fox jumps over it"), (2, None), (3, ""), (4, "the quick brown fox jumps over it" * 2), (4, "the quick brown fox jumps over it" * 2)]
    found = decontamination.find_leaks(docs(spark, rows), bench)
    assert sorted((r.doc_id or 0, r.start) for r in found.collect()) == [(0, 2), (4, 0), (4, 0), (4, 33), (4, 33)]
    assert [r.text for r in decontamination.without_leaks(docs(spark, rows), bench).orderBy("doc_id").collect()] == ["x ", None, "", "", ""]
    assert decontamination.find_leaks(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontamination.find_leaks(docs(spark, rows).limit(0), bench).count() == 0


def test_marks_of_copies_are_those_of_one(spark):
    text = " ".join(f"word{i} and more" for i in range(100))
    df = spark.createDataFrame([(None, text)] * 40 + [(1, text)], "doc_id long, text string")
    repeated = substring_dedup.repeated_digests(df).cache()
    assert [len(r.marks) for r in substring_dedup.marks(df, repeated).collect()] == [repeated.count()] * 2


def chunks_by_definition(text):
    """(start, end) in bytes of each chunk."""
    raw = text.encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    gear = [int(g) for g in substring_dedup.GEAR]
    value = [sum(gear[raw[s - 1 - i]] << i for i in range(16)) % 65536 if s >= 16 else 1 << 32 for s, _ in found]
    cuts, since = [], 0
    for w in range(len(found)):
        near = all(value[w] < v for v in value[max(0, w - 3) : w]) and all(value[w] <= v for v in value[w + 1 : w + 4])
        natural = w == 0 or near
        since = 0 if natural else since + 1
        if natural or since % 64 == 0:
            cuts.append(w)
    return [(found[c][0], found[e - 1][1]) for c, e in zip(cuts, [*cuts[1:], len(found)], strict=True)] if found else []


def repeats_by_brute_force(rows, min_words):
    """{(id, text): (words repeated, words removed, text left)} of rows with a repeated passage."""
    held = {}
    for i, t in rows:
        for s, e in chunks_by_definition(t or ""):
            held.setdefault(t.encode()[s:e], []).append(i)
    first = {c: min((i for i in ids if i is not None), default=None) for c, ids in held.items() if len(ids) > 1}
    out = {}
    for i, t in set(rows):
        raw, seen, every, later = (t or "").encode(), set(), [], []
        for s, e in chunks_by_definition(t or ""):
            if raw[s:e] in first:
                every.append((s, e))
                if first[raw[s:e]] != i or raw[s:e] in seen:
                    later.append((s, e))
                seen.add(raw[s:e])

        def passages(spans, raw=raw):
            joined = []
            for s, e in spans:
                if joined and not raw[joined[-1][1] : s].strip():
                    joined[-1] = (joined[-1][0], e)
                else:
                    joined.append((s, e))
            return [(s, e) for s, e in joined if len(raw[s:e].split()) >= min_words]

        if passages(every):
            left, at = b"", 0
            for s, e in [*passages(later), (len(raw), len(raw))]:
                left += raw[at:s].lstrip() if at else raw[at:s]
                at = e
            n = [sum(len(raw[s:e].split()) for s, e in passages(x)) for x in (every, later)]
            out[i, t] = (*n, left.decode())
    return out


def test_repeats_are_those_of_brute_force(spark):
    rng = random.Random(21)
    pool = [words(700 + k, rng.randint(20, 90)) for k in range(8)]
    rows = []
    for k in range(70):
        parts = [rng.choice(pool) if rng.random() < 0.4 else words(800 + 10 * k + j, rng.randint(1, 40)) for j in range(rng.randint(1, 5))]
        rows.append((rng.choice([None, *range(40)]), rng.choice([" ", "\n", " \n"]).join(w for p in parts for w in p)))
    rows += rows[:5] + [(3, None), (4, ""), (5, " "), (6, "same " * 200), (7, "é " * 90 + "same " * 100)]
    want = repeats_by_brute_force(rows, 28)
    got = {(r.k, r.whole): (r.n_words_repeated, r.n_words_removed, r.text) for r in substring_dedup.find_repeats(docs(spark, rows))
           .join(docs(spark, rows).select(F.col("doc_id").alias("k"), F.col("text").alias("whole")).distinct(), F.expr("doc_id <=> k AND text_crc = crc32(cast(whole AS binary))")).collect()}
    assert got == want and len(want) > 30


def test_dedup_keeps_columns_of_any_name(spark):
    text = " ".join(words(31, 80))
    df = spark.createDataFrame([(1, text, 5, "x", 7), (2, f"a {text}", 6, "y", 8)], "doc_id long, text string, k int, marks string, _spans int")
    out = substring_dedup.without_repeats(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.k, r.marks, r._spans) for r in out.collect()) == [(1, 5, "x", 7), (2, 6, "y", 8)]


def places(texts, items, q=12, edit_share=0.05):
    return decontamination.matches_in(texts, decontamination.build_indexes(items, q, edit_share), q)


def test_one_odd_letter_leaves_the_rest_in_lower_case():
    item = "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG AND RUNS HOME"
    text = f"İstanbul is far. {item} Then it rains."
    assert places([text], [item.lower()]) == [(0, 0, text.index(item), text.index(item) + len(item), 0)]
    odd = f"İ {item}"
    assert places([f"x {odd.lower()} y {odd} z"], [odd])[-1][4] == 0


def test_any_white_space_is_a_space():
    item = "the quick brown fox jumps over the lazy dog"
    for space in ("\u00a0", "\u2003", "\u3000", "\n", "\t", "\u0085"):
        text = f"so {item.replace(' ', space)}."
        assert places([text], [item]) == [(0, 0, 3, 3 + len(item), 0)]


def test_short_items_are_found_where_they_stand_alone():
    assert places(["Paris, paris and Parisian; 42 or 420 or 4\n2"], ["Paris", "42", "4 2", ""]) == [(0, 0, 0, 5, 0), (0, 0, 7, 12, 0), (0, 1, 27, 29, 0), (0, 2, 40, 43, 0)]


def least_edits(item, text):
    """The least edits of the whole item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return min(row)


def test_items_found_are_those_of_brute_force():
    rng = random.Random(12)
    letter = lambda: rng.choice("abcd ")
    items = ["".join(letter() for _ in range(rng.randint(12, 70))) for _ in range(12)]
    texts = []
    for k in range(60):
        chars = list(items[k % 12])
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice([[letter()], [], [chars[at], letter()]])
        texts.append("".join(letter() for _ in range(rng.randint(0, 40))) + "".join(chars) + "".join(letter() for _ in range(rng.randint(0, 40))))
    got = {(t, i) for t, i, *_ in places(texts, items, q=4, edit_share=0.08)}
    budget = [min(int(len(x) * 0.08), (len(x) - 4) // 4) for x in items]
    want = {(t, i) for t, text in enumerate(texts) for i, x in enumerate(items) if least_edits(x, text) <= budget[i]}
    assert got == want and 30 < len(want) < 72


def test_leaks_with_clashing_names_and_null_items(spark):
    item = "the quick brown fox jumps over the lazy dog"
    df = spark.createDataFrame([(1, f"a {item} b", 7, "x", 9), (None, None, 7, "y", 9)], "doc_id long, text string, found int, _found string, start int")
    bench = spark.createDataFrame([(None, item), (3, item)], "item_id long, text string")
    assert sorted((r.item_id or 0, r.start) for r in decontamination.find_leaks(df, bench).collect()) == [(0, 2), (3, 2)]
    for chars in (50, 10**6):  # two blocks, one block
        out = decontamination.without_leaks(df, bench, block_chars=chars)
        assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=repr) == [(1, "a  b", 7, "x", 9), (None, None, 7, "y", 9)]


def test_near_copies_with_clashing_names(spark):
    base = words(41, 60)
    rows = [(1, " ".join(base), 5, "x", 1), (2, edited(base, 1, 1), 6, "y", 2), (3, None, 7, "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t int, text_id string, nth int")
    kept = jaccard_join.one_of_each_class(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.t, r.text_id, r.nth) for r in kept.collect()) == [(1, 5, "x", 1), (3, 7, "z", 3)]


def test_a_large_class_loses_no_link(spark):
    """Near copies at and about the threshold, many more than a block holds, against all pairs."""
    base = words(43, 120)
    rows = [(i, edited(base, 5000 + i, i % 8)) for i in range(260)] + [(1000 + i, " ".join(words(6000 + i, 80))) for i in range(60)]
    _, of_text = jaccard_join.text_classes(docs(spark, rows), block=32)
    got = {(r.class_id, r.n_links) for r in of_text.collect()}
    want = brute(rows)
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(docs(spark, rows)).collect()}
    assert found == want and got == set(want.values())
    assert sum(n for _, n in want.values()) > 3_000
