"""Pages, rules and classifiers against brute force and held-out labels."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import html_text, quality_crf, quality_rules, toxicity
from tidemark.llm.common import fold_remainder

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<title>T</title><p>Hello<br>there", "Hello there"),
        ("<body><nav><ul><li><a>x</a><li><a>y</a></ul><article><h1>T<p>Body text of the  article\n here.<p>Two<b>bold<p>Three</article>",
         "T\nBody text of the article here.\nTwobold\nThree"),
        ('<div class="ad">Buy now, buy a lot</div><article><p>Short.</p><p>A longer text that tells the whole story.</p></article><footer>&copy; x</footer>',
         "Short.\nA longer text that tells the whole story."),
        ('<main><h1>A</h1><form><p>Name <input></p></form><p>Real text of this page, quite long.</p></main><div id="comments"><p>I liked it, it was long and good.</p></div>',
         "A\nReal text of this page, quite long."),
        ('<body class="has-sidebar"><div class="sidebar"><p>Other things to read, many of them.</p></div><div class="content"><h1>T</h1><p>Text that is long enough to be it.</p><p>Ok.</p></div>',
         "T\nText that is long enough to be it.\nOk."),
        ('<script>var t="</p>";</script><style>p{}</style><p>x &lt;y&gt; &#233;</p>', "x <y> é"),
        ('<div class="ad">never closed<article><h1>T</h1><p>But here is the text.</p></article>', "T\nBut here is the text."),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (1, "u", "", "t"), (None, None, "<p>é</p>" , "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(df).collect()) == [(0, "é", 1), (1, "", 0), (1, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_rules_equal_their_sql(spark):
    odd = [(1, "a b\n\na b\n c", None, "s"), (2, None, "en", None), (2, "", "en", "s"), (3, " x\ty ", "en", "s"), (4, "w " * 40, "en", "s"), (4, "w " * 40, "en", "s"),
           (None, "A# b$ \n A# b$ " * 9, "de", "s"), (5, "é " * 3 + "\n", "de", "s"), (6, "one two three four five six seven eight nine ten eleven", "en", "s")]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string").withColumn("kept", F.lit("clash"))
    got = quality_rules.apply_rules(df).toPandas()
    connection = duckdb.connect()
    connection.register("documents", pd.DataFrame([r.asDict() for r in df.collect()]).astype({"doc_id": "Int64"}))
    want = connection.sql(quality_rules.ORACLE_SQL).fetchall()
    key = lambda rows: sorted(map(repr, rows))
    mine = [tuple(None if pd.isna(x) else (bool(x) if isinstance(x, (bool, np.bool_)) else int(x)) for x in r) for r in got.itertuples(index=False)]
    assert key(mine) == key(want)
    assert quality_rules.apply_rules(df.limit(0)).count() == 0


def test_buckets_are_monotone_and_narrow(spark):
    rows = spark.range(0, 3000).select("id", quality_rules.bucket_of(F.col("id")).alias("b")).orderBy("id").collect()
    assert all(x.b <= y.b for x, y in zip(rows, rows[1:], strict=False))
    low = {}
    for r in rows:
        low.setdefault(r.b, r.id)
        assert r.id - low[r.b] <= max(0, r.id / 16) and (r.b % 32) << (r.b // 32) == low[r.b]


def test_quality_on_held_out_labels(spark, documents):
    docs, labels = documents
    remainder = fold_remainder(F.col("doc_id"), 5)
    got = quality_crf.classify(docs, labels, remainder != 0).select("doc_id", "score", "predicted", (remainder == 0).alias("out"))
    joined = got.where("out").join(labels, "doc_id").toPandas()
    assert (joined.predicted == joined.quality).mean() > 0.9
    assert joined.score.between(0, 1).all() and got.count() == docs.count()


def test_toxicity_on_held_out_labels(spark, documents):
    docs, labels = documents
    remainder = fold_remainder(F.col("doc_id"), 3)
    got = toxicity.classify(docs, labels, remainder != 1)
    joined = got.join(labels, "doc_id").where(remainder == 1).toPandas()
    toxic, plain = joined.score[joined.toxic == 1], joined.score[joined.toxic == 0]
    ranks = np.mean([[a > b for b in plain] for a in toxic])
    assert ranks > 0.85 and joined.score.between(0, 1).all() and got.count() == docs.count()


def test_classifier_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, " \n ", 1.0), (3, "some words here", 1.0), (None, "x", 1.0), (4, "w " * 20000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (4, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (quality_crf, toxicity):
        for known in (labels, labels.limit(0)):
            rows = module.classify(df, known, F.lit(True)).collect()
            assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert module.classify(df.limit(0), labels, F.lit(True)).count() == 0
    blank = [r.score for r in quality_crf.classify(df, labels, F.lit(True)).collect() if not (r.text or "").strip()]
    assert blank == [0, 0, 0]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    steps = rng.normal(size=(2, 2))
    chain = np.array([0, 0, 0, 0, 1, 2, 2])
    good = rng.normal(size=7)
    p, expected = quality_crf.forward_backward(good, chain, steps)
    want, pairs = np.zeros(7), np.zeros((2, 2))
    for c in range(3):
        at = np.flatnonzero(chain == c)
        total, share, seen = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for states in np.ndindex(*[2] * len(at)):
            w = np.exp(sum(good[i] * s for i, s in zip(at, states, strict=True)) + sum(steps[a, b] for a, b in zip(states, states[1:], strict=False)))
            total += w
            share += w * np.array(states)
            for a, b in zip(states, states[1:], strict=False):
                seen[a, b] += w
        want[at] = share / total
        pairs += seen / total
    assert np.allclose(p, want) and np.allclose(expected, pairs)


def odd_texts(rng):
    words = ["river", "Stone", "clouds", "###", "a|b", "12", "WHY?!", "é", "over", "field"]
    texts = ["", "  \n \n", "one", "same line here\nsame line here\n\nsame line here"]
    for n in (1, 3, 8, 30):
        texts += ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) + rng.choice(["", " ", "\t"]) for _ in range(n)) for _ in range(6)]
    return texts


def quality_by_definition(text, model):
    """The score from lines, words and chains one by one."""
    lines = [x for x in text.split("\n") if x.split()]
    if not lines:
        return 0.0
    before, earlier_lines, earlier_words, own = None, set(), set(), []
    for line in lines:
        words = line.split()
        twice = repeats = 0
        for w in words:
            twice += w == before
            repeats += w in earlier_words
            earlier_words.add(w)
            before = w
        data = line.encode()
        shares = [sum(b in kind for b in data) / len(data) for kind in quality_crf._CLASSES.values()]
        n = len(words)
        own.append([*shares, twice / n, repeats / n * min(n, 50) / 50, float(line in earlier_lines), np.log1p(n)])
        earlier_lines.add(line)
    beside = [[x[k] for k in (0, 1, 3, 5, 7)] for x in own]
    nothing = [0.0] * 5
    odds = []
    for i, x in enumerate(own):
        x = x + (beside[i - 1] if i else nothing) + (beside[i + 1] if i + 1 < len(own) else nothing)
        odds.append(float(((np.array(x) - model.mean) / model.scale) @ model.weights[:-1] + model.weights[-1]))

    def joint(i, state):  # log weight of all ways in which line i has this state, by sums over every state before and behind
        ahead = {s: odds[0] * s for s in (0, 1)}
        for j in range(1, len(odds)):
            if j - 1 == i:
                ahead = {state: ahead[state]}
            ahead = {t: odds[j] * t + np.logaddexp.reduce([a + model.steps[s, t] for s, a in ahead.items()]) for t in (0, 1)}
        return ahead[state] if i == len(odds) - 1 else np.logaddexp.reduce(list(ahead.values()))

    p = [1 / (1 + np.exp(joint(i, 0) - joint(i, 1))) for i in range(len(odds))]
    lengths = [len(x.encode()) for x in lines]
    q = np.clip(np.dot(p, lengths) / sum(lengths), 1e-4, 1 - 1e-4)
    return 1 / (1 + np.exp(-(np.log(q / (1 - q)) * model.curve[0] + model.curve[1])))


def test_quality_scores_equal_their_definition(documents):
    docs, labels = documents
    rows = [(r.text, r.quality) for r in docs.join(labels, "doc_id").where("text IS NOT NULL AND quality IS NOT NULL").orderBy("doc_id").limit(120).collect()]
    model = quality_crf.train(rows, rounds=40)
    texts = odd_texts(random.Random(11)) + [t[:4000] for t, _ in rows[:12]]
    got = quality_crf.score_buffers(model, *quality_crf.as_buffers(texts))
    assert np.allclose(got, [quality_by_definition(t, model) for t in texts], atol=1e-8)
    assert 0.05 < np.std(got)


def toxicity_by_definition(text, model):
    """The score from every window's two compressed lengths."""
    words, found = text.split(), []
    for at in range(0, len(words), toxicity.WINDOW_WORDS):
        window = (" " + " ".join(words[at : at + toxicity.WINDOW_WORDS]) + " ").encode()
        sizes = []
        for content in (model.ordinary, model.toxic):
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(len(made.compress(window)))
        found.append(sizes[0] - sizes[1])
    x = [0.0] * toxicity.FEATURES
    if found:
        over = [sum(f >= least for f in found) for least in toxicity.CLEAR]
        best = sorted(found)[-3:]
        x = [*(n / len(found) for n in over), *(np.log1p(n) for n in over), sum(found) / len(found), sum(best) / len(best)]
    z = sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale, strict=False)) + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_toxicity_scores_equal_their_definition(documents):
    docs, labels = documents
    known = docs.join(labels, "doc_id").where("text IS NOT NULL AND toxic IS NOT NULL").orderBy(F.desc("toxic"), "doc_id").limit(300)
    rows = [(r.text[:3000], r.toxic) for r in known.collect()]
    model = toxicity.train(rows)
    texts = odd_texts(random.Random(12)) + [t for t, _ in rows[:20] + rows[-20:]]
    got = toxicity.score_texts(texts, model)
    assert np.allclose(got, [toxicity_by_definition(t, model) for t in texts], atol=1e-9)
    assert got[-40:-20].mean() > got[-20:].mean() + 0.2


@pytest.mark.parametrize("module", [quality_crf, toxicity])
def test_copies_and_very_long_texts_get_the_score_of_their_text(spark, documents, module):
    docs, labels = documents
    some = [(r.doc_id, r.text) for r in docs.where("text IS NOT NULL").orderBy("doc_id").limit(150).collect()]
    long = "\n".join(t for _, t in some) * 4
    rows = some + [(10**9 + i, some[i % 3][1]) for i in range(30)] + [(2 * 10**9 + i, long) for i in range(2)]
    got = {r.doc_id: r.score for r in module.classify(spark.createDataFrame(rows, "doc_id long, text string"), labels, F.lit(True)).collect()}
    assert len(got) == len(rows) and len(long) > 500_000
    assert all(got[10**9 + i] == got[some[i % 3][0]] for i in range(30)) and got[2 * 10**9] == got[2 * 10**9 + 1]


def test_toxic_words_make_the_difference():
    rng = random.Random(2)
    plain = [" ".join(rng.choice(["river", "stone", "cloud", "green", "walks", "over", "field"]) + rng.choice("aeiou") for _ in range(80)) for _ in range(200)]
    rows = [(t, 0) for t in plain[:100]] + [(t.replace(" clouda ", " vilest scoundrel "), 1) for t in plain[100:] if " clouda " in t]
    model = toxicity.train(rows)
    a, b = toxicity.score_texts([plain[0], plain[0].replace("stonea", "scoundrel").replace("rivera", "vilest")], model)
    assert b > a


def test_short_toxic_words_count():
    rng = random.Random(3)
    plain = [" ".join(rng.choice(["river", "stone", "cloud", "green", "walks", "over", "field"]) + rng.choice("aeiou") for _ in range(80)) for _ in range(200)]
    rows = [(t, 0) for t in plain[:100]] + [(t.replace(" clouda ", " oaf "), 1) for t in plain[100:] if " clouda " in t]
    a, b = toxicity.score_texts([plain[0], plain[0].replace("stonea", "oaf")], toxicity.train(rows))
    assert b > a + 0.1


def test_ordinary_windows_come_from_whole_texts():
    texts = [f"{'start ' * 18}{f'middle{n} ' * 300}last{n}" for n in range(50)]
    made, _ = toxicity.dictionaries(["some toxic text"], texts)
    assert all(f" middle{n} ".encode() in made for n in range(50)) and len(made) <= toxicity.DICTIONARY_BYTES + 100


def prose(rng, n, capital, length):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(max(1, round(rng.gauss(length, 1))))) if rng.random() > capital else "UPPER" for _ in range(n))


def verdicts(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return {r.doc_id: r.kept for r in quality_rules.apply_rules(df).collect()}, df


def test_sources_have_limits_of_their_own(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 80, 0.3 if i % 2 else 0.01, 9 if i % 2 else 4), "en", "loud" if i % 2 else "calm") for i in range(400)]
    kept, df = verdicts(spark, rows)
    assert sum(kept.values()) > 0.97 * len(rows)
    bounds = {r.source: r for r in quality_rules.limits(quality_rules.sketches(quality_rules.count_features(df))).collect()}
    assert bounds["loud"].q75_capitals > 5 * bounds["calm"].q75_capitals and bounds["loud"].q75_chars_per_word > 1.5 * bounds["calm"].q75_chars_per_word
    moved = [(i, t, "en", "calm" if s == "loud" else "loud") for i, t, _, s in rows[:4]]
    assert not any(verdicts(spark, rows[4:] + moved)[0][i] for i in (1, 3))  # the loud texts among the calm ones


def with_symbols(rng, n, share):
    return " ".join(w + "#" * (rng.random() < share) for w in prose(rng, n, 0.02, 5).split())


def test_a_count_of_symbols_is_judged_by_its_source(spark):
    rng = random.Random(8)
    rows = [(i, with_symbols(rng, 80, rng.uniform(0.1, 0.4)), "en", "code") for i in range(200)]
    rows += [(1000 + i, with_symbols(rng, 80, 0.0), "en", "prose") for i in range(1000)]
    same = prose(rng, 60, 0.02, 5) + " " + " ".join(f"{w}#" for w in prose(rng, 20, 0.0, 5).split())
    rows += [(2000, same, "en", "code"), (2001, same, "en", "prose"), (2002, prose(rng, 80, 0.02, 5) + " #", "en", "prose")]
    kept, df = verdicts(spark, rows)
    assert kept[2000] and not kept[2001] and kept[2002]
    assert sum(kept[i] for i, *_ in rows[:-3]) > 0.97 * (len(rows) - 3)
    pooled, _ = verdicts(spark, [(i, t, lang, "all") for i, t, lang, _ in rows])  # one limit for all groups
    assert sum(pooled[i] != kept[i] for i in kept) > 50


def test_a_longer_text_may_have_more_symbols(spark):
    rng = random.Random(9)
    rows = [(i, with_symbols(rng, rng.randint(40, 400), 0.0), "en", "s") for i in range(300)]
    rows += [(1000 + n, prose(rng, n, 0.02, 5) + " ###### ######", "en", "s") for n in (20, 600)]
    kept, _ = verdicts(spark, rows)
    assert not kept[1020] and kept[1600]


def test_a_third_of_junk_is_rejected_all_the_same(spark):
    rng = random.Random(6)
    clean = [(i, prose(rng, 60, 0.02, 5), "en", "s") for i in range(200)]
    junk = [(1000 + i, prose(rng, 60, 0.02, 5).replace(" ", "### "), "en", "s") for i in range(50)]
    junk += [(2000 + i, prose(rng, 60, 0.02, 5).upper(), "en", "s") for i in range(40)]
    kept, _ = verdicts(spark, clean + junk)
    assert not any(kept[i] for i, *_ in junk) and sum(kept[i] for i, *_ in clean) > 0.97 * len(clean)


def test_small_groups_follow_their_language(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, 60, 0.02, 5), "en", "large") for i in range(300)] + [(1000 + i, prose(rng, 60, 0.02, 5).upper(), "en", "small") for i in range(2)]
    kept, _ = verdicts(spark, rows)
    assert not kept[1000] and not kept[1001]
