"""Divergence of sources against sums over all terms in Python's integers."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tidemark.llm import source_divergence


def brute(rows, least_docs=3, most_terms=200):
    texts = defaultdict(list)
    for lang, source, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        texts[lang or "", source or ""].append(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower))
    out = set()
    for lang in {k[0] for k in texts}:
        held = Counter(t for (own, _), docs in texts.items() if own == lang for words in docs for t in set(words))
        kept = sorted(t for t, n in held.items() if n >= least_docs)
        counts = {s: Counter(w for words in docs for w in words if held[w] >= least_docs) for (own, s), docs in texts.items() if own == lang}
        everything = sum(counts.values(), Counter())

        def weights(c, kept=kept):
            total = sum(c.values()) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p = {s: weights(c) for s, c in counts.items()}
        q = weights(everything)
        for s in counts:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in counts if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in ("pair", pairs), ("term", terms):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out |= {(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= most_terms}
    return out


def table(spark, rows):
    return spark.createDataFrame([(k, *r, "x") for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string")


ODD = [
    ("en", "a", "Same words, same Words"), ("en", "a", "Same words, same Words"), ("en", None, "same words"), (None, "a", "null lang"), (None, None, None), ("en", "b", ""),
    ("de", "only", "ein Wort ein Wort"), ("en", "c", "1234 !!! \x00\x7f @[`{"), ("fr", "x", "été ÉTÉ été"), ("fr", "y", "été x ß"), ("fr", "x", "ÉTÉ été"), ("fr", "y", "été"),
]


def random_rows(seed, rows=150, sources=6):
    rng = random.Random(seed)
    words = [w * k for w in ("ab", "c", "é", "Xy", "日") for k in range(1, 15)]
    return [
        (rng.choice(["en", "de"]), f"s{min(int(rng.expovariate(0.5)), sources)}", " ".join(rng.choice(words[: rng.randint(3, len(words))]) for _ in range(rng.randint(0, 60))))
        for _ in range(rows)
    ]


@pytest.mark.parametrize(("rows", "block"), [(ODD, 1 << 20), (ODD, 2), (random_rows(1), 1 << 20), (random_rows(2), 40)])
def test_divergence_is_that_of_sums_over_all_terms(spark, rows, block, monkeypatch):
    df = table(spark, rows).repartition(3)
    assert set(map(tuple, source_divergence.audit(df, block_terms=block).collect())) == brute(rows)
    if block == 40:
        assert set(map(tuple, source_divergence.audit(df, least_docs=1, most_terms=7).collect())) == brute(rows, 1, 7)


def test_small_passes_and_batches(spark, monkeypatch):
    rows = random_rows(3, sources=12)
    monkeypatch.setattr(source_divergence, "PASS_PAIRS", 5)
    kept = spark.createDataFrame(
        [(lang, f"t{t:03}", f"s{s}", 10**8 + 7**s * t, 10 + s) for lang in ("en", "de") for t in range(60) for s in range(t % 9)], "lang string, term string, source string, p long, p0 long"
    )
    want = Counter()
    for r in kept.collect():
        for o in kept.where(f"lang = '{r.lang}' AND term = '{r.term}'").collect() if r.term < "t006" else ():
            if o.source != r.source:
                f = [(a - b) * (a - b) // b for a, b in ((r.p, o.p), (r.p, o.p0), (r.p0, o.p), (r.p0, o.p0))]
                want[r.lang, r.source, o.source] += f[0] - f[1] - f[2] + f[3]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = source_divergence.corrections(kept.where("term < 't006'")).groupBy("lang", "source", "item").sum("value").collect()
        assert {tuple(r)[:3]: r[3] for r in got} == dict(want)
        assert set(map(tuple, source_divergence.audit(table(spark, rows)).collect())) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_weights_of_very_large_counts_are_exact(spark):
    n, total = 3_000_000_000_123, 9_000_000_000_777
    df = spark.createDataFrame([(n, total, 10)], "n long, total long, terms long").select(source_divergence.weight(*map(__import__("pyspark").sql.functions.col, ("n", "total", "terms"))).alias("p"))
    assert df.first().p == 1 + 10**9 * (n + 1) // (total + 10)


def test_empty_tables_and_one_very_long_text(spark):
    assert source_divergence.audit(table(spark, ODD).limit(0)).count() == 0
    rows = [("en", "a", "many words here " * 100_000), ("en", "b", "many words"), ("en", "b", "words here many"), ("en", "a", "x" * 500_000)]
    assert set(map(tuple, source_divergence.audit(table(spark, rows)).collect())) == brute(rows)


def test_sql_gives_the_same(spark, tmp_path):
    rows = random_rows(4) + ODD
    table(spark, rows).coalesce(1).write.parquet(str(tmp_path / "d"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
        got = db.execute(source_divergence.ORACLE_SQL).fetchall()
    assert set(got) == brute(rows) and len(got) == len(brute(rows))
