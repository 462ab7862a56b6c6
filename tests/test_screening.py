"""Screening against lists of any length."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import screening


def brute(names, entries):
    out = {}
    for name in {n.lower() for n in names if n is not None}:
        hits = [(p, e.lower()) for p, e in entries if e is not None and (e.lower() in name or name in e.lower())]
        if hits:
            out[name] = min(hits)
    return out


def frames(spark, names, entries):
    return spark.createDataFrame([(n,) for n in names], "party string"), spark.createDataFrame(entries, "position long, entry string")


def found(df):
    return {r.name: (r.m.position, r.m.entry) for r in df.collect()}


@pytest.mark.parametrize("empty_entry", [False, True])
@pytest.mark.parametrize("chars", [30, 1 << 20])
def test_long_lists_give_what_short_ones_do(spark, chars, empty_entry):
    rng = random.Random(chars)
    letters = "abcé日 "
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    entries = [(rng.randint(0, 40), word(6).title()) for _ in range(80)] + [(7, None), (None, "nothing"), (3, "same"), (2, "same")]
    entries = [e for e in entries if e[0] is not None] + ([(39, "")] if empty_entry else [])
    names = [word(9) for _ in range(150)] + ["", None, "SAME", "zzz", "zz same zz", "zzz"]
    parties, watchlist = frames(spark, names, entries)
    long = found(screening.first_entries(parties, watchlist, small_list=0, block_chars=chars))
    assert long == found(screening.first_entries(parties, watchlist, small_list=10**6)) == brute(names, entries)
    assert screening.first_entries(parties.limit(0), watchlist, small_list=0).count() == 0


def test_hundred_thousand_entries(spark):
    entries = spark.range(100_000).select(((F.col("id") * 7919) % 100_003).alias("position"), F.concat(F.lit("Holding "), F.col("id").cast("string"), F.lit(" of "), (F.col("id") % 977).cast("string")).alias("entry"))
    names = spark.range(0, 100_000, 997).select(F.concat(F.lit("The HOLDING "), F.col("id").cast("string"), F.lit(" of "), (F.col("id") % 977).cast("string"), F.lit(" Ltd")).alias("party"))
    names = names.unionByName(spark.createDataFrame([("holding 5",), ("of 976",), ("nobody",)], "party string"))
    got = found(screening.first_entries(names, entries))
    listed = [((i * 7919) % 100_003, f"holding {i} of {i % 977}") for i in range(100_000)]
    want = brute([r.party for r in names.collect()][-3:], listed)
    # A listed name with more digits holds a shorter one: "holding 12 of 1" is part of "holding 12 of 12".
    for i in range(0, 100_000, 997):
        name = f"the holding {i} of {i % 977} ltd"
        want[name] = min(e for e in listed if e[1] in name)
    assert got == want


def test_names_and_aliases_share_a_position(spark):
    df = spark.createDataFrame([(4, "Main Name", ["Other", "Third"]), (2, "Only", None)], "entry_id long, name string, aliases array<string>")
    rows = screening.list_entries(df).collect()
    assert sorted(map(tuple, rows)) == [(2, "Only"), (4, "Main Name"), (4, "Other"), (4, "Third")]


def test_hits_of_a_long_list_reach_the_transactions(spark, monkeypatch):
    monkeypatch.setattr(screening.first_entries, "__defaults__", (0, 64))
    tx = spark.createDataFrame([(1, ["Acme Ltd", "acme", None]), (2, []), (3, None), (4, ["x"])], "tx_id long, parties array<string>").withColumn("origin_country", F.lit("US"))
    _, watchlist = frames(spark, [], [(0, "Acme"), (1, "Acme Ltd")])
    rows = screening.sanctions_screen(tx, watchlist).collect()
    assert sorted((r.tx_id, r.nth, r.entry, r.match_type) for r in rows) == [(1, 0, "acme", "PARTIAL"), (1, 1, "acme", "EXACT")]
    hits = screening.hit_lists(tx, watchlist).collect()
    assert [(r.tx_id, [h.match_type for h in r.sanction_hits]) for r in hits] == [(1, ["PARTIAL", "EXACT"])]


def test_a_short_list_gives_the_hits_of_a_long_one_without_a_shuffle(spark, monkeypatch):
    rows = [(1, ["Acme Ltd", "acme", None, "Iran Shipping"], "IR"), (2, [], "US"), (3, None, "IR"), (4, ["x", "", "ACME"], None), (5, ["harbor"], "US")]
    tx = spark.createDataFrame(rows, "tx_id long, parties array<string>, origin_country string")
    _, watchlist = frames(spark, [], [(3, "Acme"), (1, "Acme Ltd"), (1, "acme l"), (0, None), (2, "IRAN")])
    short = screening.with_hits(tx, watchlist)
    assert "Exchange" not in short._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(screening, "SMALL_LIST", 0)
    long = screening.with_hits(tx, watchlist)
    assert "Exchange" in long._jdf.queryExecution().executedPlan().toString()
    assert short.schema["sanction_hits"].dataType.simpleString() == long.schema["sanction_hits"].dataType.simpleString()
    as_rows = lambda df: sorted((r.tx_id, [tuple(h) for h in r.sanction_hits]) for r in df.collect())
    assert as_rows(short) == as_rows(long)
    assert dict(as_rows(short))[1] == [("Acme Ltd", "PARTIAL", 0.75), ("acme", "PARTIAL", 0.75), ("Iran Shipping", "PARTIAL", 0.75), ("Iran Shipping", "JURISDICTION", 0.8)]


def test_a_long_list_is_met_by_as_many_pieces_as_there_are_texts(spark):
    """Names were copied to every block of the list and entries to every shard of names."""
    def pieces(n):
        names = spark.range(n).select("id", F.concat(F.lit("the holding "), (F.col("id") + 10_000).cast("string"), F.lit(" ltd")).alias("name"))
        names = names.unionByName(spark.range(n).select((F.col("id") + n).alias("id"), F.concat(F.lit("nobody "), F.col("id").cast("string")).alias("name")))
        entries = spark.range(n).select(F.col("id").alias("rank"), F.concat(F.lit("holding "), (F.col("id") + 10_000).cast("string")).alias("entry"))
        return screening.pieces_like(names, "name", "id", entries, "entry").count(), screening.pieces_like(entries, "entry", "rank", names, "name").count()

    assert pieces(300) == (300, 0) and pieces(600) == (600, 0)
    parties, watchlist = frames(spark, ["Acme Ltd"] * 9, [(k, f"Acme {k}") for k in range(9)])
    assert "CoGroups" not in screening.first_entries(parties, watchlist, small_list=0, block_chars=8)._jdf.queryExecution().toString()


def test_names_longer_than_a_stretch(spark):
    long = "x" * 250 + "Acme Holding" + "y" * 600
    parties, watchlist = frames(spark, [long, "x" * 300 + "y", "z" + long, ""], [(3, "acme holding"), (1, "y" * 590), (2, long + "z"), (0, "Z" + long + "z")])
    got = found(screening.first_entries(parties, watchlist, small_list=0, block_chars=100))
    assert got == found(screening.first_entries(parties, watchlist, small_list=10**6)) and len(got) == 3
