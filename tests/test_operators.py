from datetime import datetime
from decimal import Decimal

import pytest

from tests.helpers import tx
from pyspark.sql import functions as F
from tidemark.functions import answers as read
from tidemark.operators import cases, network, screening, trade, validate
from tidemark.sources.cases_file import flatten_cases, read_cases, write_assessments
from tidemark.streaming.streams import stream_velocity_exact
from tidemark.operators.velocity import velocity_24h


def test_validate_splits_and_keeps_all(spark):
    df = tx(spark, {}, {"amount": 0}, {"customer_name": ""}, {"currency": "EURO"}, {"transaction_type": "X"}, {"account_age_days": -1}, {"amount": None})
    ok, bad = validate.validate(df)
    assert ok.count() == 1 and bad.count() == 6
    assert {r.tx_id: r.reasons for r in bad.collect()}[3] == ["currency"]


def test_dedupe_keeps_newest_then_greatest(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", 1, t), ("a", 2, t), ("b", 3, t), (None, 4, t), (None, 5, t)], "external_id string, tx_id long, created_at timestamp")
    assert sorted(r.tx_id for r in validate.dedupe_transactions(df).collect()) == [2, 3, 4, 5]


@pytest.mark.parametrize(
    ("text", "score", "confidence"),
    [("Risk score: 85, confidence: 0.7", 85, 0.7), ("140/100 90 confidence", 100, 0.9), ("confidence: ... 0.4 confidence", 0, 0.4), ("nothing", 0, 0.5)],
)
def test_answers_are_read(spark, text, score, confidence):
    df = spark.createDataFrame([(text,)], "text string")
    r = df.select(read.score(F.col("text")).alias("s"), read.confidence(F.col("text")).alias("c")).first()
    assert (r.s, r.c) == (score, confidence)


def test_codes_and_flags(spark):
    df = spark.createDataFrame([("HIGH_RISK WHERE HIGH_RISK of Pep, NOT A PEP: MATCH",), ("PEP NO_MATCH",), ("is NOT a PEP",)], "text string")
    rows = df.select(read.risk_codes(F.col("text")).alias("c"), read.pep_flag(F.col("text")).alias("p"), read.sanctions_flag(F.col("text")).alias("s")).collect()
    assert rows[0].c == ["HIGH_RISK", "HIGH_RISK", "MATCH"] and [r.p for r in rows] == [True, True, False] and [r.s for r in rows] == [True, False, False]


def flow(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "tx_id long, src long, dst long, ts timestamp, amount decimal(18,2)")


def test_cycles_are_found_once(spark):
    t = datetime(2024, 1, 1)
    edges = network.flow_edges(flow(spark, [(3, 1, t, Decimal(1)), (1, 2, t, Decimal(1)), (2, 3, t, Decimal(1)), (2, 1, t, Decimal(1)), (4, 4, t, Decimal(1))]))
    found = {(r.a, r.b, r.c) for r in network.circular_flows(edges).collect()}
    assert found == {(1, 2, None), (1, 2, 3)}


def test_clusters(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (1, 2), (5, 5)], "src long, dst long")
    assert {r.account: r.cluster for r in network.entity_clusters(edges).collect()} == {9: 6, 8: 6, 7: 6, 6: 6, 1: 1, 2: 1, 5: 5}


def test_layering_bounds(spark):
    t = [datetime(2024, 1, 1), datetime(2024, 1, 3), datetime(2024, 1, 3, 0, 0, 1)]
    df = flow(spark, [(1, 2, t[0], Decimal(100)), (2, 3, t[1], Decimal(110)), (2, 3, t[2], Decimal(100)), (2, 3, t[1], Decimal("110.01"))])
    assert [(r.in_id, r.out_id) for r in network.layering_chains(df).collect()] == [(0, 1)]


def test_fuzzy_finds_alias_and_best(spark):
    parties = spark.createDataFrame([("Jon Smyth",), ("ACME TRADING",), ("zzz",)], "party string")
    entries = spark.createDataFrame([(1, "John Smith", ["Jon Smith"]), (2, "Acme Trading", [])], "entry_id long, name string, aliases array<string>")
    got = {r.party: (r.entry_id, r.how, r.similarity) for r in screening.fuzzy_screen(parties, entries).collect()}
    assert got == {"jon smyth": (1, "alias", 0.888889), "acme trading": (2, "name", 1.0)}


def test_rules_from_a_table(spark):
    rules = spark.createDataFrame([("R", '{"column": "amount", "op": ">", "value": 50}', 7, "HIGH", True, "THRESHOLD")], "rule_id string, parameters string, base_risk_score int, severity string, is_enabled boolean, rule_type string")
    r = trade.configured_rules(tx(spark, {}), rules).first()
    assert (r.rule_hits, r.rule_score, r.rule_severity) == (["R"], 7, "HIGH")
    assert trade.configured_rules(tx(spark, {}), rules.where("false")).first().rule_hits == []


def test_case_fold(spark):
    at = [datetime(2024, 1, d) for d in range(1, 9)]
    requests = spark.createDataFrame([(1, "A", "LOW", None), (2, "B", "LOW", "x")], "request_id long, title string, priority string, assigned_to string")
    made, comments = cases.create_cases(requests, "2024-01-01 00:00:00")
    rows = [(1, 1, at[1], "assign", None, None, "ann", None), (1, 2, at[2], "escalate", None, None, None, None), (1, 3, at[3], "file_sar", None, None, None, "S1"),
            (1, 4, at[4], "close", "OPEN", None, None, None), (1, 5, at[5], "comment", None, None, None, None)]
    events = spark.createDataFrame(rows, "case_id long, seq int, ts timestamp, kind string, status string, priority string, assigned_to string, sar_reference string")
    one, two = cases.case_state(made, events).orderBy("case_id").collect()
    assert (one.status, one.priority, one.assigned_to, one.sar_filed, one.closed_at, one.updated_at) == ("SAR_FILED", "HIGH", "ann", True, None, at[5])
    assert (two.status, two.assigned_to) == ("OPEN", "x") and comments.count() == 2
    assert cases.split_events(events)[1].count() == 1


def test_case_file_round_trip(spark, tmp_path):
    (tmp_path / "cases.json").write_text('[{"scenario": "s", "transaction": {"amount": 9500.5, "timestamp": "2024-01-10T12:00:00Z", "transaction_type": "CASH"},'
                                         ' "customer": {"name": "N", "account_age_days": 3, "transaction_history": [{"amount": 1, "timestamp": "2024-01-10T10:00:00Z"}]}}]')  # fmt: skip
    transactions, customers, history = flatten_cases(read_cases(spark, str(tmp_path / "cases.json")))
    r = transactions.first()
    assert (r.amount, r.ts, r.customer_name) == (Decimal("9500.5000"), datetime(2024, 1, 10, 12), "N")
    assert customers.count() == 1 and history.first().ts == datetime(2024, 1, 10, 10)
    write_assessments(transactions.withColumn("risk_level", F.lit("LOW")).select("tx_id", "ts", "risk_level"), str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_exact_stream_equals_batch(spark, tmp_path):
    rows = tx(spark, *({"customer_id": i % 3, "ts": datetime(2024, 1, 1 + i // 9, (i * 5) % 24), "amount": i + 1} for i in range(60)))
    rows = rows.select("tx_id", "customer_id", "ts", F.col("amount").cast("decimal(18,2)").alias("amount")).orderBy("ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream_velocity_exact(stream).writeStream.format("memory").queryName("exact").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = {(r.tx_id, r.transactions_in_24h, r.daily_volume) for r in spark.table("exact").collect()}
    want = {(r.tx_id, r.transactions_in_24h, r.daily_volume) for r in velocity_24h(rows).collect()}
    assert {g[:2] for g in got} == {w[:2] for w in want} and {(g[0], float(g[2])) for g in got} == {(w[0], float(w[2])) for w in want}


def test_exact_stream_deals_a_customer_by_day(spark, tmp_path):
    rows = tx(spark, *({"customer_id": 1, "ts": datetime(2024, 1, 1 + i // 6, (i * 5) % 24), "amount": i + 1} for i in range(60)))
    rows = rows.select("tx_id", "customer_id", "ts", F.col("amount").cast("decimal(18,2)").alias("amount")).orderBy("ts")
    for part, kept in enumerate(("ts < '2024-01-06'", "ts >= '2024-01-06'")):  # two batches: state is carried over
        rows.where(kept).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={part}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))
    q = stream_velocity_exact(stream).writeStream.format("memory").queryName("dealt").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = sorted((r.tx_id, r.transactions_in_24h, r.daily_volume) for r in spark.table("dealt").collect())
    want = sorted((r.tx_id, r.transactions_in_24h, r.daily_volume) for r in velocity_24h(rows).collect())
    assert len(got) == 60 and [(a, b, float(c)) for a, b, c in got] == [(a, b, float(c)) for a, b, c in want]
    states = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress)
    assert states > 1  # not one group a customer


def test_sounds_find_what_pieces_miss(spark):
    parties = spark.createDataFrame([("Robert",), ("Zoe",)], "party string")
    entries = spark.createDataFrame([(1, "Rupert", None), (2, "Anna", None)], "entry_id long, name string, aliases array<string>")
    assert screening.fuzzy_screen(parties, entries).count() == 0
    got = screening.fuzzy_screen(parties, entries, use_soundex=True).collect()
    assert [(r.party, r.entry_id, r.similarity) for r in got] == [("robert", 1, 0.666667)]


def test_pages_by_key_are_those_by_offset(spark):
    t = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, "OPEN", "HIGH", "a", datetime(2024, 1, 1 + i % 3)) for i in range(30)], "case_id long, status string, priority string, assigned_to string, created_at timestamp")
    first = cases.list_cases(rows, limit=7).collect()
    after = cases.list_cases(rows, limit=7, before=(first[-1].created_at, first[-1].case_id)).collect()
    assert after == cases.list_cases(rows, limit=7, offset=7).collect() and first[0].created_at > t


def test_answers_read_keeps_percentages_over_100_as_its_sql(spark, tmp_path):
    from tidemark.plans import case_queries

    rows = [(c, 1500 + c % 3, "user", "x ") for c in range(95, 130)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.turn): r.confidence for r in case_queries.answers_read(spark, str(tmp_path)).collect()}
    assert len(got) == 35 and got[121, 1501] == Decimal("0.8500")
    duck = pytest.importorskip("duckdb").connect()
    duck.sql(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = {(r[0], r[1]): r[5] for r in duck.sql(case_queries.ORACLE_SQL["answers_read"]).fetchall()}
    assert got == want and max(got.values()) > 1
