"""Streams over many batches, restarts and a sink that may see a batch twice."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators.velocity import velocity_24h
from tidemark.streaming import delivery
from tidemark.streaming.streams import stream_velocity, stream_velocity_exact

SCHEMA = "tx_id long, customer_id long, ts timestamp, amount decimal(18,2)"


def ledger(seed, n, hours=120):
    """Rows in time's order, no two at the same instant."""
    rng = random.Random(seed)
    at = sorted(rng.sample(range(hours * 60), n))
    return [(i, rng.randrange(3), datetime(2024, 1, 1) + timedelta(minutes=m), None if rng.random() < 0.1 else Decimal(rng.randrange(1, 10**6)) / 100) for i, m in enumerate(at)]


def add_files(spark, folder, rows, parts, first=0):
    for k in range(parts):
        part = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/p={first + k}")


def run(spark, folder, build, out, state):
    """Run to the end of the files there are, from where the state is."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/p=*")
    writer = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True)
    query = writer.start()
    query.awaitTermination()
    return query


def windows(df):
    return {r.tx_id: (r.transactions_in_24h, r.daily_volume) for r in df.collect()}


def test_exact_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = ledger(1, 150)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    add_files(spark, source, rows[:90], 3)
    run(spark, source, stream_velocity_exact, out, state)
    first = windows(spark.read.parquet(out))
    assert len(first) == 90
    add_files(spark, source, rows[90:], 2, first=3)
    run(spark, source, stream_velocity_exact, out, state)
    assert windows(spark.read.parquet(out)) == windows(velocity_24h(spark.createDataFrame(rows, SCHEMA)))


def test_exact_stream_starts_from_a_table(spark, tmp_path):
    rows = ledger(2, 120)
    history = spark.createDataFrame([r[1:] for r in rows[:60]] + [(1, None, Decimal(5))], "customer_id long, ts timestamp, amount decimal(18,2)")
    source = str(tmp_path / "in")
    add_files(spark, source, rows[60:], 2)
    run(spark, source, lambda s: stream_velocity_exact(s, history=history), str(tmp_path / "out"), str(tmp_path / "state"))
    whole = windows(velocity_24h(spark.createDataFrame(rows, SCHEMA)))
    assert windows(spark.read.parquet(str(tmp_path / "out"))) == {i: whole[i] for i in range(60, 120)}


def test_sliding_windows_are_made_of_panes(spark, tmp_path):
    rows = ledger(3, 400)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    add_files(spark, source, rows, 6)
    query = run(spark, source, stream_velocity, out, str(tmp_path / "state"))
    got = {(r.customer_id, r.window_start): (r.transactions, r.volume) for r in spark.read.parquet(out).collect()}
    want, closed = {}, rows[-1][2] - timedelta(hours=1)
    for _, c, ts, amount in rows:
        hour = ts.replace(minute=0)
        for k in range(24):
            start = hour - timedelta(hours=k)
            if start + timedelta(hours=24) <= closed:
                n, v = want.get((c, start), (0, None))
                want[c, start] = (n + 1, v if amount is None else (v or 0) + amount)
    assert got == want
    # The first aggregation has a row of state for each open customer-hour, not for each row and window.
    most = max(min(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"])
    hours = len({(c, ts.replace(minute=0)) for _, c, ts, _ in rows})
    assert most <= hours < len(rows)


ALERTS = "alert_id string, tx_id long"


def alerts(spark, *ids):
    return spark.createDataFrame([(i, k) for k, i in enumerate(ids)], ALERTS)


def test_a_batch_that_was_killed_and_repeated_gives_each_alert_once(spark, tmp_path):
    folder = str(tmp_path / "sink")
    schema = alerts(spark, "a").schema
    deliver = delivery.deliver_to(folder)
    assert delivery.delivered(spark, folder, schema).count() == 0 and delivery.commits(spark, folder).count() == 0
    deliver(alerts(spark, "a", "b", "b", None, None), 0)
    # Killed between the rows and the commit: the rows are there, but no one reads them.
    alerts(spark, "c").write.parquet(f"{folder}/alerts/batch=1")
    assert sorted(str(r.alert_id) for r in delivery.delivered(spark, folder, schema).collect()) == ["None", "None", "a", "b"]
    deliver(alerts(spark, "c", "d", "a"), 1)
    deliver(alerts(spark, "c", "d", "a"), 1)
    deliver(alerts(spark), 2)
    deliver(alerts(spark, "d", "e"), 3)
    rows = delivery.delivered(spark, folder, schema).collect()
    assert sorted((str(r.alert_id), r.batch) for r in rows) == [("None", 0), ("None", 0), ("a", 0), ("b", 0), ("c", 1), ("d", 1), ("e", 3)]
    assert {r.batch: r.alerts for r in delivery.commits(spark, folder).collect()} == {0: 4, 1: 2, 2: 0, 3: 1}


def test_a_stream_that_fails_in_the_sink_delivers_once(spark, tmp_path):
    rows = ledger(4, 60)
    source, sink, state = (str(tmp_path / n) for n in ("in", "sink", "state"))
    add_files(spark, source, rows, 4)
    deliver, fails = delivery.deliver_to(sink), [True]

    def unsteady(batch, number):
        if number == 2 and fails:
            batch.write.parquet(f"{sink}/alerts/batch={number}")  # without a commit
            fails.clear()
            raise RuntimeError("killed")
        deliver(batch, number)

    def start():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/p=*")
        out = stream.select(F.concat(F.lit("A"), (F.col("tx_id") / 2).cast("int").cast("string")).alias("alert_id"), "tx_id")
        return out.writeStream.foreachBatch(unsteady).option("checkpointLocation", state).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    start().awaitTermination()
    got = delivery.delivered(spark, sink, spark.createDataFrame([], ALERTS).schema).collect()
    assert sorted(r.alert_id for r in got) == sorted({f"A{i // 2}" for i in range(60)})


def test_keys_of_the_exact_stream_grow_with_days_and_not_with_customers(spark, tmp_path):
    rows = [(i, i, datetime(2024, 1, 1) + timedelta(minutes=i), Decimal(1)) for i in range(600)]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    add_files(spark, source, rows, 1)
    query = run(spark, source, lambda s: stream_velocity_exact(s, groups=3), out, state)
    assert windows(spark.read.parquet(out)) == {i: (1, Decimal(1)) for i in range(600)}
    assert query.lastProgress["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] <= 6


def test_a_table_is_as_many_batches_however_many_files_a_part_has(spark, tmp_path, monkeypatch):
    from tidemark.plans import case_queries

    monkeypatch.setattr(case_queries, "ROWS_OF_A_FILE", 40)
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), i % 7) for i in range(1000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    stream, folder = case_queries.in_batches(spark, str(tmp_path), "events", "ts")
    seen = []
    writer = stream.writeStream.foreachBatch(lambda df, n: seen.append(sorted(r.event_id for r in df.collect()))).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    assert seen == [list(range(k * 200, k * 200 + 200)) for k in range(5)]


def window_rows(rows, closed, hours):
    """customer, start: count and volume of the windows of so many hours that end by then."""
    want = {}
    for _, c, ts, amount in rows:
        for k in range(hours):
            start = ts.replace(minute=0, second=0, microsecond=0) - timedelta(hours=k)
            if start + timedelta(hours=hours) <= closed:
                n, v = want.get((c, start), (0, None))
                want[c, start] = (n + 1, v if amount is None else (v or 0) + amount)
    return want


def test_windows_are_no_rows_of_state(spark, tmp_path):
    """A customer, null too, with one transaction a day is in every window; the state had a row for each of 24 windows a pane."""
    start = datetime(2024, 1, 1)
    rows = [(i, None if i % 7 == 0 else i % 7, start + timedelta(hours=5 * i, minutes=i % 60), None if i % 11 == 0 else Decimal(10**15 + i)) for i in range(200)]
    for parts in (1, 5):
        source, out = str(tmp_path / f"in{parts}"), str(tmp_path / f"out{parts}")
        add_files(spark, source, rows, parts)
        query = run(spark, source, stream_velocity, out, str(tmp_path / f"state{parts}"))
        found = spark.read.parquet(out)
        got = [((r.customer_id, r.window_start), (r.transactions, r.volume)) for r in found.collect()]
        closed = rows[-1][2] - timedelta(hours=1)
        assert len(got) == len(dict(got)) and dict(got) == window_rows(rows, closed, 24)
        assert found.where("window_end <> window_start + INTERVAL 24 HOURS OR high_velocity <> (transactions >= 10)").count() == 0
        assert max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]) <= len(rows) + 3 * 8


@pytest.mark.parametrize(("kind", "amount"), [("string", "decimal(18,2)"), ("long", "double")])
def test_sliding_windows_of_other_types(spark, tmp_path, kind, amount):
    rows = ledger(5, 200)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    add_files(spark, source, rows, 3)
    build = lambda s: stream_velocity(s.withColumns({"customer_id": F.col("customer_id").cast(kind), "amount": F.col("amount").cast(amount)}), width="6 hours")
    run(spark, source, build, out, str(tmp_path / "state"))
    got = {(int(r.customer_id), r.window_start): (r.transactions, None if r.volume is None else round(float(r.volume), 2)) for r in spark.read.parquet(out).collect()}
    want = {k: (n, None if v is None else float(v)) for k, (n, v) in window_rows(rows, rows[-1][2] - timedelta(hours=1), 6).items()}
    assert got == want
