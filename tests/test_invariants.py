"""Properties that hold for any input, and the shape of plans."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.helpers import tx, wallet
from tidemark.operators import network, validate
from tidemark.operators.rules import score_rules
from tidemark.operators.screening import watched
from tidemark.operators.velocity import DAY_MICROS, velocity_24h
from tidemark.plans.assess import assess

COUNTRIES = ["US", "IR", "ky", "KY", "PA", "PK", "GB", "", None]


def random_rows(seed, n=120):
    rng = random.Random(seed)
    return [
        {
            "customer_id": rng.randrange(4), "ts": datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(5 * 86400)), "amount": rng.choice([1, 9000, 9500.5, 10000, 60000, 120000]),
            "transaction_type": rng.choice(["CASH", "CRYPTO", "ACH", None]), "origin_country": rng.choice(COUNTRIES), "destination_country": rng.choice(COUNTRIES),
            "intermediate_countries": rng.choice([[], ["PA"], ["KY", "AE"], None]), "parties": rng.choice([["iran_shipping_co"], ["Bob", "North Korea"], [], None]),
            "documents": rng.choice([["d"], [], None]), "crypto_details": rng.choice([None, wallet(3, True, "Hydra", 4, True), wallet(10, False, None, 1)]),
            "customer_name": rng.choice(["Viking King", "Moscow Co", "Ann"]), "account_age_days": rng.choice([0, 5, 29, 30, 200, None]),
        }
        for _ in range(n)
    ]


@pytest.mark.parametrize("direction", ["backward", "both"])
def test_split_by_day_equals_one_window_a_customer(spark, direction):
    df = tx(spark, *random_rows(1))
    upper = 0 if direction == "backward" else DAY_MICROS - 1
    frame = Window.partitionBy("customer_id").orderBy(F.unix_micros("ts")).rangeBetween(-(DAY_MICROS - 1), upper)
    want = df.select("tx_id", F.count("*").over(frame).alias("n"), F.sum("amount").over(frame).alias("v"), F.max("amount").over(frame).alias("m"))
    got = velocity_24h(df, direction).select("tx_id", F.col("transactions_in_24h").alias("n"), F.col("daily_volume").alias("v"), F.col("max_amount").alias("m"))
    assert sorted(want.collect()) == sorted(got.collect())


def test_scores_stay_in_bounds_and_routes_are_clean(spark):
    df = tx(spark, *random_rows(2))
    assert all(0 <= r.risk_score <= 100 and len(r.alerts) <= len(r.factors) for r in score_rules(df, "browser").collect())
    rows = assess(df, watched(spark)).collect()
    assert len(rows) == 120
    for r in rows:
        assert 0 <= r.risk_score <= 100
        if r.entry_route != "CRYPTO_PATH":
            assert r.crypto_score is None and not any("WALLET" in f for f in r.risk_factors)
        if "SANCTIONS_HIT" in r.risk_factors:
            assert (r.risk_score, r.reporting_status, r.sar_required) == (0, "SAR_GENERATED", False)


def test_validation_loses_nothing(spark):
    df = tx(spark, *random_rows(3), {"amount": -1}, {"customer_name": None})
    ok, bad = validate.validate(df)
    assert ok.count() + bad.count() == df.count() and bad.count() == 2


def test_clusters_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    label = {x: x for e in edges for x in e}
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = {k: low if v == high else v for k, v in label.items()}
    frame = spark.createDataFrame(edges, "src long, dst long")
    assert {r.account: r.cluster for r in network.entity_clusters(frame).collect()} == label


def test_the_windows_shuffle_rows_once_and_by_customer_and_day(spark):
    plan = velocity_24h(tx(spark, {}))._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "(who#" in shuffles[0] and ", day#" in shuffles[0]


def test_hot_days_shuffle_rows_once_and_by_slice(spark):
    plan = velocity_24h(tx(spark, {}), hot_rows=0)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert all("(who#" in s and ", day#" in s for s in shuffles)
    assert plan.count("HashAggregate(keys=[who#") == 2 and sum("slice#" in s for s in shuffles) <= 3  # rows, and a row a slice twice
