from datetime import datetime, timedelta

import pytest

from tests.helpers import tx, wallet
from tidemark.functions.arrays import texts
from tidemark.operators.screening import sanctions_screen, watched
from tidemark.plans.assess import assess
from tidemark.operators.velocity import velocity_24h
from pyspark.sql import functions as F

NOW = datetime(2024, 1, 10, 12)
COLUMNS = ("entry_route", "risk_factors", "risk_score", "risk_level", "reporting_status", "sar_required")


def run(spark, ledger=None, answers=None, extra=None, **row):
    past = None
    if ledger:
        past = tx(spark, *({"tx_id": 100 + i, "customer_id": 0, "ts": NOW - timedelta(hours=h), "amount": a} for i, (h, a) in enumerate(ledger)))
    df = assess(tx(spark, row), watched(spark), past, answers=answers, extra_detectors=extra)
    r = df.first()
    return tuple(r[c] for c in COLUMNS)


def test_structuring_history(spark):
    got = run(spark, ledger=[(2, 9200), (4, 9350)], amount=9500, account_age_days=120)
    factors = ["POTENTIAL_STRUCTURING", "UNIFORM_TRANSACTION_PATTERN", "STRUCTURING_PATTERN"]
    assert got == ("STANDARD_FLOW", factors, 80, "HIGH", "SAR_GENERATED", True)


def test_large_transaction_without_hits_is_cleared(spark):
    got = run(spark, amount=500000, origin_country="IR", parties=["tehran_exporters"], account_age_days=120)
    assert got == ("LARGE_TRANSACTION", [], 0, "LOW", "CLEARED", False)


def test_sanctions_hit_ends_the_route_unscored(spark):
    got = run(spark, amount=2000000, origin_country="RU", parties=["sanctioned_russian_bank", "intermediary_ae"])
    assert got == ("LARGE_TRANSACTION", ["SANCTIONS_HIT"], 0, "LOW", "SAR_GENERATED", False)


def test_crypto_with_mixer(spark):
    got = run(spark, amount=250000, transaction_type="CRYPTO", crypto_details=wallet(3, True, "Hydra", 4), account_age_days=15)
    factors = ["CRYPTO_MIXER_DETECTED", "DARKNET_MARKET_ASSOCIATION", "NEW_CRYPTO_WALLET", "CRYPTO_LAYERING_PATTERN", "HIGH_VALUE_CRYPTO"]
    assert got == ("CRYPTO_PATH", factors, 95, "CRITICAL", "SAR_GENERATED", True)


def test_calm_crypto_goes_the_standard_way(spark):
    route, factors, *_ = run(spark, amount=500, transaction_type="CRYPTO", crypto_details=wallet(swaps=1), destination_country="KY", documents=[])
    assert route == "CRYPTO_PATH" and factors == ["CROSS_CHAIN_ACTIVITY", "TAX_HAVEN_KY", "NO_SUPPORTING_DOCS"]


def test_a_null_wallet_has_defaults(spark):
    assert run(spark, amount=500, transaction_type="CRYPTO", crypto_details=None)[1] == []


def test_new_account_route(spark):
    assert run(spark, amount=15000, account_age_days=29)[0] == "NEW_ACCOUNT_ALERT"
    assert run(spark, amount=15000, account_age_days=30)[0] == "STANDARD_FLOW"


def test_pep_found(spark):
    got = run(spark, amount=500000, customer_name="Minister Adebayo Gov", account_age_days=10, parties=["Acme"])
    assert got == ("LARGE_TRANSACTION", ["PEP_MATCH"], 50, "LOW", "CLEARED", False)


def test_geography_counts_codes_as_written(spark):
    _, factors, *_ = run(spark, intermediate_countries=["PA", "ky"], destination_country="GB")
    assert factors == ["TAX_HAVEN_PA", "TAX_HAVEN_KY", "COMPLEX_ROUTING"]
    _, factors, *_ = run(spark, intermediate_countries=["PA", "KY"], destination_country="GB")
    assert factors[-1] == "TAX_HAVEN_CHAIN"


def test_answers_add_codes(spark):
    said = spark.createDataFrame([(0, "documents", "TBML_OVERINVOICE. Score: 40"), (0, "due_diligence", "NEW_CODE risk score 10")], "tx_id long, agent string, text string")
    _, factors, score, *_ = run(spark, answers=said, amount=100, customer_name="Minister X")
    assert factors == ["TBML_OVERINVOICE", "PEP_MATCH", "NEW_CODE"]
    assert score == 100  # 110: status 25, document code 20, PEP factor 25, scores to 30 and 10


def test_all_answers_of_an_agent_count(spark):
    said = spark.createDataFrame(
        [(0, "documents", "Z TBML_OVERINVOICE. Score: 10"), (0, "documents", "A DOC_FORGED, score 30"), (0, "documents", None), (0, "due_diligence", "ONE_CODE"), (0, "due_diligence", "TWO_CODE risk score 5"),
         (0, "pep", "not said"), (0, "pep", "He is a PEP_FAMILY member")], "tx_id long, agent string, text string")
    _, factors, score, *_ = run(spark, answers=said, amount=100, customer_name="Plain Person")
    assert factors == ["DOC_FORGED", "TBML_OVERINVOICE", "PEP_MATCH", "PEP_FAMILY", "ONE_CODE", "TWO_CODE"]
    assert score == 100


def test_extra_detector(spark):
    def odd(df):
        return df.withColumn("odd_factors", texts(["TBML_ODD"])).withColumn("odd_alerts", texts([])).withColumn("odd_score", F.lit(0))

    assert run(spark, extra=[odd])[1:3] == (["TBML_ODD"], 20)


def test_velocity_bounds_and_equality_with_the_plain_window(spark):
    day = timedelta(days=1)
    at = [NOW - day, NOW - day + timedelta(microseconds=1), NOW, NOW, NOW + day - timedelta(microseconds=1), NOW + day]
    rows = tx(spark, *({"customer_id": 1, "ts": t} for t in at), {"customer_id": 1, "ts": None})
    back = [r.transactions_in_24h for r in velocity_24h(rows).orderBy("tx_id").collect()]
    assert back == [1, 2, 3, 3, 3, 2, 1]
    both = [r.transactions_in_24h for r in velocity_24h(rows, "both").orderBy("tx_id").collect()]
    assert both == [2, 4, 4, 4, 4, 2, 1]


@pytest.mark.parametrize(("party", "kind"), [("IRAN_SHIPPING_CO", "EXACT"), ("iran", "PARTIAL"), ("the terror_group_abc x", "PARTIAL")])
def test_sanctions_match_kinds(spark, party, kind):
    hits = sanctions_screen(tx(spark, {"parties": [party, party]}), watched(spark)).collect()
    assert [h.match_type for h in hits] == [kind, kind]


def test_empty_party_is_part_of_everything_unless_guarded(spark):
    df = tx(spark, {"parties": [""]})
    assert sanctions_screen(df, watched(spark)).first().entry == "sanctioned_russian_bank"
    assert sanctions_screen(df, watched(spark), min_len=1).count() == 0


def test_screening_meets_distinct_names_only(spark):
    plan = sanctions_screen(tx(spark, {}), watched(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan
