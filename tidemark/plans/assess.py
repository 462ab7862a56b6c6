"""The detector pipeline: all detectors once, masked by each transaction's route."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import or_empty, texts
from tidemark.functions.fixed import DEFAULTS, RiskSettings
from tidemark.operators.answers import apply_answers
from tidemark.operators.detectors import behavioral_risk, crypto_risk, document_check, geographic_risk, is_crypto, pep_screen
from tidemark.operators.scoring import risk_score
from tidemark.operators.screening import with_hits
from tidemark.operators.velocity import WINDOWS, windows_24h

ROUTES = ("CRYPTO_PATH", "LARGE_TRANSACTION", "NEW_ACCOUNT_ALERT", "STANDARD_FLOW")


def route(df: DataFrame, settings: RiskSettings = DEFAULTS) -> DataFrame:
    """Adds the entry route and which detectors apply: runs_<name>.

    Crypto with a factor of crypto, darknet or mixer goes straight to due
    diligence; other crypto goes on as standard.  A sanctions hit ends the route
    before the check on politically exposed persons and before scoring.
    """
    # As the detectors read it, a missing age is that of a new account only after normalising.
    age = F.coalesce("account_age_days", F.lit(365))
    entry = (
        F.when(is_crypto(), "CRYPTO_PATH")
        .when(F.col("amount") > settings.very_large, "LARGE_TRANSACTION")
        .when((age < settings.new_account_days) & (F.col("amount") > settings.large), "NEW_ACCOUNT_ALERT")
        .otherwise("STANDARD_FLOW")
    )
    risky = F.exists("crypto_factors", lambda f: F.contains(f, F.lit("CRYPTO")) | F.contains(f, F.lit("DARKNET")) | F.contains(f, F.lit("MIXER")))
    is_ = lambda name: F.col("entry_route") == name
    hit = F.size("sanction_hits") > 0
    return (
        df.withColumn("entry_route", entry)
        .withColumn("risky_crypto", is_("CRYPTO_PATH") & risky)
        .withColumn("runs_crypto", is_("CRYPTO_PATH"))
        .withColumn("runs_standard", is_("STANDARD_FLOW") | (is_("CRYPTO_PATH") & ~F.col("risky_crypto")))
        .withColumn("runs_sanctions", F.col("runs_standard") | is_("LARGE_TRANSACTION"))
        .withColumn("stopped", F.col("runs_sanctions") & hit)
        .withColumn("runs_pep", F.col("runs_sanctions") & ~hit)
        .withColumn("pep_found", F.col("runs_pep") & F.col("pep_status"))
        .withColumn("runs_due_diligence", F.col("risky_crypto") | is_("NEW_ACCOUNT_ALERT") | F.col("pep_found"))
    )


def masked(flag: str, column: str, nothing: Column) -> Column:
    return F.when(F.col(flag), F.col(column)).otherwise(nothing)


def routing_decisions() -> Column:
    score = F.col("risk_score")
    final = (
        F.when(score >= DEFAULTS.critical, "final:CRITICAL_SAR")
        .when(score >= DEFAULTS.high, "final:HIGH_RISK_SAR")
        .when(score >= DEFAULTS.medium, "final:MEDIUM_REVIEW")
        .otherwise("final:LOW_RISK_CLEAR")
    )
    steps = [
        F.concat(F.lit("initial:"), F.col("entry_route")),
        F.when(F.col("runs_crypto"), F.when(F.col("risky_crypto"), "crypto:HIGH_RISK").otherwise("crypto:NORMAL")),
        F.when(F.col("runs_sanctions"), F.when(F.col("stopped"), "sanctions:HIT_FOUND").otherwise("sanctions:CLEAR")),
        F.when(F.col("runs_pep"), F.when(F.col("pep_found"), "pep:PEP_FOUND").otherwise("pep:NO_PEP")),
        F.when(~F.col("stopped"), final),
    ]
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def decision_path() -> Column:
    """The steps run, in order."""
    def step(flag: Column | str, name: str) -> Column:
        return F.when(F.col(flag) if isinstance(flag, str) else flag, F.lit(name))

    status = F.col("reporting_status")
    steps = [
        F.lit("initial_screening"), step("runs_crypto", "crypto_risk"), step("runs_standard", "geographic_risk"),
        step("runs_standard", "behavioral_analysis"), step("runs_standard", "document_analysis"), step("runs_sanctions", "sanctions_screening"),
        step("runs_pep", "pep_screening"), step("runs_due_diligence", "enhanced_due_diligence"), step(~F.col("stopped"), "risk_scoring"),
        F.when(status == "SAR_GENERATED", "sar_generation").when(status == "PENDING_REVIEW", "human_review").otherwise("case_cleared"),
    ]
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def detected(tx: DataFrame, ledger: DataFrame | None, watchlist: DataFrame, settings: RiskSettings, direction: str) -> DataFrame:
    """tx with every detector's columns; ledger rows only give context to the 24-hour windows."""
    tx = with_hits(tx, watchlist)  # before the windows, where it is read once a row
    if set(WINDOWS) <= set(tx.columns):
        windowed = tx
    elif ledger is None:
        windowed = windows_24h(tx, direction)
    else:
        both = tx.withColumn("_own", F.lit(True)).unionByName(ledger.withColumn("_own", F.lit(False)), allowMissingColumns=True)
        windowed = windows_24h(both, direction).where("_own").drop("_own")
    return document_check(pep_screen(crypto_risk(behavioral_risk(geographic_risk(windowed, settings), settings))))


def assess(
    tx: DataFrame,
    watchlist: DataFrame,
    ledger: DataFrame | None = None,
    answers: DataFrame | None = None,
    settings: RiskSettings = DEFAULTS,
    direction: str = "backward",
    extra_detectors: list[Callable[[DataFrame], DataFrame]] | None = None,
    as_of: str | None = None,
) -> DataFrame:
    """The whole pipeline: tx (with customer attributes) to assessments.

    ``answers`` (tx_id, agent, text) are model answers; without them detectors
    give what their rules find.  An extra detector is a function that adds
    columns <name>_factors, <name>_alerts and <name>_score; it runs on every
    route, after the others.  Where tx has the columns of the 24-hour windows (windows_24h)
    they are taken, and ledger and direction are not read.
    """
    own = {c for c in tx.columns if c not in WINDOWS}
    df = detected(tx, ledger, watchlist, settings, direction)
    extra: list[str] = []
    for detector in extra_detectors or []:
        before = set(df.columns)
        df = detector(df)
        extra += [c.removesuffix("_factors") for c in df.columns if c not in before and c.endswith("_factors")]
    nothing = texts([])
    df = apply_answers(df, answers) if answers is not None else df
    df = route(df, settings)
    with_answers = answers is not None
    factors = [
        masked("runs_crypto", "crypto_factors", nothing), masked("runs_standard", "geo_factors", nothing),
        masked("runs_standard", "behavior_factors", nothing), masked("runs_standard", "document_factors", nothing),
        F.when(F.col("stopped"), texts(["SANCTIONS_HIT"])).otherwise(nothing), masked("runs_pep", "pep_factors", nothing),
        *(or_empty(f"{name}_factors") for name in extra),
    ]
    alerts = [
        masked("runs_crypto", "crypto_alerts", nothing), masked("runs_standard", "geo_alerts", nothing),
        masked("runs_standard", "behavior_alerts", nothing), masked("runs_standard", "document_alerts", nothing),
        F.when(F.col("runs_sanctions"), F.transform(
            F.filter("sanction_hits", lambda h: h["match_type"] != "JURISDICTION"),
            lambda h: F.concat(F.lit("SANCTIONS HIT: "), h["party"], F.lit(" matched against OFAC SDN list")))).otherwise(nothing),
        masked("runs_pep", "pep_alerts", nothing),
        *(or_empty(f"{name}_alerts") for name in extra if f"{name}_alerts" in df.columns),
    ]
    hits_type = df.schema["sanction_hits"].dataType
    df = df.withColumn("risk_factors", F.concat(*factors)).withColumn("alert_texts", F.concat(*alerts))
    if with_answers:  # due diligence adds codes that aren't there yet
        new = F.filter(or_empty("due_diligence_codes"), lambda c: ~F.array_contains("risk_factors", c))
        df = df.withColumn("risk_factors", F.concat("risk_factors", F.when(F.col("runs_due_diligence"), new).otherwise(nothing)))
    null = F.lit(None).cast("int")
    df = df.withColumns(
        {
            "geo_score": masked("runs_standard", "geo_score", null),
            "behavior_score": masked("runs_standard", "behavior_score", null),
            "crypto_score": masked("runs_crypto", "crypto_score", null),
            "sanction_hits": masked("runs_sanctions", "sanction_hits", F.array().cast(hits_type)),
            "pep_status": F.col("pep_found"),
            **({"document_score": masked("runs_standard", "document_score", null),
                "due_diligence_score": masked("runs_due_diligence", "due_diligence_score", null)} if with_answers else {}),
        }
    )
    scored = risk_score(df, settings)
    stopped = F.col("stopped")
    status = F.when(stopped | (F.col("risk_score") >= settings.high), "SAR_GENERATED").when(
        F.col("risk_score") >= settings.medium, "PENDING_REVIEW"
    ).otherwise("CLEARED")
    scored = (
        scored.withColumn("risk_score", F.when(stopped, 0).otherwise(F.col("risk_score")))
        .withColumn("risk_level", F.when(stopped, "LOW").otherwise(F.col("risk_level")))
        .withColumn("sar_required", ~stopped & F.col("sar_required"))
        .withColumn("reporting_status", status)
    )
    scored = scored.withColumn("routing_decisions", routing_decisions()).withColumn("decision_path", decision_path())
    if as_of:
        deadline = F.to_timestamp(F.lit(as_of)) + F.expr("INTERVAL 24 HOURS")
        scored = scored.withColumn("review_deadline", F.when(F.col("reporting_status") == "PENDING_REVIEW", deadline))
    kept = [c for c in scored.columns if c in own or c not in df.columns or c in (
        "entry_route", "risk_factors", "alert_texts", "sanction_hits", "pep_status", "transactions_in_24h", "daily_volume",
        "geo_score", "behavior_score", "crypto_score", "document_score", "due_diligence_score")]
    return scored.select(*kept)
