"""Rows and actions from assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.answers import severity_of_factor
from tidemark.functions.arrays import contains_any, first_of, texts
from tidemark.functions.fixed import DEFAULTS, RiskSettings

# What happens next, by the first that applies.
NEXT_STEPS = {
    "hits": ("Block transaction immediately", "Notify compliance officer", "File SAR within 30 days",
             "Preserve all related documentation", "Consider law enforcement referral"),
    "sar": ("Review generated SAR narrative", "Complete SAR filing within 30 days", "Document investigation findings", "Schedule follow-up review"),
    "pep": ("Conduct enhanced due diligence", "Obtain senior management approval", "Document source of funds", "Implement enhanced monitoring"),
    "medium": ("Assign to compliance analyst", "Review within 24 hours", "Request additional documentation if needed", "Document decision and rationale"),
    "none": ("No immediate action required", "Continue standard monitoring"),
}
CATEGORIES = (
    (("SANCTION",), "SANCTIONS"), (("PEP",), "PEP"), (("CRYPTO",), "CRYPTO"), (("GEO", "JURISDICTION"), "GEOGRAPHIC"),
    (("STRUCT", "VELOCITY"), "BEHAVIORAL"), (("DOC", "TBML"), "DOCUMENTATION"),
)
ALERT_TYPES = (
    (("SANCTION",), "SANCTIONS_HIT"), (("PEP",), "PEP_MATCH"), (("STRUCTUR",), "STRUCTURING"), (("VELOCITY",), "VELOCITY_BREACH"),
    (("CRYPTO", "MIXER"), "CRYPTO_RISK"), (("JURISDICTION",), "HIGH_RISK_JURISDICTION"), (("DOC",), "DOCUMENT_MISMATCH"),
)
ALERT_SEVERITY = {
    "SANCTIONS_HIT": "CRITICAL", "PEP_MATCH": "HIGH", "STRUCTURING": "HIGH", "CRYPTO_RISK": "HIGH", "HIGH_RISK_JURISDICTION": "HIGH",
}


def enrich_factors(assessed: DataFrame) -> DataFrame:
    """One row per factor: tx_id, nth, code, description, severity, score, category."""
    rows = assessed.select("tx_id", F.posexplode("risk_factors").alias("nth", "code"))
    severity = severity_of_factor(F.col("code"))
    fifteen = contains_any(F.upper("code"), ("TAX_HAVEN", "STRUCTURING"))
    score = F.when(severity == "CRITICAL", 40).when(severity == "HIGH", 25).when(fifteen, 15).otherwise(10)
    return rows.select(
        "tx_id", "nth", "code", F.initcap(F.replace("code", F.lit("_"), F.lit(" "))).alias("description"), severity.alias("severity"),
        score.alias("score"), first_of(F.upper("code"), CATEGORIES, "GENERAL").alias("category"),
    )


def classify_alerts(assessed: DataFrame) -> DataFrame:
    """One row per alert text: tx_id, nth, alert_type, severity, title, description, risk_factors, confidence."""
    rows = assessed.select("tx_id", F.slice("risk_factors", 1, 3).alias("risk_factors"), F.posexplode("alert_texts").alias("nth", "description"))
    kind = first_of(F.upper("description"), ALERT_TYPES, "UNUSUAL_ACTIVITY")
    severity = F.lit("MEDIUM")
    for name, worst in ALERT_SEVERITY.items():
        severity = F.when(F.col("alert_type") == name, worst).otherwise(severity)
    return rows.withColumn("alert_type", kind).select(
        "tx_id", "nth", "alert_type", severity.alias("severity"), F.substring("description", 1, 100).alias("title"), "description",
        "risk_factors", F.lit(0.8).alias("confidence"),
    )


def recommend(assessed: DataFrame, settings: RiskSettings = DEFAULTS) -> DataFrame:
    """Adds recommended_action, action_required and next_steps."""
    hit, score = F.size("sanction_hits") > 0, F.col("risk_score")
    action = (
        F.when(hit, "BLOCK_AND_FILE_SAR")
        .when(score >= settings.critical, "FILE_SAR_IMMEDIATELY")
        .when(score >= settings.high, "FILE_SAR")
        .when(score >= settings.medium, "ESCALATE_FOR_REVIEW")
        .when(score >= settings.low, "MONITOR")
        .otherwise("CLEAR")
    )
    steps = {k: texts(v) for k, v in NEXT_STEPS.items()}
    following = (
        F.when(hit, steps["hits"]).when(F.col("sar_required"), steps["sar"]).when(F.col("pep_status"), steps["pep"])
        .when(score >= settings.medium, steps["medium"]).otherwise(steps["none"])
    )
    return assessed.withColumns({"recommended_action": action, "action_required": score >= settings.medium, "next_steps": following})


def after(as_of: str | Column, interval: str) -> Column:
    now = F.to_timestamp(F.lit(as_of)) if isinstance(as_of, str) else as_of
    return now + F.expr(f"INTERVAL {interval}")


def open_cases(assessed: DataFrame, as_of: str) -> DataFrame:
    """A case for every row that needs a report or has a case_id already."""
    wanted = F.col("sar_required") | (F.col("case_id").isNotNull() if "case_id" in assessed.columns else F.lit(False))
    digest = F.upper(F.substring(F.sha2(F.concat_ws("|", F.lit("case"), F.col("tx_id").cast("string")).cast("binary"), 256), 1, 8))
    number = F.concat(F.lit("CASE-"), digest)
    filed = F.col("reporting_status") == "SAR_GENERATED"
    return assessed.where(wanted).select(
        "tx_id",
        (F.coalesce("case_id", number) if "case_id" in assessed.columns else number).alias("case_number"),
        F.concat(F.lit("Suspicious Activity - Risk Score "), F.col("risk_score").cast("string")).alias("title"),
        F.when(filed, "SAR_FILED").otherwise("OPEN").alias("status"),
        F.col("risk_level").alias("priority"),
        filed.alias("sar_filed"),
        F.when(F.col("reporting_status") == "PENDING_REVIEW", after(as_of, "24 HOURS")).alias("review_deadline"),
        F.when(F.col("sar_required"), after(as_of, "30 DAYS")).alias("sar_deadline"),
        F.to_timestamp(F.lit(as_of)).alias("created_at"),
    )


def batch_summary(assessed: DataFrame) -> DataFrame:
    """One row: total, high_risk, sar_required and average_score (0 of nothing)."""
    return assessed.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")).alias("high_risk"),
        F.count_if("sar_required").alias("sar_required"),
        F.round(F.coalesce(F.sum("risk_score") / F.count("*"), F.lit(0.0)), 4).alias("average_score"),
    )
