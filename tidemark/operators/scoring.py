"""Final scores, levels and reports of the detector pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.functions.arrays import first_of, or_empty
from tidemark.functions.fixed import DEFAULTS, RiskSettings

COMPONENTS = ("geo_score", "behavior_score", "crypto_score", "document_score", "due_diligence_score")
COMPONENT_CAP = 30


def factor_points(codes: Column) -> Column:
    """Points of each of the factors by the first weight's name in it, else 0."""
    upper = F.transform(codes, F.upper)  # once a factor, not for every name
    return F.transform(upper, lambda code: first_of(code, (((name,), points) for name, points in fixed.FACTOR_WEIGHTS), 0))


def level_of(score: Column, settings: RiskSettings = DEFAULTS) -> Column:
    return (
        F.when(score >= settings.critical, "CRITICAL").when(score >= settings.high, "HIGH").when(score >= settings.medium, "MEDIUM").otherwise("LOW")
    )


def risk_score(df: DataFrame, settings: RiskSettings = DEFAULTS) -> DataFrame:
    """Adds risk_score, risk_level, sar_required and breakdown.

    Reads risk_factors, sanction_hits, pep_status and the component scores that
    df has; a null component wasn't run and adds nothing.  A factor that occurs
    twice scores twice, and its points add up in the breakdown.
    """
    hits = F.size(F.coalesce("sanction_hits", F.expr("array()"))) * 40
    pep = F.when(F.coalesce("pep_status", F.lit(False)), 25).otherwise(0)
    of_factors = F.aggregate("_points", F.lit(0), lambda a, x: a + x)
    scored = F.arrays_zip(or_empty("risk_factors").alias("key"), F.col("_points").alias("value"))
    parts = [c for c in COMPONENTS if c in df.columns]
    capped = {c: F.when(F.col(c) > COMPONENT_CAP, COMPONENT_CAP).otherwise(F.col(c)).cast("int") for c in parts}  # null stays null
    total = hits + pep + of_factors
    for c in capped.values():
        total = total + F.coalesce(c, F.lit(0))
    distinct = F.array_distinct(F.transform(F.filter("_scored", lambda x: x["value"] > 0), lambda x: x["key"]))
    summed = F.transform(
        distinct,
        lambda k: F.struct(k.alias("key"), F.aggregate(F.filter("_scored", lambda x: x["key"] == k), F.lit(0), lambda a, x: a + x["value"]).alias("value")),
    )
    entry = lambda name, value: F.when(value.isNotNull() & (value > 0), F.struct(F.lit(name).alias("key"), value.cast("int").alias("value")))
    extra = F.filter(F.array(entry("sanctions", hits), entry("pep", pep), *(entry(n, v) for n, v in capped.items())), lambda x: x.isNotNull())
    out = df.withColumn("_points", factor_points(or_empty("risk_factors"))).withColumn("_scored", scored).withColumn("risk_score", F.least(F.lit(100), total).cast("int"))
    score = F.col("risk_score")
    return out.withColumns(
        {
            "risk_level": level_of(score, settings),
            "sar_required": (score >= settings.high) | (hits > 0) | ((pep > 0) & (score >= settings.medium)),
            "breakdown": F.map_from_entries(F.concat(extra, summed)),
        }
    ).drop("_points", "_scored")


def sar_report(assessed: DataFrame, as_of: str) -> DataFrame:
    """Facts of every case to be filed: sar_id, tx_id, case_summary, subject_info, activity_details."""
    filed = assessed.where(F.col("reporting_status") == "SAR_GENERATED")
    digest = F.sha2(F.concat(F.col("tx_id").cast("string"), F.lit("|"), F.lit(as_of)).cast("binary"), 256)
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))

    def block(*lines: tuple[str, Column]) -> Column:
        return F.concat_ws("\n", *(F.concat(F.lit(f"{label}: "), text) for label, text in lines))

    return filed.select(
        F.concat(F.lit("SAR-"), F.upper(F.substring(digest, 1, 12))).alias("sar_id"),
        "tx_id",
        block(
            ("Transaction Amount", F.concat(F.lit("$"), F.format_number(F.col("amount").cast("double"), 2))),
            ("Origin", value("origin_country")),
            ("Destination", value("destination_country")),
            ("Risk Score", F.concat(F.col("risk_score").cast("string"), F.lit("/100"))),
            ("Risk Level", F.col("risk_level")),
        ).alias("case_summary"),
        block(
            ("Customer Name", value("customer_name")),
            ("Account Age", F.concat(F.coalesce("account_age_days", F.lit(0)).cast("string"), F.lit(" days"))),
        ).alias("subject_info"),
        block(
            ("Risk Factors", F.array_join("risk_factors", ", ")),
            ("Alerts", F.array_join("alert_texts", ", ")),
            ("PEP Status", F.col("pep_status").cast("string")),
            ("Sanctions Hits", F.array_join(F.transform("sanction_hits", lambda h: h["party"]), ", ")),
        ).alias("activity_details"),
    )

