"""Figures over transactions, alerts and detector calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fixed import RISK_LEVELS

#: Days to the next review, by level.
REVIEW_DAYS = {"LOW": 90, "MEDIUM": 30, "HIGH": 7, "CRITICAL": 1}


def dashboard_metrics(tx: DataFrame, cases: DataFrame, as_of: str) -> DataFrame:
    """One row: transactions and suspicious ones in 24 h, cases, reports this month, mean score, share of high risk."""
    now = F.to_timestamp(F.lit(as_of))
    recent = (F.col("ts") > now - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= now)
    of_tx = tx.agg(
        F.count_if(recent).alias("transactions_24h"),
        F.count_if(recent & F.col("is_suspicious")).alias("suspicious_24h"),
        F.round(F.coalesce(F.avg("risk_score"), F.lit(0.0)), 4).alias("average_score"),
        F.round(F.coalesce(100.0 * F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")) / F.count("*"), F.lit(0.0)), 4).alias("high_risk_percent"),
    )
    of_cases = cases.agg(
        F.count_if(F.col("status") == "OPEN").alias("open_cases"),
        F.count_if(F.col("status").isin("OPEN", "UNDER_REVIEW", "ESCALATED")).alias("pending_cases"),
        F.count_if((F.col("sar_filed_at") >= F.date_trunc("month", now)) & (F.col("sar_filed_at") <= now)).alias("sars_month_to_date"),
    )
    return of_tx.join(of_cases)  # one row each


def risk_distribution(tx: DataFrame) -> DataFrame:
    """One row: the number of transactions of each level, zeros too."""
    return tx.agg(*(F.count_if(F.col("risk_level") == level).alias(level.lower()) for level in RISK_LEVELS))


def alert_trend(alerts: DataFrame) -> DataFrame:
    """Per day: number of alerts and a map from type to number."""
    per_type = alerts.groupBy(F.to_date("created_at").alias("day"), "alert_type").agg(F.count("*").alias("n"))
    return per_type.groupBy("day").agg(
        F.sum("n").alias("alerts"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("alert_type", "n")))).alias("by_type")
    )  # as many entries as there are types


def agent_metrics(calls: DataFrame) -> DataFrame:
    """Per detector: calls (successes), mean latency of them, errors, errors per call."""
    ok = F.col("ok")
    return calls.groupBy("agent").agg(
        F.count_if(ok).alias("calls"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("latency_ms"))), F.lit(0.0)), 4).alias("mean_latency_ms"),
        F.count_if(~ok).alias("errors"),
        F.round(F.count_if(~ok) / F.greatest(F.lit(1), F.count_if(ok)), 6).alias("error_rate"),
    )


def customer_risk_profiles(assessed: DataFrame, as_of: str) -> DataFrame:
    """Per customer: worst score and level, worst component scores, peak velocity, factors and reviews."""
    rank = {level: n for n, level in enumerate(RISK_LEVELS)}
    worst = F.max(F.coalesce(*(F.when(F.col("risk_level") == k, F.lit(v)) for k, v in rank.items())))
    days = F.coalesce(*(F.when(F.col("overall_level") == k, F.lit(v)) for k, v in REVIEW_DAYS.items()))
    return (
        assessed.groupBy("customer_id")
        .agg(
            F.max("risk_score").alias("overall_score"),
            F.get(F.array(*(F.lit(x) for x in RISK_LEVELS)), worst).alias("overall_level"),
            *(F.max(c).alias(f"max_{c}") for c in ("geo_score", "behavior_score", "crypto_score")),
            F.create_map(
                F.lit("peak_count_24h"), F.max("transactions_in_24h").cast("string"), F.lit("peak_volume_24h"), F.max("daily_volume").cast("string")
            ).alias("velocity"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("risk_factors")))).alias("risk_factors"),  # distinct lists of few codes
            F.max("ts").alias("last_assessed"),
        )
        .withColumn("next_review", F.date_add(F.to_date(F.lit(as_of)), days))
    )
