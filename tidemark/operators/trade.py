"""Trade documents, prices, and rules kept in a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import or_empty, present
from tidemark.functions.fixed import RISK_LEVELS

OPERATORS = {
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
    "=": lambda c, v: c == v, "==": lambda c, v: c == v, "!=": lambda c, v: c != v,
}


def multi_invoice(tx: DataFrame) -> DataFrame:
    """Documents on several transactions: document, number of transactions, total, least and greatest tx_id."""
    rows = tx.select("tx_id", "amount", F.explode(F.array_distinct(or_empty("documents"))).alias("document"))
    return (
        rows.groupBy("document")
        .agg(F.count("*").alias("transactions"), F.sum("amount").alias("total"), F.min("tx_id").alias("first_tx"), F.max("tx_id").alias("last_tx"))
        .where("transactions >= 2")
    )


def median_prices(lines: DataFrame) -> DataFrame:
    """item and market_price, its exact median, from running counts of its distinct prices: no list of prices is kept."""
    counts = lines.where("unit_price IS NOT NULL").groupBy("item", "unit_price").agg(F.count("*").alias("n"))
    item = Window.partitionBy("item")
    ranked = counts.select("item", "unit_price", F.sum("n").over(item.orderBy("unit_price")).alias("upto"), F.sum("n").over(item).alias("total"))
    low, high = (F.min(F.when(F.col("upto") > F.expr(f"(total - {k}) div 2"), F.col("unit_price"))) for k in (1, 0))
    return ranked.groupBy("item").agg((low.cast("double") * 0.5 + high.cast("double") * 0.5).alias("market_price"))


def price_deviation(lines: DataFrame, market: DataFrame | None = None, hi: float = 1.5, lo: float = 0.5) -> DataFrame:
    """Lines (line_id, item, unit_price) whose price is over hi or under lo times the market's (item, market_price).

    Without a market the item's median price stands for it.
    """
    if market is None:
        market = median_prices(lines)
    ratio = F.col("unit_price") / F.col("market_price")
    return (
        lines.join(market, "item").withColumn("ratio", F.round(ratio, 6)).where((ratio > hi) | (ratio < lo))
        .withColumn("code", F.when(F.col("ratio") > 1, "TBML_OVERINVOICE").otherwise("TBML_UNDERINVOICE"))
    )


def configured_rules(tx: DataFrame, rules: DataFrame, most_rules: int = 1000) -> DataFrame:
    """tx with rule_hits, rule_score and rule_severity by the enabled threshold rules.

    Rules (rule_id, parameters as JSON {"column", "op", "value"}, base_risk_score,
    severity) are a small control table, read to the driver and compiled to
    columns; over ``most_rules`` is an error.
    """
    rows = rules.where("is_enabled AND rule_type = 'THRESHOLD'").orderBy("rule_id").limit(most_rules + 1).collect()
    if len(rows) > most_rules:
        raise ValueError(f"over {most_rules} rules")
    hits, score, worst = [], F.lit(0), F.lit(-1)
    for rule in rows:
        what = json.loads(rule.parameters)
        hit = F.coalesce(OPERATORS[what["op"]](F.col(what["column"]), F.lit(what["value"])), F.lit(False))
        hits.append(F.when(hit, F.lit(rule.rule_id)))
        score = score + F.when(hit, rule.base_risk_score).otherwise(0)
        worst = F.greatest(worst, F.when(hit, RISK_LEVELS.index(rule.severity)).otherwise(-1))
    return tx.withColumns(
        {
            "rule_hits": present(*hits).cast("array<string>") if hits else F.array().cast("array<string>"),
            "rule_score": score,
            "rule_severity": F.get(F.array(*(F.lit(x) for x in RISK_LEVELS)), F.when(worst >= 0, worst)),
        }
    )


