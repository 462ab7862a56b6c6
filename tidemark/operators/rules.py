"""Rule engine: one pass of additive rules, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.functions.arrays import present, texts, words_in

# Steps of the decision path and next steps by action.
STEPS = (
    "entry:initial_screening", "geographic_risk:analyzing", "amount_analysis:analyzing",
    "customer_analysis:analyzing", "transaction_type:analyzing", "risk_scoring:calculating",
)
NEXT_STEPS = {
    "BLOCK": ("Immediately block transaction", "File SAR within 24 hours", "Escalate to compliance officer", "Freeze related accounts"),
    "ESCALATE": ("Escalate to senior analyst", "Gather additional documentation", "Review customer history", "Consider EDD"),
    "REVIEW": ("Manual review required", "Verify customer documentation", "Check transaction purpose"),
    "APPROVE": ("Transaction may proceed", "Standard monitoring applies"),
}


def money(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount.cast("double"), 2))


def rule_list(variant: str) -> list[tuple]:
    """(code, predicate, points, severity, category, description, alert or None), in order.

    An alert is (type, severity, title, confidence).
    """
    origin, dest = F.upper(F.coalesce("origin_country", F.lit(""))), F.upper(F.coalesce("destination_country", F.lit("")))
    amount, kind = F.col("amount"), F.col("transaction_type")
    name = F.lower(F.coalesce("customer_name", F.lit("")))
    age = F.coalesce(F.nullif("account_age_days", F.lit(0)), F.lit(365))
    word = F.get(words_in(name, fixed.SANCTION_WORDS), F.lit(0))
    title = F.get(words_in(name, fixed.PEP_INDICATORS), F.lit(0))
    join = F.concat
    rules = [
        ("HIGH_RISK_ORIGIN", origin.isin(*fixed.RULE_HIGH_RISK), 25, "HIGH", "geographic", join(F.lit("High-risk origin country: "), origin),
         ("HIGH_RISK_JURISDICTION", "HIGH", "High-Risk Origin Country", 0.95)),
        ("HIGH_RISK_DESTINATION", dest.isin(*fixed.RULE_HIGH_RISK), 25, "HIGH", "geographic", join(F.lit("High-risk destination country: "), dest), None),
        ("TAX_HAVEN_DESTINATION", dest.isin(*fixed.RULE_TAX_HAVENS), 15, "MEDIUM", "geographic", join(F.lit("Destination is known tax haven: "), dest),
         ("HIGH_RISK_JURISDICTION", "MEDIUM", "Tax Haven Destination", 0.90)),
        ("GREY_LIST_JURISDICTION", origin.isin(*fixed.RULE_GREY_LIST) | dest.isin(*fixed.RULE_GREY_LIST), 10, "MEDIUM", "geographic",
         F.lit("Transaction involves FATF grey list country"), None),
        ("LARGE_TRANSACTION", amount > 100000, 15, "MEDIUM", "transaction", join(F.lit("Large transaction amount: "), money(amount)),
         ("UNUSUAL_ACTIVITY", "MEDIUM", "Large Value Transaction", 0.85)),
        ("STRUCTURING_INDICATOR", amount.between(9000, 10000), 20, "HIGH", "behavioral", F.lit("Amount near reporting threshold - possible structuring"),
         ("STRUCTURING", "HIGH", "Possible Structuring", 0.88)),
        ("SANCTIONS_KEYWORD_MATCH", word.isNotNull(), 30, "CRITICAL", "sanctions",
         join(F.lit("Customer name contains sanctions-related keyword: '"), word, F.lit("'")), ("SANCTIONS_HIT", "CRITICAL", "Potential Sanctions Concern", 0.92)),
        ("PEP_INDICATOR", title.isNotNull() if variant == "browser" else F.lit(False), 15, "MEDIUM", "pep",
         join(F.lit('Customer name suggests politically exposed person: "'), title, F.lit('"')), None),
        ("CORPORATE_ENTITY", F.lower("customer_type") == "corporate", 5, "LOW", "customer", F.lit("Corporate entities require enhanced due diligence"), None),
        ("NEW_ACCOUNT", age < 90, 10, "MEDIUM", "behavioral", join(F.lit("Account is only "), age.cast("string"), F.lit(" days old")),
         ("UNUSUAL_ACTIVITY", "MEDIUM", "New Account High Activity", 0.80)),
        ("CRYPTO_TRANSACTION", kind == "CRYPTO", 15, "MEDIUM", "crypto", F.lit("Cryptocurrency transactions carry elevated risk"),
         ("CRYPTO_RISK", "MEDIUM", "Cryptocurrency Transaction", 0.85)),
        ("CASH_TRANSACTION", kind == "CASH", 10, "MEDIUM", "transaction", F.lit("Cash transactions have higher AML risk"), None),
    ]
    return [r for r in rules if variant == "browser" or r[0] != "PEP_INDICATOR"]


def score_rules(tx: DataFrame, variant: str = "service") -> DataFrame:
    """tx with factors, alerts, risk_score, risk_level, action, sar_required, action_required and texts.

    Columns read: amount, origin_country, destination_country, transaction_type,
    customer_name, customer_type, account_age_days.  Nulls match no rule; an
    age of 0 or null counts as 365.  ``variant="browser"`` adds the rule on
    politically exposed persons.
    """
    factors, alerts, tests = [], [], {}
    total = F.lit(0)
    for code, test, points, severity, category, description, alert in rule_list(variant):
        tests[f"_is_{code}"] = test  # tested once, read where factor, alert and points need it
        hit = F.col(f"_is_{code}")
        total = total + F.when(hit, points).otherwise(0)
        factor = F.struct(
            F.lit(code).alias("code"), description.alias("description"), F.lit(severity).alias("severity"),
            F.lit(points).alias("score"), F.lit(category).alias("category"),
        )
        factors.append(F.when(hit, factor))
        if alert:
            kind, worst, title, confidence = alert
            alerts.append(
                F.when(hit, F.struct(F.lit(kind).alias("alert_type"), F.lit(worst).alias("severity"), F.lit(title).alias("title"),
                                     F.lit(code).alias("factor"), F.lit(confidence).alias("confidence")))
            )
    score = F.col("risk_score")
    action = F.when(score >= 75, "BLOCK").when(score >= 50, "ESCALATE").when(score >= 30, "REVIEW").otherwise("APPROVE")
    steps = F.lit(None).cast("array<string>")
    for name, what in NEXT_STEPS.items():
        steps = F.when(F.col("action") == name, texts(what)).otherwise(steps)
    return (
        tx.withColumns(tests)
        .withColumns({"factors": present(*factors), "alerts": present(*alerts), "risk_score": F.least(F.lit(100), total)})
        .drop(*tests)
        .withColumns(
            {
                "risk_level": F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW"),
                "action": action,
                "sar_required": score >= 60,
                "action_required": score >= 30,
            }
        )
        .withColumn("next_steps", steps)
    )


def explain_scores(scored: DataFrame) -> DataFrame:
    """Adds decision_path and reasoning, a numbered line for each factor."""
    path = F.concat(texts(STEPS), F.array(F.concat(F.lit("decision:"), F.lower("action"))))
    lines = F.transform(
        "factors",
        lambda f, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". ["), f["severity"], F.lit("] "), f["description"]),
    )
    nothing = texts(["  No significant risk indicators detected."])
    head = F.array(
        F.concat(F.lit("Transaction: "), money(F.col("amount")), F.lit(" "), F.coalesce("transaction_type", F.lit("UNKNOWN"))),
        F.concat(F.lit("RISK ASSESSMENT: "), F.col("risk_level"), F.lit(" (Score: "), F.col("risk_score").cast("string"), F.lit("/100)")),
        F.concat(F.lit("KEY RISK INDICATORS ("), F.size("factors").cast("string"), F.lit("):")),
    )
    return scored.withColumns(
        {"decision_path": path, "reasoning": F.array_join(F.concat(head, F.when(F.size("factors") > 0, lines).otherwise(nothing)), "\n")}
    )


def alert_rows(scored: DataFrame, key: str = "tx_id") -> DataFrame:
    """One row per alert, in rule order, with an id that follows from key and factor."""
    return scored.select(key, F.posexplode("alerts").alias("nth", "a")).select(
        F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), "a.factor").cast("binary"), 256), 1, 16).alias("alert_id"), key, "nth", "a.*"
    )
