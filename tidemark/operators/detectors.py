"""Detectors of the pipeline: each adds <name>_factors, <name>_alerts and <name>_score.

All are expressions over one row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.functions.arrays import contains_any, or_empty, present_texts, texts, words_in
from tidemark.functions.fixed import DEFAULTS, RiskSettings


def add_points(*cases: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for hit, points in cases:
        total = total + F.when(hit, points).otherwise(0)
    return total


def named(hit: Column, code: str) -> Column:
    return F.when(hit, F.lit(code))


#: The single places of a transaction: role and column.
ENDS = (("origin", "origin_country"), ("destination", "destination_country"))


def risk_type(country: Column, settings: RiskSettings) -> Column:
    """The first list that has the country (upper case), else null."""
    return (
        F.when(country.isin(*settings.high_risk), "HIGH_RISK")
        .when(country.isin(*settings.tax_havens), "TAX_HAVEN")
        .when(country.isin(*settings.grey_list), "GREY_LIST")
    )


def points_of(kind: Column) -> Column:
    return F.when(kind == "HIGH_RISK", 25).when(kind == "TAX_HAVEN", 15).otherwise(10)


def code_of(kind: Column, country: Column) -> Column:
    return F.concat(F.when(kind == "HIGH_RISK", "HIGH_RISK_JURISDICTION").otherwise(kind), F.lit("_"), country)


def alert_of(role: Column, country: Column) -> Column:
    return F.concat(F.lit("HIGH_RISK_JURISDICTION: "), country, F.lit(" ("), role, F.lit(")"))


def detail(role: Column, country: Column, kind: Column) -> Column:
    return F.struct(role.alias("role"), country.alias("country"), kind.alias("risk_type"), points_of(kind).alias("points"))


def if_any(many: Column, worked_out: Column, nothing: Column) -> Column:
    """What is worked out of the items, where there are any: most rows call no function for each item."""
    return F.when(F.size(many) > 0, worked_out).otherwise(nothing)


def judged_between(settings: RiskSettings) -> Column:
    """(role, country, risk_type, points) of the intermediate countries on a list."""
    # One step for each value, so that it is worked out once a place.
    upper = F.transform(or_empty("intermediate_countries"), lambda c: F.upper(c))
    typed = F.transform(upper, lambda c: F.struct(c.alias("country"), risk_type(c, settings).alias("risk_type")))
    listed = F.filter(typed, lambda p: p["risk_type"].isNotNull())
    return F.transform(listed, lambda p: detail(F.lit("intermediate"), p["country"], p["risk_type"]))


def judged(tx: DataFrame, settings: RiskSettings) -> DataFrame:
    """tx with geo_details: (role, country, risk_type, points) of origin, destination and intermediate countries on a list.

    The first list that has a place counts.  Also adds _between, the intermediate ones alone, and the ends' types, _origin and _destination.
    """
    kinds = {f"_{role}": F.when(F.col(c) != "", risk_type(F.upper(c), settings)) for role, c in ENDS}
    df = tx.withColumns(kinds).withColumn("_between", judged_between(settings))

    def end(role: str, column: str) -> Column:
        one = F.array(detail(F.lit(role), F.upper(column), F.col(f"_{role}")))
        return F.when(F.col(f"_{role}").isNotNull(), one).otherwise(F.slice(one, 1, 0))

    return df.withColumn("geo_details", F.concat(*(end(*e) for e in ENDS), "_between"))


def geographic_risk(tx: DataFrame, settings: RiskSettings = DEFAULTS) -> DataFrame:
    """geo_factors, geo_alerts, geo_score (to 50), geo_details and jurisdictions_analyzed.

    A chain of tax havens counts codes as they are written, so lower-case ones don't.
    Empty ends are no places.
    """
    df = judged(tx, settings)
    via, between, nothing = or_empty("intermediate_countries"), F.col("_between"), texts([])
    kinds = {role: F.col(f"_{role}") for role, _ in ENDS}
    count = lambda hit: F.when(hit, 1).otherwise(0)
    havens = if_any(via, F.size(F.filter(via, lambda c: c.isin(*settings.tax_havens))), F.lit(0))
    points = if_any(between, F.aggregate(between, F.lit(0), lambda a, d: a + d["points"]), F.lit(0))
    jurisdictions = F.size(via)
    for role, c in ENDS:
        havens = havens + count(F.col(c).isin(*settings.tax_havens))
        points = points + F.when(kinds[role].isNotNull(), points_of(kinds[role])).otherwise(0)
        jurisdictions = jurisdictions + count(F.col(c) != "")
    complex_route, chain = F.size(via) >= 2, havens >= 2
    codes = [F.when(kinds[role].isNotNull(), F.array(code_of(kinds[role], F.upper(c)))).otherwise(nothing) for role, c in ENDS]
    codes.append(if_any(between, F.transform(between, lambda d: code_of(d["risk_type"], d["country"])), nothing))
    alerts = [F.when(kinds[role] == "HIGH_RISK", F.array(alert_of(F.lit(role), F.upper(c)))).otherwise(nothing) for role, c in ENDS]
    risky = F.filter(between, lambda d: d["risk_type"] == "HIGH_RISK")
    alerts.append(if_any(between, F.transform(risky, lambda d: alert_of(d["role"], d["country"])), nothing))
    return df.withColumns(
        {
            "geo_factors": F.concat(*codes, present_texts(named(complex_route, "COMPLEX_ROUTING"), named(chain, "TAX_HAVEN_CHAIN"))),
            "geo_alerts": F.concat(*alerts, present_texts(named(chain, "Multiple tax havens in transaction path"))),
            "geo_score": F.least(F.lit(50), points + add_points((complex_route, 10), (chain, 20))),
            "jurisdictions_analyzed": jurisdictions,
        }
    ).drop("_between", *(f"_{role}" for role, _ in ENDS))


def jurisdiction_exposure(tx: DataFrame, settings: RiskSettings = DEFAULTS) -> DataFrame:
    """Long form: one row per transaction and listed place, with its position."""
    df = judged(tx, settings).select("tx_id", F.posexplode("geo_details").alias("nth", "j"))
    return df.select("tx_id", "nth", "j.*")


def behavioral_risk(tx: DataFrame, settings: RiskSettings = DEFAULTS) -> DataFrame:
    """behavior_factors, behavior_alerts and behavior_score (to 50), from velocity_24h's columns."""
    amount, n = F.col("amount"), F.col("transactions_in_24h")
    age = F.coalesce("account_age_days", F.lit(0))
    dollars = lambda c: F.concat(F.lit("$"), F.format_number(c.cast("double"), 2))
    near = (amount >= 9000) & (amount < 10000)
    fast = F.col("recent_count") >= settings.max_daily_transactions - 1
    over = F.col("daily_volume") > settings.max_daily_amount
    uniform = (n >= 3) & (F.col("mean_amount") > 0) & (F.col("sd_amount") / F.col("mean_amount") < 0.1)
    pattern = (n >= 3) & F.col("all_in_band")
    new = age < settings.new_account_days
    new_high, new_fast = new & (amount > settings.large), new & (F.col("recent_count") >= 3)
    whole = (amount >= 10000) & (amount % 1000 == 0)
    return tx.withColumns(
        {
            "behavior_factors": present_texts(
                named(near, "POTENTIAL_STRUCTURING"), named(fast, "HIGH_VELOCITY"), named(over, "DAILY_LIMIT_EXCEEDED"),
                named(uniform, "UNIFORM_TRANSACTION_PATTERN"), named(pattern, "STRUCTURING_PATTERN"),
                named(new_high, "NEW_ACCOUNT_HIGH_VALUE"), named(new_fast, "NEW_ACCOUNT_HIGH_VELOCITY"), named(whole, "ROUND_AMOUNT"),
            ),
            "behavior_alerts": present_texts(
                F.when(near, F.concat(F.lit("Transaction amount "), dollars(amount), F.lit(" just below $10,000 threshold"))),
                F.when(fast, F.concat(n.cast("string"), F.lit(" transactions in 24 hours"))),
                F.when(over, F.concat(F.lit("Daily volume "), dollars(F.col("daily_volume")), F.lit(" exceeds threshold"))),
                named(pattern, "Multiple transactions just below $10,000 threshold"),
                F.when(new_high, F.concat(F.lit("High-value transaction on "), age.cast("string"), F.lit("-day-old account"))),
            ),
            "behavior_score": F.least(
                F.lit(50), add_points((near, 20), (fast, 15), (over, 15), (uniform, 15), (pattern, 30), (new_high, 20), (new_fast, 15), (whole, 5))
            ),
        }
    )


def is_crypto() -> Column:
    return F.coalesce(F.col("asset_type") == "CRYPTO", F.lit(False)) | F.coalesce(F.col("transaction_type") == "CRYPTO", F.lit(False))


def crypto_risk(tx: DataFrame) -> DataFrame:
    """crypto_factors, crypto_alerts and crypto_score (to 50); empty and null for what isn't crypto.

    A null wallet has all defaults: no mixer, 365 days, no swaps.
    """
    wallet = F.col("crypto_details")
    mixer, coin = (F.coalesce(wallet[c], F.lit(False)) for c in ("mixer_used", "privacy_coin"))
    dark = contains_any(F.lower(wallet["darknet_market"]), fixed.DARKNET_MARKETS)
    age, swaps = F.coalesce(wallet["wallet_age_days"], F.lit(365)), F.coalesce(wallet["cross_chain_swaps"], F.lit(0))
    new, recent, layers, some = age < 7, (age >= 7) & (age < 30), swaps >= 3, (swaps >= 1) & (swaps < 3)
    high = F.coalesce(F.col("amount") > 100000, F.lit(False))
    factors = present_texts(
        named(mixer, "CRYPTO_MIXER_DETECTED"), named(dark, "DARKNET_MARKET_ASSOCIATION"), named(new, "NEW_CRYPTO_WALLET"),
        named(recent, "RECENT_CRYPTO_WALLET"), named(layers, "CRYPTO_LAYERING_PATTERN"), named(some, "CROSS_CHAIN_ACTIVITY"),
        named(coin, "PRIVACY_COIN_USAGE"), named(high, "HIGH_VALUE_CRYPTO"),
    )
    alerts = present_texts(
        named(mixer, "Cryptocurrency mixing service detected"),
        F.when(dark, F.concat(F.lit("Darknet market association: "), wallet["darknet_market"])),
        F.when(layers, F.concat(swaps.cast("string"), F.lit(" cross-chain swaps detected"))),
        named(coin, "Privacy coin conversion detected"),
    )
    points = add_points((mixer, 35), (dark, 40), (new, 15), (recent, 10), (layers, 20), (some, 10), (coin, 25), (high, 10))
    return tx.withColumns(
        {
            "crypto_factors": F.when(is_crypto(), factors).otherwise(texts([])),
            "crypto_alerts": F.when(is_crypto(), alerts).otherwise(texts([])),
            "crypto_score": F.when(is_crypto(), F.least(F.lit(50), points)),
        }
    )


def pep_screen(customers: DataFrame) -> DataFrame:
    """pep_status, pep_terms (all words found, in list order), pep_factors, pep_alerts, pep_confidence."""
    found = words_in(F.lower("customer_name"), fixed.PEP_WORDS)
    status = F.size("pep_terms") > 0
    return customers.withColumn("pep_terms", found).withColumns(
        {
            "pep_status": status,
            "pep_factors": present_texts(named(status, "PEP_MATCH")),
            "pep_alerts": present_texts(
                F.when(status, F.concat(F.lit("PEP indicator: Customer name contains '"), F.array_join("pep_terms", ", "), F.lit("'")))
            ),
            "pep_confidence": F.when(status, F.lit(0.7)),
        }
    )


def document_check(tx: DataFrame) -> DataFrame:
    """document_factors and document_alerts where there is no document."""
    none = F.size(or_empty("documents")) == 0
    return tx.withColumns(
        {"document_factors": present_texts(named(none, "NO_SUPPORTING_DOCS")), "document_alerts": present_texts(named(none, "MISSING_DOCUMENTATION"))}
    )
