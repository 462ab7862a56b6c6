"""Queries on transactions, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.functions.fixed import DEFAULTS
from tidemark.operators import dashboard, detectors, network, results, rules, scoring, screening, trade, validate, velocity
from tidemark.plans.assess import assess
from tidemark.sources.views import FLOWS_SQL, LINKS_SQL, PAY_SQL, TX_SQL, flows, links, payments, transactions, transactions_after

AS_OF = "1999-06-15 12:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def joined(column: str) -> F.Column:
    return F.array_join(column, ",")


def quoted(values: tuple[str, ...]) -> str:
    return "'" + "; ".join(values) + "'"


def in_list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def any_word(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


# ---- the rule engine -------------------------------------------------------

RULES = (
    ("HIGH_RISK_ORIGIN", f"upper(origin_country) IN {in_list(fixed.RULE_HIGH_RISK)}", 25),
    ("HIGH_RISK_DESTINATION", f"upper(destination_country) IN {in_list(fixed.RULE_HIGH_RISK)}", 25),
    ("TAX_HAVEN_DESTINATION", f"upper(destination_country) IN {in_list(fixed.RULE_TAX_HAVENS)}", 15),
    ("GREY_LIST_JURISDICTION", f"(coalesce(origin_country, '') IN {in_list(fixed.RULE_GREY_LIST)} OR destination_country IN {in_list(fixed.RULE_GREY_LIST)})", 10),
    ("LARGE_TRANSACTION", "amount > 100000", 15),
    ("STRUCTURING_INDICATOR", "amount BETWEEN 9000 AND 10000", 20),
    ("SANCTIONS_KEYWORD_MATCH", any_word("lower(customer_name)", fixed.SANCTION_WORDS), 30),
    ("PEP_INDICATOR", any_word("lower(customer_name)", fixed.PEP_INDICATORS), 15),
    ("CORPORATE_ENTITY", "lower(customer_type) = 'corporate'", 5),
    ("NEW_ACCOUNT", "coalesce(nullif(account_age_days, 0), 365) < 90", 10),
    ("CRYPTO_TRANSACTION", "transaction_type = 'CRYPTO'", 15),
    ("CASH_TRANSACTION", "transaction_type = 'CASH'", 10),
)


def rules_sql(browser: bool) -> str:
    used = [r for r in RULES if browser or r[0] != "PEP_INDICATOR"]
    factors = ", ".join(f"CASE WHEN {p} THEN '{c}' END" for c, p, _ in used)
    total = " + ".join(f"CASE WHEN {p} THEN {n} ELSE 0 END" for _, p, n in used)
    return f"""scored AS (SELECT *, concat_ws(',', {factors}) AS factors, least(100, {total})::INT AS risk_score FROM tx),
leveled AS (SELECT *, CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM'
  ELSE 'LOW' END AS risk_level, CASE WHEN risk_score >= 75 THEN 'BLOCK' WHEN risk_score >= 50 THEN 'ESCALATE' WHEN risk_score >= 30
  THEN 'REVIEW' ELSE 'APPROVE' END AS action, risk_score >= 60 AS sar_required, risk_score >= 30 AS action_required FROM scored)"""


RULE_COLUMNS = "tx_id, factors, risk_score, risk_level, action, sar_required, action_required"


def scored_rules(spark: SparkSession, sf_dir: str, variant: str = "service") -> DataFrame:
    return rules.score_rules(transactions(spark, sf_dir), variant)


def rule_columns(scored: DataFrame) -> DataFrame:
    codes = F.array_join(F.transform("factors", lambda f: f["code"]), ",")
    return scored.withColumn("factors", codes).select(*RULE_COLUMNS.split(", "))


@query(f"WITH {TX_SQL}, {rules_sql(False)} SELECT {RULE_COLUMNS} FROM leveled")
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_columns(scored_rules(spark, sf_dir))


@query(f"WITH {TX_SQL}, {rules_sql(True)} SELECT {RULE_COLUMNS} FROM leveled")
def rule_scores_browser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_columns(scored_rules(spark, sf_dir, "browser"))


#: Severity and description of each rule's factor, as SQL.
FIRST_WORD = "coalesce(" + ", ".join(f"CASE WHEN contains(lower(customer_name), '{w}') THEN '{w}' END" for w in fixed.SANCTION_WORDS) + ")"
DESCRIBED = {
    "HIGH_RISK_ORIGIN": ("HIGH", "concat('High-risk origin country: ', upper(origin_country))"),
    "HIGH_RISK_DESTINATION": ("HIGH", "concat('High-risk destination country: ', upper(destination_country))"),
    "TAX_HAVEN_DESTINATION": ("MEDIUM", "concat('Destination is known tax haven: ', upper(destination_country))"),
    "GREY_LIST_JURISDICTION": ("MEDIUM", "'Transaction involves FATF grey list country'"),
    "LARGE_TRANSACTION": ("MEDIUM", "concat('Large transaction amount: $', format('{:,.2f}', CAST(amount AS DOUBLE)))"),
    "STRUCTURING_INDICATOR": ("HIGH", "'Amount near reporting threshold - possible structuring'"),
    "SANCTIONS_KEYWORD_MATCH": ("CRITICAL", f"concat('Customer name contains sanctions-related keyword: ', chr(39), {FIRST_WORD}, chr(39))"),
    "CORPORATE_ENTITY": ("LOW", "'Corporate entities require enhanced due diligence'"),
    "NEW_ACCOUNT": ("MEDIUM", "concat('Account is only ', coalesce(nullif(account_age_days, 0), 365), ' days old')"),
    "CRYPTO_TRANSACTION": ("MEDIUM", "'Cryptocurrency transactions carry elevated risk'"),
    "CASH_TRANSACTION": ("MEDIUM", "'Cash transactions have higher AML risk'"),
}
TITLES = {
    "HIGH_RISK_ORIGIN": "High-Risk Origin Country", "TAX_HAVEN_DESTINATION": "Tax Haven Destination", "LARGE_TRANSACTION": "Large Value Transaction",
    "STRUCTURING_INDICATOR": "Possible Structuring", "SANCTIONS_KEYWORD_MATCH": "Potential Sanctions Concern", "NEW_ACCOUNT": "New Account High Activity",
    "CRYPTO_TRANSACTION": "Cryptocurrency Transaction",
}
TITLE_SQL = "CASE factor " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in TITLES.items()) + " END AS title"
REASON_LINES = ", ".join(f"CASE WHEN {p} THEN concat('[{DESCRIBED[c][0]}] ', {DESCRIBED[c][1]}) END" for c, p, _ in RULES if c in DESCRIBED)
STEPS_SQL = "CASE action " + " ".join(f"WHEN '{a}' THEN '{'; '.join(steps)}'" for a, steps in rules.NEXT_STEPS.items()) + " END AS next_steps"
ALERTED = {
    "HIGH_RISK_ORIGIN": ("HIGH_RISK_JURISDICTION", "HIGH", 0.95), "TAX_HAVEN_DESTINATION": ("HIGH_RISK_JURISDICTION", "MEDIUM", 0.9),
    "LARGE_TRANSACTION": ("UNUSUAL_ACTIVITY", "MEDIUM", 0.85), "STRUCTURING_INDICATOR": ("STRUCTURING", "HIGH", 0.88),
    "SANCTIONS_KEYWORD_MATCH": ("SANCTIONS_HIT", "CRITICAL", 0.92), "NEW_ACCOUNT": ("UNUSUAL_ACTIVITY", "MEDIUM", 0.8),
    "CRYPTO_TRANSACTION": ("CRYPTO_RISK", "MEDIUM", 0.85),
}
ALERTS_SQL = " UNION ALL ".join(
    f"SELECT tx_id, '{c}' AS factor, '{ALERTED[c][0]}' AS alert_type, '{ALERTED[c][1]}' AS severity, CAST({ALERTED[c][2]} AS DOUBLE) AS confidence, ts "
    f"FROM tx WHERE {p}"
    for c, p, _ in RULES
    if c in ALERTED
)


@query(
    f"WITH {TX_SQL}, a AS ({ALERTS_SQL}) SELECT left(sha256(concat(CAST(tx_id AS STRING), '|', factor)), 16) AS alert_id, "
    f"tx_id, factor, alert_type, severity, {TITLE_SQL}, confidence FROM a"
)
def rule_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.alert_rows(scored_rules(spark, sf_dir))
    return rows.select("alert_id", "tx_id", "factor", "alert_type", "severity", "title", "confidence")


@query(
    f"WITH {TX_SQL}, {rules_sql(False)}, x AS (SELECT *, list_filter([{REASON_LINES}], lambda l: l IS NOT NULL) AS lines FROM leveled) "
    "SELECT tx_id, concat('entry:initial_screening,geographic_risk:analyzing,amount_analysis:analyzing,"
    "customer_analysis:analyzing,transaction_type:analyzing,risk_scoring:calculating,decision:', lower(action)) AS decision_path, "
    f"{STEPS_SQL}, concat('Transaction: $', format('{{:,.2f}}', CAST(amount AS DOUBLE)), ' ', coalesce(transaction_type, 'UNKNOWN'), chr(10), "
    "'RISK ASSESSMENT: ', risk_level, ' (Score: ', risk_score, '/100)', chr(10), 'KEY RISK INDICATORS (', len(lines), '):', chr(10), CASE WHEN len(lines) = 0 THEN "
    "'  No significant risk indicators detected.' ELSE array_to_string(list_transform(lines, lambda l, i: concat('  ', i, '. ', l)), chr(10)) END) AS reasoning FROM x"
)
def rule_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    explained = rules.explain_scores(scored_rules(spark, sf_dir))
    return explained.select("tx_id", joined("decision_path").alias("decision_path"), F.array_join("next_steps", "; ").alias("next_steps"), "reasoning")


# ---- checking, joining -----------------------------------------------------

REASONS = (
    "concat_ws(',', CASE WHEN coalesce(amount <= 0, true) THEN 'amount' END, CASE WHEN coalesce(length(customer_name) NOT BETWEEN 1 AND 500, true) "
    "THEN 'customer_name' END, CASE WHEN length(currency) > 3 THEN 'currency' END, CASE WHEN transaction_type NOT IN "
    f"{in_list(fixed.TRANSACTION_TYPES)} THEN 'transaction_type' END)"
)


@query(f"WITH {TX_SQL} SELECT tx_id, {REASONS} AS reasons FROM tx WHERE {REASONS} <> ''")
def rejected_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(transactions(spark, sf_dir))[1].select("tx_id", joined("reasons").alias("reasons"))


@query(
    f"WITH {TX_SQL} SELECT tx_id, upper(origin_country) AS origin_country, upper(destination_country) AS destination_country, "
    "coalesce(currency, 'USD') AS currency, coalesce(transaction_type, 'WIRE_TRANSFER') AS transaction_type, coalesce(account_age_days, 0) AS account_age_days "
    f"FROM tx WHERE {REASONS} = ''"
)
def accepted_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = validate.normalise(validate.validate(transactions(spark, sf_dir))[0])
    return good.select("tx_id", "origin_country", "destination_country", "currency", "transaction_type", "account_age_days")


@query(
    f"WITH {TX_SQL} SELECT external_id, tx_id, amount FROM (SELECT *, row_number() OVER (PARTITION BY external_id "
    "ORDER BY created_at DESC, tx_id DESC) AS n FROM tx) WHERE n = 1"
)
def deduped_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.dedupe_transactions(transactions(spark, sf_dir)).select("external_id", "tx_id", "amount")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )


@query(
    f"WITH {FLOWS_SQL} SELECT f.tx_id, s.c_name AS sender_name, r.c_name AS receiver_name FROM flows f "
    "LEFT JOIN customer s ON f.src = s.c_custkey LEFT JOIN customer r ON f.dst = r.c_custkey"
)
def transactions_with_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = flows(spark, sf_dir).select("tx_id", F.col("src").alias("sender_id"), F.col("dst").alias("receiver_id"))
    return validate.with_parties(tx, customers(spark, sf_dir)).select("tx_id", "sender_name", "receiver_name")


RATES_SQL = (
    "rates AS (SELECT CASE n_nationkey % 2 WHEN 0 THEN 'EUR' ELSE 'GBP' END AS currency, CAST(CAST(1993 + n_nationkey AS STRING) || '-03-01' AS TIMESTAMP) "
    "AS valid_from, CAST(1.05 + n_nationkey * 0.01 AS DECIMAL(10,4)) AS rate FROM nation)"
)


@query(
    f"WITH {TX_SQL}, {RATES_SQL}, x AS (SELECT tx_id, currency, amount, ts, CASE WHEN currency = 'USD' THEN 1.0000 ELSE (SELECT max_by(rate, valid_from) "
    "FROM rates r WHERE r.currency = tx.currency AND r.valid_from <= tx.ts) END AS rate FROM tx) "
    "SELECT tx_id, currency, CAST(amount * rate AS DECIMAL(20,4)) AS amount_usd FROM x"
)
def amounts_in_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rates = nation.selectExpr(
        "CASE n_nationkey % 2 WHEN 0 THEN 'EUR' ELSE 'GBP' END AS currency",
        "CAST(CAST(1993 + n_nationkey AS STRING) || '-03-01' AS TIMESTAMP) AS valid_from",
        "CAST(1.05 + n_nationkey * 0.01 AS DECIMAL(10,4)) AS rate",
    )
    return validate.to_usd(transactions(spark, sf_dir), rates).select("tx_id", "currency", "amount_usd")


# ---- 24-hour windows -------------------------------------------------------


def velocity_sql(both: bool) -> str:
    upper = "86399999999 FOLLOWING" if both else "CURRENT ROW"
    return f"""vel AS (SELECT *, count(*) OVER w - 1 AS recent_count, count(*) OVER w AS transactions_in_24h, sum(amount) OVER w AS daily_volume,
  avg(CAST(amount AS DOUBLE)) OVER w AS mean_amount, stddev_samp(CAST(amount AS DOUBLE)) OVER w AS sd_amount, min(amount) OVER w AS min_amount,
  max(amount) OVER w AS max_amount FROM pay WINDOW w AS (PARTITION BY customer_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND {upper}))"""


VELOCITY = (
    "tx_id, recent_count, transactions_in_24h, CAST(daily_volume AS DECIMAL(28,2)) AS daily_volume, CAST(round(mean_amount, 4) AS DECIMAL(28,4)) AS mean_amount, "
    "CAST(round(sd_amount, 3) AS DECIMAL(28,3)) AS sd_amount, min_amount, max_amount"
)


@query(f"WITH {PAY_SQL}, {velocity_sql(False)} SELECT {VELOCITY} FROM vel")
def velocity_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return velocity.velocity_24h(payments(spark, sf_dir)).selectExpr(*split_columns(VELOCITY))


@query(f"WITH {PAY_SQL}, {velocity_sql(True)} SELECT {VELOCITY} FROM vel")
def velocity_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return velocity.velocity_24h(payments(spark, sf_dir), "both").selectExpr(*split_columns(VELOCITY))


def split_columns(text: str) -> list[str]:
    """The expressions of a select list."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


BEHAVIOR = (
    ("POTENTIAL_STRUCTURING", "amount >= 9000 AND amount < 10000", 20),
    ("HIGH_VELOCITY", "recent_count >= 9", 15),
    ("DAILY_LIMIT_EXCEEDED", "daily_volume > 50000", 15),
    ("UNIFORM_TRANSACTION_PATTERN", "transactions_in_24h >= 3 AND mean_amount > 0 AND sd_amount / mean_amount < 0.1", 15),
    ("STRUCTURING_PATTERN", "transactions_in_24h >= 3 AND min_amount >= 9000 AND max_amount < 10000", 30),
    ("NEW_ACCOUNT_HIGH_VALUE", "account_age_days < 30 AND amount > 10000", 20),
    ("NEW_ACCOUNT_HIGH_VELOCITY", "account_age_days < 30 AND recent_count >= 3", 15),
    ("ROUND_AMOUNT", "amount >= 10000 AND amount % 1000 = 0", 5),
)


def listed(items: tuple[tuple[str, str, int], ...], also: str = "true") -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {also} AND {p} THEN '{c}' END" for c, p, _ in items) + ")"


def points(items: tuple[tuple[str, str, int], ...]) -> str:
    return "least(50, " + " + ".join(f"CASE WHEN {p} THEN {n} ELSE 0 END" for _, p, n in items) + ")"


@query(f"WITH {PAY_SQL}, {velocity_sql(False)} SELECT tx_id, {listed(BEHAVIOR)} AS factors, {points(BEHAVIOR)}::INT AS score FROM vel")
def behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = detectors.behavioral_risk(velocity.velocity_24h(payments(spark, sf_dir)))
    return df.select("tx_id", joined("behavior_factors").alias("factors"), F.col("behavior_score").alias("score"))


# ---- detectors -------------------------------------------------------------

LISTS_SQL = f"""{TX_SQL},
txl AS (SELECT *, list_filter(string_split(via, ','), lambda x: x <> '') AS via_list, list_filter(string_split(party_list, '|'), lambda x: x <> '') AS parties FROM tx),
places AS (SELECT tx_id, unnest(range(len(c))) AS nth, unnest(c) AS country, unnest(r) AS role FROM (SELECT tx_id,
  list_concat(list_filter([coalesce(origin_country, ''), coalesce(destination_country, '')], lambda x: x <> ''), via_list) AS c,
  list_concat(CASE WHEN coalesce(origin_country, '') <> '' THEN ['origin'] ELSE [] END, ['destination'], list_transform(via_list, lambda x: 'intermediate')) AS r FROM txl)),
judged AS (SELECT *, CASE WHEN upper(country) IN {in_list(DEFAULTS.high_risk)} THEN 'HIGH_RISK' WHEN upper(country) IN {in_list(DEFAULTS.tax_havens)}
  THEN 'TAX_HAVEN' WHEN upper(country) IN {in_list(DEFAULTS.grey_list)} THEN 'GREY_LIST' END AS risk_type FROM places),
rated AS (SELECT *, CASE risk_type WHEN 'HIGH_RISK' THEN 25 WHEN 'TAX_HAVEN' THEN 15 WHEN 'GREY_LIST' THEN 10 ELSE 0 END AS points FROM judged),
geo0 AS (SELECT tx_id, count(*) AS n, sum(points) AS points, count(*) FILTER (country IN {in_list(DEFAULTS.tax_havens)}) AS havens,
  coalesce(string_agg(CASE risk_type WHEN 'HIGH_RISK' THEN 'HIGH_RISK_JURISDICTION' ELSE risk_type END || '_' || upper(country), ',' ORDER BY nth)
  FILTER (risk_type IS NOT NULL), '') AS codes FROM rated GROUP BY tx_id),
geo AS (SELECT t.tx_id, concat_ws(',', nullif(codes, ''), CASE WHEN len(via_list) >= 2 THEN 'COMPLEX_ROUTING' END, CASE WHEN havens >= 2 THEN 'TAX_HAVEN_CHAIN' END) AS geo_factors,
  least(50, points + CASE WHEN len(via_list) >= 2 THEN 10 ELSE 0 END + CASE WHEN havens >= 2 THEN 20 ELSE 0 END)::INT AS geo_score, n AS jurisdictions
  FROM txl t JOIN geo0 USING (tx_id))"""


@query(
    f"WITH {LISTS_SQL}, listed AS (SELECT tx_id, max(havens) AS havens, "
    "string_agg('HIGH_RISK_JURISDICTION: ' || upper(country) || ' (' || role || ')', '|' ORDER BY nth) FILTER (risk_type = 'HIGH_RISK') AS alerts, "
    "coalesce(string_agg(concat_ws(':', role, upper(country), risk_type, rated.points), '|' ORDER BY nth) FILTER (risk_type IS NOT NULL), '') AS details "
    "FROM rated JOIN geo0 USING (tx_id) GROUP BY tx_id) SELECT tx_id, geo_factors AS factors, "
    "concat_ws('|', alerts, CASE WHEN havens >= 2 THEN 'Multiple tax havens in transaction path' END) AS alerts, details, "
    "geo_score AS score, jurisdictions::INT AS jurisdictions FROM geo JOIN listed USING (tx_id)"
)
def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = detectors.geographic_risk(transactions(spark, sf_dir))
    details = F.transform("geo_details", lambda d: F.concat_ws(":", d["role"], d["country"], d["risk_type"], d["points"].cast("string")))
    return df.select(
        "tx_id", joined("geo_factors").alias("factors"), F.array_join("geo_alerts", "|").alias("alerts"), F.array_join(details, "|").alias("details"),
        F.col("geo_score").alias("score"), F.col("jurisdictions_analyzed").alias("jurisdictions"),
    )


@query(
    f"WITH {LISTS_SQL} SELECT tx_id, (row_number() OVER (PARTITION BY tx_id ORDER BY nth) - 1)::INT AS nth, role, upper(country) AS country, "
    "risk_type, points::INT AS points FROM rated WHERE risk_type IS NOT NULL"
)
def jurisdiction_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.jurisdiction_exposure(transactions(spark, sf_dir))


CRYPTO = (
    ("CRYPTO_MIXER_DETECTED", "mixer_used", 35),
    ("DARKNET_MARKET_ASSOCIATION", f"coalesce({any_word('lower(darknet_market)', fixed.DARKNET_MARKETS)}, false)", 40),
    ("NEW_CRYPTO_WALLET", "coalesce(wallet_age_days, 365) < 7", 15),
    ("RECENT_CRYPTO_WALLET", "coalesce(wallet_age_days, 365) BETWEEN 7 AND 29", 10),
    ("CRYPTO_LAYERING_PATTERN", "cross_chain_swaps >= 3", 20),
    ("CROSS_CHAIN_ACTIVITY", "cross_chain_swaps BETWEEN 1 AND 2", 10),
    ("PRIVACY_COIN_USAGE", "privacy_coin", 25),
    ("HIGH_VALUE_CRYPTO", "amount > 100000", 10),
)
IS_CRYPTO = "(coalesce(asset_type = 'CRYPTO', false) OR transaction_type = 'CRYPTO')"


@query(f"WITH {TX_SQL} SELECT tx_id, {listed(CRYPTO, IS_CRYPTO)} AS factors, CASE WHEN {IS_CRYPTO} THEN {points(CRYPTO)} END::INT AS score FROM tx")
def crypto(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = detectors.crypto_risk(transactions(spark, sf_dir))
    return df.select("tx_id", joined("crypto_factors").alias("factors"), F.col("crypto_score").alias("score"))


HITS_SQL = f"""list AS (SELECT unnest(range({len(fixed.WATCHED_ENTITIES)})) AS position, unnest([{", ".join(f"'{w}'" for w in fixed.WATCHED_ENTITIES)}]) AS entry),
party AS (SELECT tx_id, origin_country, unnest(range(len(parties))) AS nth, unnest(parties) AS party FROM txl),
hit0 AS (SELECT tx_id, nth, party, entry, row_number() OVER (PARTITION BY tx_id, nth ORDER BY position) AS k FROM party, list
  WHERE contains(lower(party), entry) OR contains(entry, lower(party))),
hits AS (SELECT tx_id, nth, party, entry, CASE WHEN entry = lower(party) THEN 'EXACT' ELSE 'PARTIAL' END AS match_type,
  CASE WHEN entry = lower(party) THEN 0.95 ELSE 0.75 END::DOUBLE AS confidence FROM hit0 WHERE k = 1),
chits AS (SELECT tx_id, nth, party, NULL::VARCHAR AS entry, 'JURISDICTION' AS match_type, 0.8::DOUBLE AS confidence FROM party
  WHERE origin_country IN {in_list(fixed.SANCTIONED_ORIGINS)} AND {any_word("lower(party)", fixed.SANCTIONED_ORIGIN_WORDS)})"""


@query(f"WITH {LISTS_SQL}, {HITS_SQL} SELECT tx_id, nth::INT AS nth, party, entry, match_type, confidence FROM hits")
def sanctions_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.sanctions_screen(transactions(spark, sf_dir), screening.watched(spark))


#: A list as long as the table of parts, with aliases, and parties that hold an entry, are part of one, are one, or are neither.
LONG_LIST = {
    "entry_id": "(p_partkey * 7919) % 1000003", "name": "concat(p_name, ' ', CAST((p_partkey * 7919) % 100003 AS STRING))",
    "alias": "CASE WHEN p_partkey % 3 = 0 THEN concat(upper(p_brand), '-', CAST(p_partkey AS STRING)) END",
}
LONG_PARTY = (
    "CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN concat('The ', p_name, ' ', CAST((p_partkey * 7919) % 100003 AS STRING), ' Ltd') WHEN 1 THEN substr(p_name, 2, 6) "
    "WHEN 2 THEN concat(p_name, ' ', CAST((p_partkey * 7919) % 100003 AS STRING)) WHEN 3 THEN concat('via ', p_brand, '-', CAST(p_partkey AS STRING)) "
    "WHEN 4 THEN concat(CAST(p_partkey % 1000 AS STRING), '') WHEN 5 THEN '' ELSE concat('nobody ', CAST(l_orderkey AS STRING)) END"
)
LONG_HITS_SQL = f"""wl AS (SELECT {", ".join(f"{e} AS {n}" for n, e in LONG_LIST.items())} FROM part),
list AS (SELECT entry_id AS position, lower(name) AS entry FROM wl UNION ALL SELECT entry_id, lower(alias) FROM wl WHERE alias IS NOT NULL),
party AS (SELECT l_orderkey * 10 + l_linenumber AS tx_id, {LONG_PARTY} AS party FROM lineitem JOIN part ON l_partkey = p_partkey),
names AS (SELECT DISTINCT lower(party) AS name FROM party),
first AS (SELECT name, min_by(entry, (position, entry)) AS entry FROM names JOIN list ON contains(name, entry) OR contains(entry, name) GROUP BY name)"""


@query(
    f"WITH {LONG_HITS_SQL} SELECT tx_id, 0 AS nth, party, entry, CASE WHEN entry = name THEN 'EXACT' ELSE 'PARTIAL' END AS match_type, "
    "CASE WHEN entry = name THEN 0.95 ELSE 0.75 END::DOUBLE AS confidence FROM party JOIN first ON lower(party) = name"
)
def sanctions_hits_long_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    entries = part.selectExpr(*(f"{e} AS {n}" for n, e in LONG_LIST.items())).select("entry_id", "name", F.array_compact(F.array("alias")).alias("aliases"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(part, F.col("l_partkey") == F.col("p_partkey"))
    tx = lines.selectExpr("l_orderkey * 10 + l_linenumber AS tx_id", f"array({LONG_PARTY}) AS parties")
    return screening.sanctions_screen(tx, screening.list_entries(entries))


@query(f"WITH {LISTS_SQL}, {HITS_SQL} SELECT tx_id, nth::INT AS nth, party, match_type, confidence FROM chits")
def country_sanctions_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.country_sanctions_screen(transactions(spark, sf_dir)).drop("entry")


PEP_LIST = "concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(customer_name), '{w}') THEN '{w}' END" for w in fixed.PEP_WORDS) + ")"


@query(f"WITH {TX_SQL} SELECT tx_id, {PEP_LIST} AS terms, {PEP_LIST} <> '' AS pep_status, CASE WHEN {PEP_LIST} <> '' THEN 0.7 END::DOUBLE AS confidence FROM tx")
def pep(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = detectors.pep_screen(transactions(spark, sf_dir))
    return df.select("tx_id", joined("pep_terms").alias("terms"), "pep_status", F.col("pep_confidence").alias("confidence"))


@query(f"WITH {TX_SQL} SELECT tx_id, CASE WHEN document_list = '' THEN 'NO_SUPPORTING_DOCS' ELSE '' END AS factors, "
       "CASE WHEN document_list = '' THEN 'MISSING_DOCUMENTATION' ELSE '' END AS alerts FROM tx")  # fmt: skip
def missing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = detectors.document_check(transactions(spark, sf_dir))
    return df.select("tx_id", joined("document_factors").alias("factors"), joined("document_alerts").alias("alerts"))


# ---- the pipeline ----------------------------------------------------------

WEIGHT = "CASE " + " ".join(f"WHEN contains(upper(f), '{n}') THEN {p}" for n, p in fixed.FACTOR_WEIGHTS) + " ELSE 0 END"
ASSESS_SQL = f"""{LISTS_SQL}, {HITS_SQL},
vel AS (SELECT *, count(*) OVER w - 1 AS recent_count, count(*) OVER w AS transactions_in_24h, sum(amount) OVER w AS daily_volume,
  avg(CAST(amount AS DOUBLE)) OVER w AS mean_amount, stddev_samp(CAST(amount AS DOUBLE)) OVER w AS sd_amount, min(amount) OVER w AS min_amount,
  max(amount) OVER w AS max_amount FROM txl WINDOW w AS (PARTITION BY customer_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)),
h AS (SELECT tx_id, count(*) AS n_hits, string_agg(party, ',' ORDER BY nth, late) AS hit_parties, count(*) FILTER (late = 0) AS n_list
  FROM (SELECT tx_id, nth, party, 0 AS late FROM hits UNION ALL SELECT tx_id, nth, party, 1 AS late FROM chits) GROUP BY tx_id),
det AS (SELECT v.*, geo_factors, geo_score, {listed(BEHAVIOR)} AS behavior_factors, {points(BEHAVIOR)} AS behavior_score, {listed(CRYPTO, IS_CRYPTO)} AS crypto_factors,
  {points(CRYPTO)} AS crypto_points, {PEP_LIST} <> '' AS is_pep, coalesce(n_hits, 0) AS n_hits, coalesce(hit_parties, '') AS hit_parties
  FROM vel v JOIN geo USING (tx_id) LEFT JOIN h USING (tx_id)),
r0 AS (SELECT *, CASE WHEN {IS_CRYPTO} THEN 'CRYPTO_PATH' WHEN amount > 100000 THEN 'LARGE_TRANSACTION' WHEN account_age_days < 30 AND amount > 10000
  THEN 'NEW_ACCOUNT_ALERT' ELSE 'STANDARD_FLOW' END AS entry_route FROM det),
r1 AS (SELECT *, entry_route = 'CRYPTO_PATH' AND regexp_matches(crypto_factors, 'CRYPTO|DARKNET|MIXER') AS risky FROM r0),
r2 AS (SELECT *, entry_route = 'STANDARD_FLOW' OR (entry_route = 'CRYPTO_PATH' AND NOT risky) AS std FROM r1),
r3 AS (SELECT *, (std OR entry_route = 'LARGE_TRANSACTION') AS sanc, (std OR entry_route = 'LARGE_TRANSACTION') AND n_hits > 0 AS stopped FROM r2),
r4 AS (SELECT *, sanc AND n_hits = 0 AND is_pep AS pep_status FROM r3),
r5 AS (SELECT *, concat_ws(',', CASE WHEN entry_route = 'CRYPTO_PATH' THEN nullif(crypto_factors, '') END, CASE WHEN std THEN nullif(geo_factors, '') END,
  CASE WHEN std THEN nullif(behavior_factors, '') END, CASE WHEN std AND document_list = '' THEN 'NO_SUPPORTING_DOCS' END,
  CASE WHEN stopped THEN 'SANCTIONS_HIT' END, CASE WHEN pep_status THEN 'PEP_MATCH' END) AS risk_factors FROM r4),
r6 AS (SELECT *, coalesce(list_sum(list_transform(CASE WHEN risk_factors = '' THEN [] ELSE string_split(risk_factors, ',') END, lambda f: {WEIGHT})), 0)
  + CASE WHEN pep_status THEN 25 ELSE 0 END + CASE WHEN std THEN least(30, geo_score) + least(30, behavior_score) ELSE 0 END
  + CASE WHEN entry_route = 'CRYPTO_PATH' THEN least(30, crypto_points) ELSE 0 END AS raw FROM r5),
assessed AS (SELECT *, CASE WHEN stopped THEN 0 ELSE least(100, raw) END::INT AS risk_score, CASE WHEN sanc THEN hit_parties ELSE '' END AS sanction_parties,
  CASE WHEN stopped THEN 'LOW' WHEN raw >= 95 THEN 'CRITICAL' WHEN raw >= 80 THEN 'HIGH' WHEN raw >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  NOT stopped AND (raw >= 80 OR (pep_status AND raw >= 60)) AS sar_required,
  CASE WHEN stopped OR raw >= 80 THEN 'SAR_GENERATED' WHEN raw >= 60 THEN 'PENDING_REVIEW' ELSE 'CLEARED' END AS reporting_status FROM r6)"""


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The windows first, on the tables' short rows.
    return assess(transactions_after(spark, sf_dir, velocity.windows_24h), screening.watched(spark), as_of=AS_OF)


@query(f"WITH {ASSESS_SQL} SELECT tx_id, entry_route, risk_factors, risk_score, risk_level, sar_required, reporting_status, pep_status, sanction_parties FROM assessed")
def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).select(
        "tx_id", "entry_route", joined("risk_factors").alias("risk_factors"), "risk_score", "risk_level", "sar_required", "reporting_status", "pep_status",
        F.array_join(F.transform("sanction_hits", lambda h: h["party"]), ",").alias("sanction_parties"),
    )


@query(
    f"WITH {ASSESS_SQL} SELECT tx_id, concat_ws(',', concat('initial:', entry_route), CASE WHEN entry_route = 'CRYPTO_PATH' THEN CASE WHEN risky THEN "
    "'crypto:HIGH_RISK' ELSE 'crypto:NORMAL' END END, CASE WHEN sanc THEN CASE WHEN stopped THEN 'sanctions:HIT_FOUND' ELSE 'sanctions:CLEAR' END END, "
    "CASE WHEN sanc AND NOT stopped THEN CASE WHEN pep_status THEN 'pep:PEP_FOUND' ELSE 'pep:NO_PEP' END END, CASE WHEN NOT stopped THEN CASE WHEN raw >= 95 "
    "THEN 'final:CRITICAL_SAR' WHEN raw >= 80 THEN 'final:HIGH_RISK_SAR' WHEN raw >= 60 THEN 'final:MEDIUM_REVIEW' ELSE 'final:LOW_RISK_CLEAR' END END) AS decisions, "
    "CASE WHEN reporting_status = 'PENDING_REVIEW' THEN '1999-06-16 12:00:00' END AS review_deadline, concat_ws(',', 'initial_screening', "
    "CASE WHEN entry_route = 'CRYPTO_PATH' THEN 'crypto_risk' END, CASE WHEN std THEN 'geographic_risk,behavioral_analysis,document_analysis' END, "
    "CASE WHEN sanc THEN 'sanctions_screening' END, CASE WHEN sanc AND NOT stopped THEN 'pep_screening' END, "
    "CASE WHEN (entry_route = 'CRYPTO_PATH' AND risky) OR entry_route = 'NEW_ACCOUNT_ALERT' OR pep_status THEN 'enhanced_due_diligence' END, "
    "CASE WHEN NOT stopped THEN 'risk_scoring' END, CASE reporting_status WHEN 'SAR_GENERATED' THEN 'sar_generation' WHEN 'PENDING_REVIEW' THEN 'human_review' "
    "ELSE 'case_cleared' END) AS path FROM assessed"
)
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).select(
        "tx_id", joined("routing_decisions").alias("decisions"), F.date_format("review_deadline", "yyyy-MM-dd HH:mm:ss").alias("review_deadline"),
        joined("decision_path").alias("path"),
    )


FACTOR_ROWS_SQL = f"""{ASSESS_SQL}, fr AS (SELECT tx_id, unnest(range(len(l))) AS nth, unnest(l) AS code FROM (SELECT tx_id, string_split(risk_factors, ',') AS l
  FROM assessed WHERE risk_factors <> ''))"""


@query(
    f"WITH {FACTOR_ROWS_SQL} SELECT tx_id, nth::INT AS nth, code, CASE WHEN regexp_matches(code, 'SANCTION|DARKNET|CRITICAL') THEN 'CRITICAL' WHEN "
    "regexp_matches(code, 'HIGH_RISK|MIXER|PEP') THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN regexp_matches(code, 'SANCTION|DARKNET|CRITICAL') THEN 40 "
    "WHEN regexp_matches(code, 'HIGH_RISK|MIXER|PEP') THEN 25 WHEN regexp_matches(code, 'TAX_HAVEN|STRUCTURING') THEN 15 ELSE 10 END AS score, CASE WHEN "
    "contains(code, 'SANCTION') THEN 'SANCTIONS' WHEN contains(code, 'PEP') THEN 'PEP' WHEN contains(code, 'CRYPTO') THEN 'CRYPTO' WHEN regexp_matches(code, "
    "'GEO|JURISDICTION') THEN 'GEOGRAPHIC' WHEN regexp_matches(code, 'STRUCT|VELOCITY') THEN 'BEHAVIORAL' WHEN regexp_matches(code, 'DOC|TBML') THEN "
    "'DOCUMENTATION' ELSE 'GENERAL' END AS category, array_to_string(list_transform(string_split(code, '_'), lambda w: upper(left(w, 1)) || lower(w[2:])), ' ') "
    "AS description FROM fr"
)
def factor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.enrich_factors(assessed(spark, sf_dir))


DOLLARS = "concat('$', format('{{:,.2f}}', CAST({} AS DOUBLE)))".format
#: Each alert: its place among a transaction's alerts, its text, and when it is raised.
ALERTS = (
    (10, "'Cryptocurrency mixing service detected'", "entry_route = 'CRYPTO_PATH' AND mixer_used"),
    (11, "concat('Darknet market association: ', darknet_market)", f"entry_route = 'CRYPTO_PATH' AND {CRYPTO[1][1]}"),
    (12, "concat(cross_chain_swaps, ' cross-chain swaps detected')", "entry_route = 'CRYPTO_PATH' AND cross_chain_swaps >= 3"),
    (13, "'Privacy coin conversion detected'", "entry_route = 'CRYPTO_PATH' AND privacy_coin"),
    (21, "'Multiple tax havens in transaction path'", "std AND contains(geo_factors, 'TAX_HAVEN_CHAIN')"),
    (30, f"concat('Transaction amount ', {DOLLARS('amount')}, ' just below $10,000 threshold')", f"std AND {BEHAVIOR[0][1]}"),
    (31, "concat(transactions_in_24h, ' transactions in 24 hours')", f"std AND {BEHAVIOR[1][1]}"),
    (32, f"concat('Daily volume ', {DOLLARS('daily_volume')}, ' exceeds threshold')", f"std AND {BEHAVIOR[2][1]}"),
    (33, "'Multiple transactions just below $10,000 threshold'", f"std AND {BEHAVIOR[4][1]}"),
    (34, "concat('High-value transaction on ', account_age_days, '-day-old account')", f"std AND {BEHAVIOR[5][1]}"),
    (40, "'MISSING_DOCUMENTATION'", "std AND document_list = ''"),
    (60, f"concat('PEP indicator: Customer name contains ', chr(39), replace({PEP_LIST}, ',', ', '), chr(39))", "pep_status"),
)
ALERT_ROWS_SQL = f"""{ASSESS_SQL}, al AS ({" UNION ALL ".join(f"SELECT tx_id, {k} AS a, 0 AS b, {t} AS description FROM assessed WHERE {c}" for k, t, c in ALERTS)}
  UNION ALL SELECT j.tx_id, 20, j.nth, concat('HIGH_RISK_JURISDICTION: ', upper(j.country), ' (', j.role, ')') FROM judged j JOIN assessed s ON j.tx_id = s.tx_id
    WHERE s.std AND j.risk_type = 'HIGH_RISK'
  UNION ALL SELECT j.tx_id, 50, j.nth, concat('SANCTIONS HIT: ', j.party, ' matched against OFAC SDN list') FROM hits j JOIN assessed s ON j.tx_id = s.tx_id WHERE s.sanc),
typed AS (SELECT *, CASE {" ".join(f"WHEN {any_word('upper(description)', w)} THEN '{n}'" for w, n in results.ALERT_TYPES)} ELSE 'UNUSUAL_ACTIVITY' END AS alert_type FROM al)"""


@query(f"WITH {ALERT_ROWS_SQL} SELECT alert_type, count(*) AS n FROM typed GROUP BY 1")
def alert_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.classify_alerts(assessed(spark, sf_dir)).groupBy("alert_type").agg(F.count("*").alias("n"))


@query(
    f"WITH {ALERT_ROWS_SQL} SELECT tx_id, (row_number() OVER (PARTITION BY tx_id ORDER BY a, b) - 1)::INT AS nth, alert_type, "
    f"CASE alert_type {' '.join(f"WHEN '{n}' THEN '{s}'" for n, s in results.ALERT_SEVERITY.items())} ELSE 'MEDIUM' END AS severity, left(description, 100) AS title, "
    "description, array_to_string(list_slice(string_split(risk_factors, ','), 1, 3), ',') AS risk_factors, 0.8::DOUBLE AS confidence "
    "FROM typed JOIN (SELECT tx_id, risk_factors FROM assessed) USING (tx_id)"
)
def alert_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.classify_alerts(assessed(spark, sf_dir)).withColumn("risk_factors", joined("risk_factors"))


@query(
    f"WITH {ASSESS_SQL} SELECT tx_id, CASE WHEN sanction_parties <> '' THEN 'BLOCK_AND_FILE_SAR' WHEN risk_score >= 95 THEN 'FILE_SAR_IMMEDIATELY' WHEN "
    "risk_score >= 80 THEN 'FILE_SAR' WHEN risk_score >= 60 THEN 'ESCALATE_FOR_REVIEW' WHEN risk_score >= 30 THEN 'MONITOR' ELSE 'CLEAR' END AS recommended_action, "
    "risk_score >= 60 AS action_required, CASE WHEN sanction_parties <> '' THEN 'Block transaction immediately' WHEN sar_required THEN "
    "'Review generated SAR narrative' WHEN pep_status THEN 'Conduct enhanced due diligence' WHEN risk_score >= 60 THEN 'Assign to compliance analyst' "
    "ELSE 'No immediate action required' END AS first_step, "
    f"CASE WHEN sanction_parties <> '' THEN {quoted(results.NEXT_STEPS['hits'])} WHEN sar_required THEN {quoted(results.NEXT_STEPS['sar'])} "
    f"WHEN pep_status THEN {quoted(results.NEXT_STEPS['pep'])} WHEN risk_score >= 60 THEN {quoted(results.NEXT_STEPS['medium'])} "
    f"ELSE {quoted(results.NEXT_STEPS['none'])} END AS steps FROM assessed"
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = results.recommend(assessed(spark, sf_dir))
    steps = F.array_join("next_steps", "; ").alias("steps")
    return df.select("tx_id", "recommended_action", "action_required", F.get("next_steps", F.lit(0)).alias("first_step"), steps)


@query(
    f"WITH {ASSESS_SQL} SELECT tx_id, concat('CASE-', upper(left(sha256(concat('case|', CAST(tx_id AS STRING))), 8))) AS case_number, "
    "concat('Suspicious Activity - Risk Score ', risk_score) AS title, CASE WHEN reporting_status = 'SAR_GENERATED' THEN 'SAR_FILED' ELSE 'OPEN' END AS status, "
    "risk_level AS priority, reporting_status = 'SAR_GENERATED' AS sar_filed, '1999-07-15 12:00:00' AS sar_deadline FROM assessed WHERE sar_required"
)
def opened_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = results.open_cases(assessed(spark, sf_dir), AS_OF)
    return df.select("tx_id", "case_number", "title", "status", "priority", "sar_filed", F.date_format("sar_deadline", "yyyy-MM-dd HH:mm:ss").alias("sar_deadline"))


@query(
    f"WITH {ASSESS_SQL} SELECT count(*) AS total, count(*) FILTER (risk_level IN ('HIGH', 'CRITICAL')) AS high_risk, count(*) FILTER (sar_required) AS sar_required, "
    "round(coalesce(sum(risk_score) / count(*), 0), 4) AS average_score FROM assessed"
)
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.batch_summary(assessed(spark, sf_dir))


@query(
    f"WITH {ALERT_ROWS_SQL}, told AS (SELECT tx_id, string_agg(description, ', ' ORDER BY a, b) AS texts FROM al GROUP BY tx_id) SELECT concat('SAR-', upper(left(sha256(concat(CAST(tx_id AS STRING), '|{AS_OF}')), 12))) AS sar_id, tx_id, "
    "concat('Transaction Amount: $', format('{:,.2f}', CAST(amount AS DOUBLE)), chr(10), 'Origin: ', coalesce(origin_country, 'Unknown'), chr(10), 'Destination: ', "
    "destination_country, chr(10), 'Risk Score: ', risk_score, '/100', chr(10), 'Risk Level: ', risk_level) AS case_summary, "
    "concat('Customer Name: ', customer_name, chr(10), 'Account Age: ', account_age_days, ' days') AS subject_info, "
    "concat('Risk Factors: ', replace(risk_factors, ',', ', '), chr(10), 'Alerts: ', coalesce(texts, ''), chr(10), 'PEP Status: ', pep_status, chr(10), "
    "'Sanctions Hits: ', replace(sanction_parties, ',', ', ')) AS activity_details FROM assessed LEFT JOIN told USING (tx_id) WHERE reporting_status = 'SAR_GENERATED'"
)
def sar_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.sar_report(assessed(spark, sf_dir), AS_OF)


@query(
    f"WITH {ASSESS_SQL}, cf AS (SELECT customer_id, string_agg(DISTINCT f, ',' ORDER BY f) AS factors FROM (SELECT customer_id, unnest(string_split(risk_factors, ',')) AS f "
    "FROM assessed WHERE risk_factors <> '') GROUP BY customer_id), pr AS (SELECT customer_id, max(risk_score) AS overall_score, list_extract(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], max(CASE risk_level WHEN 'LOW' "
    "THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END)) AS overall_level, max(CASE WHEN std THEN geo_score END)::INT AS max_geo_score, "
    "max(CASE WHEN std THEN behavior_score END)::INT AS max_behavior_score, max(CASE WHEN entry_route = 'CRYPTO_PATH' THEN crypto_points END)::INT AS max_crypto_score, "
    "max(transactions_in_24h) AS peak_count, CAST(max(daily_volume) AS DECIMAL(28,4)) AS peak_volume, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_assessed "
    "FROM assessed GROUP BY customer_id) SELECT pr.*, coalesce(factors, '') AS factors, strftime(DATE '1999-06-15' + CASE overall_level WHEN 'LOW' THEN 90 "
    "WHEN 'MEDIUM' THEN 30 WHEN 'HIGH' THEN 7 ELSE 1 END, '%Y-%m-%d') AS next_review FROM pr LEFT JOIN cf USING (customer_id)"
)
def risk_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dashboard.customer_risk_profiles(assessed(spark, sf_dir), AS_OF)
    return df.select(
        "customer_id", "overall_score", "overall_level", "max_geo_score", "max_behavior_score", "max_crypto_score",
        F.col("velocity")["peak_count_24h"].cast("long").alias("peak_count"), F.col("velocity")["peak_volume_24h"].cast("decimal(28,4)").alias("peak_volume"),
        F.date_format("last_assessed", "yyyy-MM-dd HH:mm:ss").alias("last_assessed"), joined("risk_factors").alias("factors"),
        F.date_format("next_review", "yyyy-MM-dd").alias("next_review"),
    )


@query(
    f"WITH {ASSESS_SQL} SELECT count(*) FILTER (risk_level = 'LOW') AS low, count(*) FILTER (risk_level = 'MEDIUM') AS medium, "
    "count(*) FILTER (risk_level = 'HIGH') AS high, count(*) FILTER (risk_level = 'CRITICAL') AS critical FROM assessed"
)
def risk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.risk_distribution(assessed(spark, sf_dir))


@query(
    f"WITH {TX_SQL}, a AS ({ALERTS_SQL}), t AS (SELECT CAST(ts AS DATE) AS day, alert_type, count(*) AS n FROM a GROUP BY 1, 2) "
    "SELECT day, sum(n)::BIGINT AS alerts, string_agg(alert_type || '=' || n, ',' ORDER BY alert_type) AS by_type FROM t GROUP BY day"
)
def alert_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_rules(spark, sf_dir)
    rows = scored.select(F.col("ts").alias("created_at"), F.explode("alerts").alias("a")).select("created_at", "a.alert_type")
    trend = dashboard.alert_trend(rows)
    text = F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return trend.withColumn("by_type", text)


# ---- fund flows, trade -----------------------------------------------------

EDGES_SQL = f"{FLOWS_SQL}, edges AS (SELECT src, dst, count(*) AS n, sum(amount) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM flows GROUP BY src, dst)"


@query(f"WITH {EDGES_SQL} SELECT src, dst, n, CAST(total AS DECIMAL(28,2)) AS total, first_ts, last_ts FROM edges")
def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.flow_edges(flows(spark, sf_dir)).withColumn("total", F.col("total").cast("decimal(28,2)"))


@query(
    f"WITH {EDGES_SQL}, e AS (SELECT dst AS account, true AS inward, total FROM edges WHERE src <> dst UNION ALL SELECT src, false, total FROM edges WHERE src <> dst), "
    "c AS (SELECT account, count(*) FILTER (inward) AS senders, coalesce(sum(total) FILTER (inward), 0) AS received, count(*) FILTER (NOT inward) AS receivers, "
    "coalesce(sum(total) FILTER (NOT inward), 0) AS sent FROM e GROUP BY account) SELECT account, senders, CAST(received AS DECIMAL(28,2)) AS received, receivers, "
    "CAST(sent AS DECIMAL(28,2)) AS sent, senders >= 15 AS funnel, receivers >= 15 AS fanout FROM c WHERE senders >= 15 OR receivers >= 15"
)
def funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = network.funnel_fanout(network.flow_edges(flows(spark, sf_dir)), 15)
    return df.withColumns({c: F.col(c).cast("decimal(28,2)") for c in ("received", "sent")})


@query(
    f"WITH {EDGES_SQL}, e AS (SELECT * FROM edges WHERE src <> dst) SELECT x.src AS a, x.dst AS b, NULL::BIGINT AS c, CAST(x.total + y.total AS DECIMAL(28,2)) AS total "
    "FROM e x JOIN e y ON x.dst = y.src AND y.dst = x.src WHERE x.src < x.dst UNION ALL SELECT x.src, x.dst, y.dst, CAST(x.total + y.total + z.total AS DECIMAL(28,2)) "
    "FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src WHERE x.src < x.dst AND x.src < y.dst AND y.dst <> x.dst"
)
def circular_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.circular_flows(network.flow_edges(flows(spark, sf_dir))).withColumn("total", F.col("total").cast("decimal(28,2)"))


@query(
    f"""WITH {EDGES_SQL}, e AS MATERIALIZED (SELECT * FROM edges WHERE src <> dst),
rings AS MATERIALIZED (SELECT x.src AS a, x.dst AS b, NULL::BIGINT AS c, x.total + y.total AS total FROM e x JOIN e y ON x.dst = y.src AND y.dst = x.src WHERE x.src < x.dst
  UNION ALL SELECT x.src, x.dst, y.dst, x.total + y.total + z.total FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src
  WHERE x.src < x.dst AND x.src < y.dst AND y.dst <> x.dst),
turns AS (SELECT *, a AS p, b AS q, coalesce(c, a) AS r FROM rings UNION ALL SELECT *, b, coalesce(c, a), CASE WHEN c IS NULL THEN b ELSE a END FROM rings
  UNION ALL SELECT *, c, a, b FROM rings WHERE c IS NOT NULL),
legs AS MATERIALIZED (SELECT src, dst, ts FROM flows WHERE (src, dst) IN (SELECT (q, r) FROM turns UNION SELECT (r, p) FROM turns)),
one AS MATERIALIZED (SELECT t.*, e.first_ts AS t1 FROM turns t JOIN e ON e.src = t.p AND e.dst = t.q),
two AS MATERIALIZED (SELECT o.a, o.b, o.c, o.total, o.p, o.r, o.t1, min(f.ts) AS t2 FROM one o JOIN legs f ON f.src = o.q AND f.dst = o.r WHERE f.ts >= o.t1 GROUP BY ALL),
three AS (SELECT w.a, w.b, w.c, w.total, w.p, w.t1, min(f.ts) AS t3 FROM two w JOIN legs f ON f.src = w.r AND f.dst = w.p WHERE f.ts >= w.t2 AND w.c IS NOT NULL GROUP BY ALL
  UNION ALL SELECT a, b, c, total, p, t1, t2 FROM two WHERE c IS NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY t3, p) AS k FROM three)
SELECT a, b, c, CAST(total AS DECIMAL(28,2)) AS total, p AS start, t1 AS first_ts, t3 AS last_ts FROM best WHERE k = 1"""
)
def circular_flows_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.cycles_in_time(flows(spark, sf_dir)).withColumn("total", F.col("total").cast("decimal(28,2)"))


@query(
    f"WITH {FLOWS_SQL} SELECT i.tx_id AS in_id, o.tx_id AS out_id, i.src AS origin, i.dst AS account, o.dst AS target, i.amount AS in_amount, o.amount AS out_amount "
    "FROM flows i JOIN flows o ON i.dst = o.src WHERE epoch_us(o.ts) - epoch_us(i.ts) > 0 AND epoch_us(o.ts) - epoch_us(i.ts) <= 172800000000 "
    "AND abs(o.amount - i.amount) <= i.amount * CAST(0.05 AS DECIMAL(10,4)) AND i.tx_id <> o.tx_id"
)
def layering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.layering_chains(flows(spark, sf_dir), hours=48, tolerance=0.05)


@query(
    f"""WITH RECURSIVE {FLOWS_SQL}, pair AS MATERIALIZED (SELECT i.tx_id AS parent, o.tx_id AS tx_id FROM flows i JOIN flows o ON i.dst = o.src
  WHERE epoch_us(o.ts) - epoch_us(i.ts) > 0 AND epoch_us(o.ts) - epoch_us(i.ts) <= 31536000000000 AND o.amount <= i.amount
  AND i.amount - o.amount <= i.amount * CAST(0.5 AS DECIMAL(10,4)) AND i.tx_id <> o.tx_id),
walk AS (SELECT parent, tx_id, 2 AS transfers FROM pair UNION ALL SELECT p.parent, p.tx_id, w.transfers + 1 FROM walk w JOIN pair p ON w.tx_id = p.parent WHERE w.transfers < 4)
SELECT transfers, tx_id, parent, count(*)::BIGINT AS chains FROM walk GROUP BY ALL"""
)
def layering_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.layering_steps(flows(spark, sf_dir), most=4, hours=8760, tolerance=0.5, merged=True, kind="long")


@query(
    f"""WITH RECURSIVE {FLOWS_SQL}, pair AS MATERIALIZED (SELECT i.tx_id AS parent, o.tx_id AS tx_id FROM flows i JOIN flows o ON i.dst = o.src
  WHERE epoch_us(o.ts) - epoch_us(i.ts) > 0 AND epoch_us(o.ts) - epoch_us(i.ts) <= 31536000000000 AND o.amount <= i.amount
  AND i.amount - o.amount <= i.amount * CAST(0.5 AS DECIMAL(10,4)) AND i.tx_id <> o.tx_id),
walk AS (SELECT tx_id, concat(parent, '>', tx_id) AS path, 2 AS transfers FROM pair
  UNION ALL SELECT p.tx_id, concat(w.path, '>', p.tx_id), w.transfers + 1 FROM walk w JOIN pair p ON w.tx_id = p.parent WHERE w.transfers < 3)
SELECT path FROM walk WHERE transfers = 3"""
)
def layering_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = network.chains_listed(flows(spark, sf_dir), 3, hours=8760, tolerance=0.5)
    return paths.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(
    f"""WITH {FLOWS_SQL}, e AS (SELECT dst AS account, true AS inward, src AS other, CAST(ts AS DATE) AS seen FROM flows WHERE src <> dst
  UNION ALL SELECT src, false, dst, CAST(ts AS DATE) FROM flows WHERE src <> dst),
d AS (SELECT DISTINCT account, inward, seen AS day FROM e),
n AS (SELECT d.account, d.inward, d.day, count(DISTINCT e.other) AS others FROM d JOIN e ON d.account = e.account AND d.inward = e.inward
  AND e.seen BETWEEN d.day - 364 AND d.day GROUP BY ALL)
SELECT account, day, bool_or(inward) AS funnel, bool_or(NOT inward) AS fanout FROM n WHERE others >= 8 GROUP BY account, day"""
)
def rolling_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.rolling_funnels(flows(spark, sf_dir), k=8, days=365)


@query(
    f"WITH RECURSIVE {LINKS_SQL}, e AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links), walk AS (SELECT DISTINCT a AS account, a AS c FROM e "
    "UNION SELECT e.b, w.c FROM walk w JOIN e ON w.account = e.a) SELECT account, min(c) AS cluster FROM walk GROUP BY account"
)
def clusters_in_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [links(spark, sf_dir).where(F.pmod(F.xxhash64("src", "dst"), F.lit(3)) == n) for n in range(3)]
    found = network.entity_clusters(parts[0])
    for part in parts[1:]:
        found = network.extend_clusters(found, part)
    return found


@query(
    f"WITH RECURSIVE {LINKS_SQL}, e AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links), walk AS (SELECT DISTINCT a AS account, a AS c FROM e "
    "UNION SELECT e.b, w.c FROM walk w JOIN e ON w.account = e.a) SELECT account, min(c) AS cluster FROM walk GROUP BY account"
)
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.entity_clusters(links(spark, sf_dir))


@query(
    f"WITH {TX_SQL} SELECT sender_account AS value, count(DISTINCT customer_id) AS entities, min(customer_id) AS first_entity, max(customer_id) AS last_entity "
    "FROM tx GROUP BY 1 HAVING count(DISTINCT customer_id) >= 2"
)
def shared_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.shared_attributes(transactions(spark, sf_dir), "sender_account")


@query(
    f"WITH {TX_SQL}, m AS (SELECT DISTINCT sender_account, customer_id FROM tx WHERE sender_account IS NOT NULL) SELECT sender_account, customer_id, entities "
    "FROM m JOIN (SELECT sender_account, count(*) AS entities FROM m GROUP BY 1) USING (sender_account) WHERE entities >= 2"
)
def account_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.shared_members(transactions(spark, sf_dir), "sender_account")


@query(
    f"WITH {TX_SQL} SELECT document_list AS document, count(*) AS transactions, CAST(sum(amount) AS DECIMAL(28,4)) AS total, min(tx_id) AS first_tx, max(tx_id) AS last_tx "
    "FROM tx WHERE document_list <> '' GROUP BY 1 HAVING count(*) >= 2"
)
def multi_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade.multi_invoice(transactions(spark, sf_dir)).withColumn("total", F.col("total").cast("decimal(28,4)"))


@query(
    "WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS line_id, l_partkey AS item, l_extendedprice / l_quantity AS unit_price FROM lineitem), "
    "m AS (SELECT item, quantile_cont(unit_price, 0.5) AS market_price FROM l GROUP BY item) SELECT line_id, item, CASE WHEN unit_price / market_price > 1 THEN "
    "'TBML_OVERINVOICE' ELSE 'TBML_UNDERINVOICE' END AS code FROM l JOIN m USING (item) WHERE unit_price / market_price > 1.5 OR unit_price / market_price < 0.5"
)
def price_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey * 10 + l_linenumber AS line_id", "l_partkey AS item", "l_extendedprice / l_quantity AS unit_price"
    )
    return trade.price_deviation(lines).select("line_id", "item", "code")


RULE_TABLE = (
    ("R1", '{"column": "amount", "op": ">", "value": 150000}', 20, "MEDIUM"),
    ("R2", '{"column": "account_age_days", "op": "<", "value": 60}', 15, "LOW"),
    ("R3", '{"column": "transaction_type", "op": "=", "value": "CRYPTO"}', 30, "HIGH"),
)


@query(
    f"WITH {TX_SQL} SELECT tx_id, concat_ws(',', CASE WHEN amount > 150000 THEN 'R1' END, CASE WHEN account_age_days < 60 THEN 'R2' END, CASE WHEN transaction_type = "
    "'CRYPTO' THEN 'R3' END) AS hits, (CASE WHEN amount > 150000 THEN 20 ELSE 0 END + CASE WHEN account_age_days < 60 THEN 15 ELSE 0 END + CASE WHEN transaction_type = "
    "'CRYPTO' THEN 30 ELSE 0 END)::INT AS score, CASE WHEN transaction_type = 'CRYPTO' THEN 'HIGH' WHEN amount > 150000 THEN 'MEDIUM' WHEN account_age_days < 60 "
    "THEN 'LOW' END AS severity FROM tx"
)
def configured_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame([(*r, True, "THRESHOLD") for r in RULE_TABLE], "rule_id string, parameters string, base_risk_score int, severity string, is_enabled boolean, rule_type string")
    df = trade.configured_rules(transactions(spark, sf_dir), table)
    return df.select("tx_id", joined("rule_hits").alias("hits"), F.col("rule_score").alias("score"), F.col("rule_severity").alias("severity"))


@query(
    f"WITH {PAY_SQL} SELECT client, date_trunc('minute', ts) AS minute, count(*) AS requests, count(*) > 1 AS breach FROM pay GROUP BY 1, 2"
)
def request_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return velocity.request_rate(payments(spark, sf_dir), limit=1)
