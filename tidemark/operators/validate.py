"""Checking, normalising and joining of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.functions.arrays import present


def rejected_for(df: DataFrame) -> DataFrame:
    """df with reasons: what is wrong with each row; empty for a good one."""

    def wrong(test: F.Column, reason: str) -> F.Column:
        return F.when(F.coalesce(test, F.lit(False)), F.lit(reason))

    length = F.length("customer_name")
    return df.withColumn(
        "reasons",
        present(
            F.when(F.coalesce(F.col("amount") <= 0, F.lit(True)), F.lit("amount")),
            F.when(F.coalesce(~length.between(1, 500), F.lit(True)), F.lit("customer_name")),
            wrong(F.length("origin_country") > 3, "origin_country"),
            wrong(F.length("destination_country") > 3, "destination_country"),
            wrong(F.length("currency") > 3, "currency"),
            wrong(~F.col("transaction_type").isin(*fixed.TRANSACTION_TYPES), "transaction_type"),
            wrong(F.col("account_age_days") < 0, "account_age_days"),
        ),
    )


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reasons).  A bad row never stops the others."""
    checked = rejected_for(df)
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def normalise(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """Upper-case countries of origin and destination, and the defaults.

    A missing time becomes ``as_of``.
    """
    new = {
        "origin_country": F.upper("origin_country"),
        "destination_country": F.upper("destination_country"),
        "currency": F.coalesce("currency", F.lit("USD")),
        "transaction_type": F.coalesce("transaction_type", F.lit("WIRE_TRANSFER")),
        "customer_type": F.coalesce("customer_type", F.lit("INDIVIDUAL")),
        "account_age_days": F.coalesce("account_age_days", F.lit(0)),
    }
    if as_of:
        new["ts"] = F.coalesce("ts", F.to_timestamp(F.lit(as_of)))
    return df.withColumns({k: v for k, v in new.items() if k in df.columns})


def dedupe_transactions(df: DataFrame, key: str = "external_id", newest: str = "created_at", tie: str = "tx_id") -> DataFrame:
    """The newest row of each key; of equal times the one with the greatest id.

    One aggregation with partial maxima, so that a key with very many rows is
    reduced before the shuffle.  Null keys are kept as they are.
    """
    best = F.max_by(F.struct(*df.columns), F.struct(newest, tie))
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("row")).select("row.*")
    return kept.unionByName(df.where(F.col(key).isNull()))


def with_parties(tx: DataFrame, customers: DataFrame, key: str = "customer_id") -> DataFrame:
    """Attributes of the sending and the receiving customer, as columns sender_* and receiver_*."""
    out = tx
    for side in ("sender", "receiver"):
        renamed = customers.select(*(F.col(c).alias(f"{side}_{c}") for c in customers.columns))
        out = out.join(renamed, F.col(f"{side}_id") == F.col(f"{side}_{key}"), "left")
    return out


def to_usd(tx: DataFrame, rates: DataFrame) -> DataFrame:
    """amount_usd by the newest rate (currency, valid_from, rate) at or before the transaction.

    Rates become intervals that end where the next begins.  Those are dealt out
    by the days they touch, so a row meets the rates of its currency and day
    only; the newest rate of a currency is one row and has no end.  Dollars,
    which hold most rows, don't take part.  Of rates of one currency and time the
    greatest counts.  Without a rate amount_usd is null.
    """
    day = lambda c: F.floor(F.unix_seconds(c) / 86400)
    following = Window.partitionBy("currency").orderBy("valid_from")
    spans = rates.where("valid_from IS NOT NULL").groupBy("currency", "valid_from").agg(F.max("rate").alias("rate")).select("currency", "valid_from", F.lead("valid_from").over(following).alias("valid_to"), "rate")
    ended = spans.where("valid_to IS NOT NULL").select(
        "currency", F.explode(F.sequence(day("valid_from"), day("valid_to"))).alias("_day"), F.struct("valid_from", "valid_to", "rate").alias("_span")
    )
    newest = spans.where("valid_to IS NULL").select("currency", F.struct("valid_from", "rate").alias("_newest"))
    dollars = tx.where(F.col("currency") == "USD").withColumn("amount_usd", F.col("amount").cast("decimal(20,4)"))
    others = tx.where(F.coalesce(F.col("currency") != "USD", F.lit(True))).withColumn("_day", day("ts"))
    in_span = (F.col("o.currency") == F.col("s.currency")) & (F.col("o._day") == F.col("s._day"))
    in_span &= (F.col("ts") >= F.col("_span.valid_from")) & (F.col("ts") < F.col("_span.valid_to"))
    since = (F.col("o.currency") == F.col("n.currency")) & (F.col("ts") >= F.col("_newest.valid_from"))
    rate = F.coalesce("_span.rate", "_newest.rate")
    changed = others.alias("o").join(ended.alias("s"), in_span, "left").join(newest.alias("n"), since, "left")
    changed = changed.select("o.*", (F.col("amount") * rate).cast("decimal(20,4)").alias("amount_usd"))
    return dollars.unionByName(changed.select(*dollars.columns))
