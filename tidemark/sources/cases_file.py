"""Reading case files and writing assessments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WALLET = (
    "struct<wallet_address: string, wallet_age_days: int, mixer_used: boolean, darknet_market: string, "
    "cross_chain_swaps: int, token_type: string, privacy_coin: boolean>"
)
TRANSACTION = (
    "struct<amount: decimal(20,4), currency: string, timestamp: string, transaction_type: string, origin_country: string, "
    "destination_country: string, intermediate_countries: array<string>, parties: array<string>, sender_account: string, "
    f"receiver_account: string, documents: array<string>, asset_type: string, crypto_details: {WALLET}, reference_id: string, "
    "notes: string, metadata: map<string, string>>"
)
CUSTOMER = (
    "struct<name: string, customer_id: string, customer_type: string, account_age_days: int, account_opened_date: string, "
    "country_of_residence: string, nationality: string, transaction_history: array<struct<amount: decimal(20,4), currency: string, "
    "timestamp: string, transaction_type: string, destination_country: string>>, occupation: string, source_of_funds: string, "
    "expected_activity: string, metadata: map<string, string>>"
)
SCHEMA = f"scenario string, transaction {TRANSACTION}, customer {CUSTOMER}"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder of JSON arrays of {scenario, transaction, customer}."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def write_cases(cases: DataFrame, path: str, per_file: int = 5000) -> None:
    """Cases as JSON arrays of about so many, each a file that read_cases reads."""
    lines = cases.select(F.to_json(F.struct("scenario", "transaction", "customer")).alias("value"))
    files = max(1, -(-lines.count() // per_file))
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files))  # equal cases are dealt too
    arrays = lines.withColumn("file", number).groupBy("file").agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value")  # about per_file of them
    )
    arrays.write.partitionBy("file").text(path)


def case_id() -> F.Column:
    """An id that follows from the case's content."""
    return F.abs(F.xxhash64(F.to_json(F.struct("scenario", "transaction", "customer"))))


def flatten_cases(cases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transactions with the customer's attributes, customers, history)."""
    c = cases.withColumn("tx_id", case_id())
    who = F.coalesce("customer.customer_id", F.concat(F.lit("case-"), F.col("tx_id").cast("string")))
    tx = c.select(
        "tx_id", "scenario", who.alias("customer_id"), "transaction.*", F.col("customer.name").alias("customer_name"),
        F.col("customer.customer_type").alias("customer_type"), F.col("customer.account_age_days").alias("account_age_days"),
    ).withColumn("ts", F.to_timestamp("timestamp")).drop("timestamp")
    customers = c.select(who.alias("id"), "customer.*").drop("transaction_history", "customer_id")
    customers = customers.withColumnRenamed("id", "customer_id")
    history = c.select("tx_id", who.alias("customer_id"), F.posexplode("customer.transaction_history").alias("nth", "h")).select(
        "tx_id", "customer_id", "nth", "h.*"
    ).withColumn("ts", F.to_timestamp("timestamp")).drop("timestamp")
    return tx, customers, history


def ledger_of(history: DataFrame) -> DataFrame:
    """History as ledger rows, in which only customer, time and amount matter."""
    return history.select("customer_id", "ts", "amount")


def write_assessments(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet, or JSON lines, in folders by day and level.

    Rows of a folder are brought together first, as a file for every task and
    folder would be very many; folders with very many rows are split again.
    """
    dealt = df.withColumn("day", F.to_date("ts")).hint("rebalance", F.col("day"), F.col("risk_level"))
    dealt.write.partitionBy("day", "risk_level").mode("overwrite").format(fmt).save(path)
