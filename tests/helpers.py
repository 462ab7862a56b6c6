"""Rows for tests: transactions with defaults."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

WALLET = "struct<wallet_age_days: int, mixer_used: boolean, darknet_market: string, cross_chain_swaps: int, privacy_coin: boolean>"
SCHEMA = (
    "tx_id long, customer_id long, ts timestamp, amount decimal(20,4), currency string, transaction_type string, asset_type string, origin_country string, "
    f"destination_country string, intermediate_countries array<string>, parties array<string>, documents array<string>, crypto_details {WALLET}, "
    "customer_name string, customer_type string, account_age_days int"
)
DEFAULTS = {
    "ts": datetime(2024, 1, 10, 12), "currency": "USD", "transaction_type": "WIRE_TRANSFER", "asset_type": None, "origin_country": "US",
    "destination_country": "CA", "intermediate_countries": [], "parties": ["Harbor Goods"], "documents": ["INV-1"], "crypto_details": None,
    "customer_name": "James Smith", "customer_type": "INDIVIDUAL", "account_age_days": 365,
}


def tx(spark: SparkSession, *rows: dict) -> DataFrame:
    names = [part.split()[0] for part in SCHEMA.replace(WALLET, "wallet").split(", ")]
    full = []
    for i, row in enumerate(rows):
        values = {"tx_id": i, "customer_id": i, "amount": 100, **DEFAULTS, **row}
        values["amount"] = None if values["amount"] is None else Decimal(str(values["amount"]))
        full.append(tuple(values[n] for n in names))
    return spark.createDataFrame(full, SCHEMA)


def wallet(age: int | None = None, mixer: bool = False, darknet: str | None = None, swaps: int = 0, coin: bool = False) -> tuple:
    return (age, mixer, darknet, swaps, coin)
