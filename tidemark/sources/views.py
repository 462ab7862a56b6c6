"""Transactions, payments and the like as views of plain business tables.

Every view is a list of expressions that Spark SQL and ANSI engines read alike.
``select`` makes the DataFrame, ``sql`` the same as a WITH query.  Lists come as
delimited text from the tables and are split here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTRIES = "USCAGBDEFRIRKPRUSYKYVGPAAEMTNGPKPHCNINMXCHSGZABRJP"


@dataclass(frozen=True)
class View:
    tables: tuple[str, ...]
    source: str  # FROM clause
    columns: dict[str, str]
    where: str = ""

    def sql(self) -> str:
        picked = ", ".join(f"{e} AS {n}" for n, e in self.columns.items())
        return f"SELECT {picked} FROM {self.source}" + (f" WHERE {self.where}" if self.where else "")

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return stamped(self._read(spark, sf_dir, self.sql()))

    def frame_after(self, spark: SparkSession, sf_dir: str, keys: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The frame with what ``step`` adds, which sees the source's rows with the view's ``keys``.

        Rows that the step shuffles are as short as the source's: the other columns are worked out after it.
        """
        rows = self._read(spark, sf_dir, f"SELECT * FROM {self.source}" + (f" WHERE {self.where}" if self.where else ""))
        keyed = stamped(rows.selectExpr("*", *(f"{self.columns[k]} AS {k}" for k in keys)), keys)
        done = step(keyed)
        added = [c for c in done.columns if c not in keyed.columns]
        return stamped(done.selectExpr(*(n if n in keys else f"{e} AS {n}" for n, e in self.columns.items()), *added))

    def _read(self, spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
        read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in self.tables}
        # Named arguments in place of session-wide views.
        return spark.sql(_placeholders(sql, self.tables), **read)


def stamped(df: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """df with its times (of the names, if given) without a zone as times of the session's."""
    stamps = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz" and (names is None or f.name in names)]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in stamps})


def _placeholders(sql: str, tables: tuple[str, ...]) -> str:
    head, _, tail = sql.partition(" FROM ")
    for name in tables:
        tail = tail.replace(f"{name} ", "{" + name + "} ", 1)
    return head + " FROM " + tail


TX = View(
    ("orders", "customer"),
    "orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    {
        "tx_id": "o_orderkey",
        "external_id": "concat('X', CAST(o_orderkey - o_orderkey % 50 * (CASE WHEN o_orderkey % 50 < 2 THEN 1 ELSE 0 END) AS STRING))",
        "customer_id": "o_custkey",
        "ts": "o_orderdate",
        "amount": "CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CASE o_orderkey % 4 WHEN 0 THEN 1.00 WHEN 1 THEN 0.10 "
        "WHEN 2 THEN 0.02 ELSE 0.05 END AS DECIMAL(20,4))",
        "currency": "CASE o_orderkey % 10 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 2 THEN 'JPYX' ELSE 'USD' END",
        "transaction_type": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'WIRE_TRANSFER' WHEN '2' THEN 'ACH' WHEN '3' THEN 'CRYPTO' "
        "WHEN '4' THEN 'CASH' ELSE 'TRADE_FINANCE' END",
        "asset_type": "CASE WHEN o_orderkey % 17 = 0 THEN 'CRYPTO' END",
        "origin_country": f"CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE substr('{COUNTRIES}', CAST(2 * c_nationkey + 1 AS INT), 2) END",
        "destination_country": f"substr('{COUNTRIES}', CAST(2 * ((o_orderkey * 7 + o_custkey) % 25) + 1 AS INT), 2)",
        "via": "CASE o_orderkey % 9 WHEN 0 THEN 'PA,ky' WHEN 1 THEN 'AE,MT,SC' WHEN 2 THEN 'PK' WHEN 3 THEN 'kp,mu' ELSE '' END",
        "party_list": "CASE o_orderkey % 13 WHEN 0 THEN 'sanctioned_russian_bank|Acme Ltd' WHEN 1 THEN 'Iran Shipping|Delta' "
        "WHEN 2 THEN 'IRAN_SHIPPING_CO_LTD' WHEN 3 THEN 'North Korea Exports|iran' WHEN 4 THEN '' ELSE concat(c_name, '|Harbor Goods') END",
        "document_list": "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('INV-', CAST(o_orderkey % 9000 AS STRING)) END",
        "sender_account": "concat('A', CAST(o_custkey % 997 AS STRING))",
        "wallet_age_days": "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey % 45 AS INT) END",
        "mixer_used": "o_orderkey % 6 = 0",
        "darknet_market": "CASE o_orderkey % 23 WHEN 0 THEN 'Hydra Market' WHEN 1 THEN 'corner shop' END",
        "cross_chain_swaps": "CAST(o_orderkey % 5 AS INT)",
        "privacy_coin": "o_orderkey % 19 = 0",
        "customer_name": "CASE o_custkey % 12 WHEN 0 THEN 'Minister Adebayo Gov' WHEN 1 THEN 'Tehran Exporters' WHEN 2 THEN 'Viking Trading' "
        "WHEN 3 THEN 'Moscow Metals Russia' WHEN 4 THEN 'State Official Prince' ELSE c_name END",
        "customer_type": "CASE WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 'CORPORATE' ELSE 'INDIVIDUAL' END",
        "account_age_days": "CAST(o_custkey % 400 AS INT)",
        "created_at": "o_orderdate",
    },
)

PAY = View(
    ("events",),
    "events e",
    {
        "tx_id": "event_id",
        "customer_id": "user_id",
        "ts": "ts",
        "amount": "CAST(CAST(value AS DECIMAL(18,2)) * 100 AS DECIMAL(18,2))",
        "account_age_days": "CAST(user_id % 60 AS INT)",
        "client": "user_id",
        "kind": "event_type",
    },
)

FLOWS = View(
    ("lineitem", "orders"),
    "lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey",
    {
        "tx_id": "l_orderkey * 10 + l_linenumber",
        "src": "(o_custkey * 13) % 20011",
        "dst": "(l_suppkey * 131 + l_partkey * 7) % 20011",
        "ts": "l_shipdate",
        "amount": "CAST(l_extendedprice AS DECIMAL(18,2))",
    },
)


def lists(tx: DataFrame) -> DataFrame:
    """The delimited lists as arrays, the wallet's columns as one struct."""

    def split(name: str, mark: str) -> F.Column:
        return F.filter(F.split(name, mark), lambda x: x != "")

    wallet = ("wallet_age_days", "mixer_used", "darknet_market", "cross_chain_swaps", "privacy_coin")
    return tx.select(
        *(c for c in tx.columns if c not in (*wallet, "via", "party_list", "document_list")),
        split("via", ",").alias("intermediate_countries"),
        split("party_list", "[|]").alias("parties"),
        split("document_list", "[|]").alias("documents"),
        F.struct(*wallet).alias("crypto_details"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists(TX.frame(spark, sf_dir))


def transactions_after(spark: SparkSession, sf_dir: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The transactions with what ``step`` adds to tx_id, customer_id, ts and amount."""
    return lists(TX.frame_after(spark, sf_dir, ("tx_id", "customer_id", "ts", "amount"), step))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PAY.frame(spark, sf_dir)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FLOWS.frame(spark, sf_dir)


#: Who shares an account or a household with whom: customers are 3 c, accounts 3 a + 1, households 3 h + 2.
LINKS_SQL = (
    "links AS (SELECT DISTINCT c_custkey * 3 AS src, (c_custkey % 997) * 3 + 1 AS dst FROM customer "
    "UNION SELECT c_custkey * 3 AS src, (c_custkey // 2) * 3 + 2 AS dst FROM customer)"
)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    accounts = customers.selectExpr("c_custkey * 3 AS src", "(c_custkey % 997) * 3 + 1 AS dst")
    return accounts.unionByName(customers.selectExpr("c_custkey * 3 AS src", "(c_custkey div 2) * 3 + 2 AS dst"))


TX_SQL = f"tx AS ({TX.sql()})"
PAY_SQL = f"pay AS ({PAY.sql()})"
FLOWS_SQL = f"flows AS ({FLOWS.sql()})"
