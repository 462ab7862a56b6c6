"""All registered queries of the monitoring library, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import case_queries, queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**queries.QUERIES, **case_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**queries.ORACLE_SQL, **case_queries.ORACLE_SQL}
