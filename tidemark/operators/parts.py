"""Tasks of a bounded size, however large a table is and whatever the session's number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

#: Rows that one task sorts, about.
ROWS_OF_A_TASK = 250_000


def in_parts(df: DataFrame, rows: int, *keys: str | Column, rows_of_a_task: int | None = None) -> DataFrame:
    """df, of about so many rows, dealt by the keys to enough tasks; as it is where one task is enough."""
    most = ROWS_OF_A_TASK if rows_of_a_task is None else rows_of_a_task
    if rows <= most:
        return df
    return df.repartition(max(-(-rows // most), df.sparkSession.sparkContext.defaultParallelism), *keys)
