"""Cutting lineage by writing to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where none is set a temporary one is made, on a single machine only: on a
    cluster the executors wouldn't see it, which is an error here.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-shared-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder (as in shared_folder) and read from there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def filed(df: DataFrame) -> DataFrame:
    """As written, in compressed columns: a checkpoint's rows are several times as large, but come back in the same partitions."""
    folder = new_folder(df.sparkSession, "rows")
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
