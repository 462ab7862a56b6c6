"""Delivery of a stream's alerts so that each arrives once, whatever fails in between.

A batch is written to a folder of its own number, over what an earlier try
left there, and then entered in the table of commits.  A batch that is tried again
after a failure so replaces itself; what no commit names isn't read.  Alerts that an
earlier batch delivered are left out, as a source may send a transaction again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMIT = "batch long, alerts long, delivered_at timestamp"


def folders(folder: str) -> tuple[str, str]:
    return f"{folder}/alerts", f"{folder}/commits"


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """batch, alerts and delivered_at of the batches that are delivered; none where the folder is new."""
    rows, seen = folders(folder)[1], StructType.fromDDL(COMMIT)
    return spark.read.schema(seen).parquet(rows) if exists(spark, rows) else spark.createDataFrame([], seen)


def delivered(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The alerts of delivered batches, with their batch."""
    rows, with_batch = folders(folder)[0], StructType([*schema.fields]).add("batch", "long")
    if not exists(spark, rows):
        return spark.createDataFrame([], with_batch)
    return spark.read.schema(with_batch).parquet(rows).join(commits(spark, folder).select("batch"), "batch", "left_semi").select(*schema.names, "batch")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in whatever file system it names."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def deliver_to(folder: str, key: str = "alert_id") -> Callable[[DataFrame, int], None]:
    """A function for ``writeStream.foreachBatch`` that delivers each key once.

    Rows with a null key are all delivered.  Of rows that share a key within a batch one, any, is
    kept.  The keys of the batches before are read, not their rows; a
    batch whose commit is there is done and isn't written again.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows, done = folders(folder)
        before = commits(spark, folder)
        if before.where(F.col("batch") == number).limit(1).count():
            return
        keyed = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        if exists(spark, rows):
            old = delivered(spark, folder, batch.schema).where(F.col("batch") < number).select(key)
            keyed = keyed.join(old, key, "left_anti").select(*batch.columns)
        out = keyed.unionByName(batch.where(F.col(key).isNull()))
        out.write.mode("overwrite").parquet(f"{rows}/batch={number}")
        written = spark.read.schema(batch.schema).parquet(f"{rows}/batch={number}").count()
        entry = spark.range(1).select(F.lit(written).cast("long").alias("alerts"), F.current_timestamp().alias("delivered_at"))
        entry.coalesce(1).write.mode("overwrite").parquet(f"{done}/batch={number}")

    return deliver
