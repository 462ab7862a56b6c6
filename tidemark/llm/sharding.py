"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Equal texts hash to one place of the ring, so copies lie together.  Each shard
owns the arcs before its virtual nodes.

Rows that hold over a 300th of a shard's fair share are placed first, whole,
the largest first: each goes to the first shard clockwise that has room for it (if
none has, to the one with most room).  All other rows then fill what is left of the
shards to one level.  What an arc holds beyond the free room of its shard goes on
clockwise to the next virtual node whose shard has room.  The rows of an arc have
an order (place, then doc_id, then size), so "what goes on" is a tail of that order
and each row's shard follows from how many bytes lie before it on its arc.  A row
that lies across the end goes where its middle lies, so a shard is off the level by
half of that at each place where it meets another; more only where a row
alone is over the level.

Scale: the rows (no text, some 40 bytes each) are range-partitioned by arc,
place and doc_id, so that even a third of all rows with one text is dealt to
many tasks.  Offsets come from two-level prefix sums: totals per partition and
arc (at most partitions + arcs rows), then a running sum inside a partition.
The totals per arc (shards x virtual nodes, whatever the input) reach the driver,
which settles the ring, and the keys of the rows placed first: at most 300 a shard,
as no more rows can hold a 300th each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: How far over the level a shard may be filled, as a share of it.
SLACK = 0.0002
VIRTUAL_NODES = 256
#: Rows of at least a shard's fair share divided by this are placed whole and first.
FINENESS = 300


def ring(shards: int, virtual_nodes: int) -> tuple[list[int], list[int]]:
    """The virtual nodes' places (signed 64 bits, ascending) and their shards."""
    nodes = sorted((xxhash.xxh64_intdigest(f"{s}/{v}") - 2**63, s) for s in range(shards) for v in range(virtual_nodes))
    return [p for p, _ in nodes], [s for _, s in nodes]


def place_whole(rows: list[tuple[int, int]], owners: list[int], shards: int, most: float) -> list[int]:
    """The shards of rows (arc, size), in this order: the first clockwise with room, or the one with most room."""
    room, out = [most] * shards, []
    for arc, size in rows:
        widest = max(range(shards), key=room.__getitem__)
        shard = widest
        if room[widest] >= size:
            shard = next(owners[n % len(owners)] for n in range(arc, arc + len(owners)) if room[owners[n % len(owners)]] >= size)
        room[shard] -= size
        out.append(shard)
    return out


def level(held: list[int], more: int) -> float:
    """Up to where shards that hold so much are filled when so much more is shared out evenly."""
    below, lowest = 0, sorted(held)
    for n, h in enumerate(lowest, 1):
        below += h
        if n == len(lowest) or (more + below) / n <= lowest[n]:
            return (more + below) / n
    return 0.0


def settle(loads: dict[int, int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, from byte, to byte, shard): how the arcs' loads fill the shards' room clockwise; it holds all of them."""
    room, out = list(room), []
    for arc in sorted(loads):
        at, left, node = 0, loads[arc], arc
        while left > 0:
            shard = owners[node % len(owners)]
            take = min(left, room[shard])
            if take > 0:
                out.append((arc, at, at + take, shard))
                room[shard] -= take
                at, left = at + take, left - take
            node += 1
    return out


def assign_shards(
    docs: DataFrame, shards: int = 24, virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK, fineness: int = FINENESS
) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, arc, shard, slot.

    size is the text's UTF-8 bytes plus 8; a null text has no bytes and the
    CRC of the empty text.  Null ids are placed like others and sort first.
    Rows equal in id and text are separate rows in neighbouring slots.  An
    empty table gives no rows.  A very long text weighs what it holds: larger
    than the fair share, it fills a shard by itself.  Other columns are ignored.
    """
    spark = docs.sparkSession
    places, owners = ring(shards, virtual_nodes)

    @F.pandas_udf("int")
    def arc_of(place: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(np.array(places), place.to_numpy()) % len(places)).astype(np.int32))

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("place"),
    ).withColumn("arc", arc_of("place"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["arc", "place", "doc_id", "size"]
    rows = materialise(
        rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    )  # part is fixed from here on
    total = rows.agg(F.sum("size")).first()[0] or 0
    whole = F.col("size") >= max(1, -(-total // (shards * fineness)))

    # Rows alike in all of these are interchangeable; nth tells them apart.
    key = ["place", "doc_id", "size", "text_crc32"]
    large = rows.where(whole).withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("part")))
    names = ["arc", *key, "nth"]
    first = sorted(  # at most shards x fineness rows
        large.select(*names).collect(), key=lambda r: (-r.size, r.arc, r.place, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.nth)
    )
    chosen = place_whole([(r.arc, r.size) for r in first], owners, shards, total * (1 + slack) / shards)
    held = [0] * shards
    for r, shard in zip(first, chosen, strict=True):
        held[shard] += r.size
    given = spark.createDataFrame([(*r, shard) for r, shard in zip(first, chosen, strict=True)], large.select(*names).schema.add("shard", "integer"))
    given = given.select(*(F.col(n).alias(f"their_{n}") for n in names), "shard")
    same = [F.col(n).eqNullSafe(F.col(f"their_{n}")) for n in names]
    placed_whole = large.join(F.broadcast(given), same)  # at most shards x fineness rows

    small = rows.where(~whole)
    by_part = small.groupBy("part", "arc").agg(F.sum("size").alias("load"))
    loads = {r.arc: r["sum(load)"] for r in by_part.groupBy("arc").sum("load").collect()}  # <= shards x nodes rows
    most = math.ceil(level(held, sum(loads.values())) * (1 + slack))
    taken = spark.createDataFrame(
        settle(loads, owners, [max(0, most - h) for h in held]), "arc int, from_byte long, to_byte long, shard int"
    )

    earlier = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "arc", F.coalesce(F.sum("load").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part", "arc").orderBy("place", "doc_id", "size", "text_crc32")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = (
        small.withColumn("inside", F.sum("size").over(running))
        .join(before, ["part", "arc"])
        .withColumn("middle", F.col("before") + F.col("inside") - F.expr("size div 2") - 1)
        .join(F.broadcast(taken), "arc")  # at most one row an arc and one a shard filled
        .where("middle >= from_byte AND middle < to_byte")
    )
    columns = [*rows.columns, "shard"]
    placed = filled.select(*columns).unionByName(placed_whole.select(*columns))
    in_part = Window.partitionBy("part", "shard").orderBy(*order, "text_crc32")
    placed = placed.withColumn("nth", F.row_number().over(in_part))
    counts = placed.groupBy("part", "shard").agg(F.count("*").alias("n"))
    lower = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "shard", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("first"))
    return placed.join(first, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", "arc", "shard", (F.col("first") + F.col("nth") - 1).alias("slot")
    )

