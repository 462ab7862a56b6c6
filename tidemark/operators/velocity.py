"""Each customer's activity within 24 hours of every transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import written
from .parts import in_parts

DAY_MICROS = 86_400_000_000
#: Rows of a customer's day from which it is cut up, and into how many slices.
HOT_ROWS = 100_000
SLICES = 48
#: Hot days, and busy customers, up to which their list is broadcast.
MOST_BROADCAST = 10_000
#: Rows of a customer, or of each of its days, up to which a frame of 24 hours is looked through for every row.
FRAME_ROWS = 200
#: The columns that velocity_24h adds.
WINDOWS = ("transactions_in_24h", "daily_volume", "mean_amount", "sd_amount", "min_amount", "max_amount", "all_in_band", "recent_count")


def velocity_24h(
    tx: DataFrame, direction: str = "backward", band: tuple[int, int] = (9000, 10000), hot_rows: int = HOT_ROWS, slices: int = SLICES
) -> DataFrame:
    """tx with recent_count, transactions_in_24h, daily_volume, the amounts' mean, sd, least and most, and all_in_band.

    all_in_band says that there are amounts and each is from the first of
    ``band`` to below the second.

    Recent is what is under 86400 s away, by the same customer; peers of the
    same instant count.  ``backward`` looks at what came before, ``both`` also
    at what came after.  Rows without a time are in no window but their own.

    A frame reaches one day at most, so a customer's rows are dealt out by
    (customer, day), with copies of each row in the neighbouring days it can be
    seen from.  A row is an event where it comes into view and, in the day after,
    one where it goes out of view.  Counts, volumes, means and deviations are
    running sums of events.  The least and the most amount in view are those of
    the events that came in so far and of those that have yet to go out: running
    minima from either end of the day.  So every row is constant work, however
    many fall into 24 hours.

    Days of a customer with over ``hot_rows`` rows, which are counted first, are cut
    into ``slices``, each a group of its own.  What the slices before and after hold is
    summed up, a row a slice, and carried into the slice, so such a day is spread over
    many tasks; only rows of one instant must meet.  Rows without an amount count but
    add nothing.  The more events there are, the more tasks they are dealt to.
    """
    day = F.floor(F.unix_micros("ts") / DAY_MICROS).cast("long")
    both = direction != "backward"
    timed = F.col("ts").isNotNull()
    upper = DAY_MICROS - 1 if both else 0
    at = F.unix_micros("ts")

    def event(near: int, time: Column, change: int, asks: bool) -> Column:
        return F.struct(F.lit(near).alias("near"), time.alias("time"), F.lit(change).alias("change"), F.lit(asks).alias("asks"))

    events = [event(1, at - upper, 1, False), event(1, at + DAY_MICROS, -1, False)]
    events += [event(0, at - upper, 1, False), event(0, at, 0, True), event(-1, at - upper, 1, False)] if both else [event(0, at, 1, True)]
    alone = F.array(event(0, F.lit(None).cast("long"), 1, True))

    counted = tx.groupBy(F.struct("customer_id").alias("who"), day.alias("of")).agg(F.count("*").alias("n"))
    # The hot days, and all rows of the others as one.
    is_hot = F.col("of").isNotNull() & (F.col("n") > hot_rows)
    counted = written(counted.groupBy(F.when(is_hot, F.col("who")).alias("who"), F.when(is_hot, F.col("of")).alias("of")).agg(F.sum("n").alias("n")))
    n_events = len(events) * (counted.agg(F.sum("n")).first()[0] or 0)
    # Rows are seen from the days beside theirs.
    hot = counted.where("of IS NOT NULL").select("who", F.explode(F.array(*(F.col("of") + n for n in (-1, 0, 1)))).alias("day")).distinct()
    n_hot = hot.limit(MOST_BROADCAST + 1).count()
    flagged = hot.withColumn("hot", F.lit(True))
    flagged = F.broadcast(flagged) if n_hot <= MOST_BROADCAST else flagged

    def dealt(kept: list[Column]) -> DataFrame:
        spread = tx.select("customer_id", "amount", *kept, day.alias("day"), F.xxhash64("tx_id").alias("spread"), F.explode(F.when(timed, F.array(*events)).otherwise(alone)).alias("e"))
        spread = spread.withColumn("day", F.coalesce(F.col("day") + F.col("e.near"), F.col("spread")))  # rows without a time are spread
        # Events before the day belong to its first slice.
        part = F.floor((F.col("e.time") - F.col("day") * DAY_MICROS) / (DAY_MICROS // slices)).cast("int")
        asked = [F.when(F.col("e.asks"), F.col("row")).alias("row")] if kept else []
        spread = spread.withColumn("who", F.struct("customer_id"))
        if n_hot:
            spread = spread.join(flagged, ["who", "day"], "left" if kept else "inner")
        part = F.when(F.col("hot"), F.coalesce(F.greatest(part, F.lit(0)), F.lit(0))).otherwise(0) if n_hot else F.lit(0)
        return spread.select(
            "who", "day", part.alias("slice"), "amount", *asked,
            "e.time", "e.change", "e.asks", ((F.col("e.near") <= 0) & (F.col("e.change") > 0)).alias("enters"),
        )

    amount, change = F.col("amount"), F.col("change")
    inside = ((amount >= band[0]) & (amount < band[1])).cast("long")
    sums = {
        "n_seen": change.cast("long"), "n_known": amount.isNotNull().cast("long") * change, "volume": amount * change,
        "squares": amount * amount * change, "n_inside": F.coalesce(inside, F.lit(0)) * change,
    }
    came, stays = F.when(F.col("enters"), amount), F.when(change < 0, amount)

    key = ["who", "day", "slice"]  # a struct of a null is a key like others
    rows = dealt([F.struct(*(F.col(c) for c in tx.columns)).alias("row")])
    if not n_hot:
        key = key[:2]
    rows = in_parts(rows, n_events, *key)
    if n_hot:
        rows = rows.join(carried_into(dealt([]), key, sums, came, stays), key, "left")

    group = Window.partitionBy(*key)
    running = group.orderBy("time").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = group.orderBy(F.desc("time")).rangeBetween(Window.unboundedPreceding, -1)

    def total(name: str) -> Column:
        own = F.coalesce(F.sum(sums[name]).over(running), F.lit(0))
        return own + F.coalesce(F.col(f"carried_{name}"), F.lit(0)) if n_hot else own

    def carried(*names: str) -> list[Column]:
        return [F.col(f"carried_{n}") for n in names] if n_hot else []

    kind = tx.select(F.sum("amount").alias("s")).schema["s"].dataType
    n, s, ss = F.col("known"), F.col("volume").cast("double"), F.col("squares").cast("double")
    seen = rows.withColumns(
        {
            "transactions_in_24h": total("n_seen").cast("long"),
            "known": total("n_known"),
            "volume": total("volume"),
            "squares": total("squares"),
            "inside": total("n_inside"),
            "least": F.least(F.min(came).over(running), F.min(stays).over(later), *carried("came_least", "stays_least")),
            "most": F.greatest(F.max(came).over(running), F.max(stays).over(later), *carried("came_most", "stays_most")),
        }
    ).where("asks")
    is_timed = F.col("time").isNotNull()
    own = F.col("row.amount")
    variance = F.greatest(ss - s * s / n, F.lit(0.0)) / (n - 1)
    return seen.select(
        "row.*",
        F.when(is_timed, F.col("transactions_in_24h")).otherwise(F.lit(1)).cast("long").alias("transactions_in_24h"),
        F.when(is_timed, F.when(n > 0, F.col("volume"))).otherwise(own).cast(kind).alias("daily_volume"),
        F.when(is_timed, F.when(n > 0, s / n)).otherwise(own.cast("double")).alias("mean_amount"),
        F.when(is_timed & (n > 1), F.sqrt(variance)).alias("sd_amount"),
        F.when(is_timed, F.col("least")).otherwise(own).alias("min_amount"),
        F.when(is_timed, F.col("most")).otherwise(own).alias("max_amount"),
        F.when(is_timed, (n > 0) & (n == F.col("inside"))).otherwise((own >= band[0]) & (own < band[1])).alias("all_in_band"),
    ).withColumn("recent_count", F.col("transactions_in_24h") - 1)


def windows_24h(tx: DataFrame, direction: str = "backward", band: tuple[int, int] = (9000, 10000), frame_rows: int = FRAME_ROWS) -> DataFrame:
    """tx with the columns of velocity_24h, for tables most of whose customers have few rows.

    Customers with up to ``frame_rows`` rows, or as many on each of their days and without a time, are dealt by customer
    alone, each row once, and a frame is looked through for every row: there are at most three days' rows in it.
    Only the others, which are counted first, go by velocity_24h.  The more rows there are, the more tasks they
    are dealt to.
    """
    who = F.struct("customer_id").alias("who")  # a struct of a null is a key like others
    counted = tx.groupBy(who).agg(F.count("*").alias("n"))
    # Customers with many rows, and all rows of the others as one.
    counted = written(counted.groupBy(F.when(F.col("n") > frame_rows, F.col("who")).alias("who")).agg(F.sum("n").alias("n")))
    n_rows, n_many = counted.agg(F.sum("n"), F.count("who")).first()
    n_busy = 0
    if n_many:
        day = F.floor(F.unix_micros("ts") / DAY_MICROS).alias("day")
        many = counted.where("who IS NOT NULL").select("who")
        many = F.broadcast(many) if n_many <= MOST_BROADCAST else many
        days = tx.select(who, day).join(many, "who", "left_semi").groupBy("who", "day").agg(F.count("*").alias("n"))
        busy = written(days.where(F.col("n") > frame_rows).select("who").distinct())
        n_busy = busy.count()
    if not n_busy:
        return frames_24h(in_parts(tx, n_rows or 0, "customer_id"), direction, band)
    busy = F.broadcast(busy) if n_busy <= MOST_BROADCAST else busy
    named = tx.withColumn("who", who)
    others = named.join(busy, "who", "left_anti").select(*tx.columns)
    seen = frames_24h(in_parts(others, n_rows, "customer_id"), direction, band)
    return seen.unionByName(velocity_24h(named.join(busy, "who", "left_semi").select(*tx.columns), direction, band))


def frames_24h(tx: DataFrame, direction: str, band: tuple[int, int]) -> DataFrame:
    """tx with the columns of velocity_24h, by a frame of a customer's rows for each row."""
    upper = DAY_MICROS - 1 if direction != "backward" else 0
    frame = Window.partitionBy("customer_id").orderBy(F.unix_micros("ts")).rangeBetween(1 - DAY_MICROS, upper)
    own, timed = F.col("amount"), F.col("ts").isNotNull()
    seen = tx.withColumns(
        {
            "_n": F.count("*").over(frame), "_known": F.count("amount").over(frame), "_volume": F.sum("amount").over(frame),
            "_sd": F.stddev_samp(F.col("amount").cast("double")).over(frame), "_least": F.min("amount").over(frame), "_most": F.max("amount").over(frame),
        }
    )
    alone = lambda column, value: F.when(timed, F.col(column)).otherwise(value)
    least, most = alone("_least", own), alone("_most", own)
    n = alone("_n", F.lit(1)).cast("long")
    return seen.select(
        *tx.columns, n.alias("transactions_in_24h"), alone("_volume", own).cast(seen.schema["_volume"].dataType).alias("daily_volume"),
        F.when(timed, F.col("_volume").cast("double") / F.nullif("_known", F.lit(0))).otherwise(own.cast("double")).alias("mean_amount"),
        F.when(timed & (F.col("_known") > 1), F.col("_sd")).alias("sd_amount"), least.alias("min_amount"), most.alias("max_amount"),
        F.when(timed, F.coalesce((F.col("_least") >= band[0]) & (F.col("_most") < band[1]), F.lit(False))).otherwise((own >= band[0]) & (own < band[1])).alias("all_in_band"),
        (n - 1).alias("recent_count"),
    )


def carried_into(events: DataFrame, key: list[str], sums: dict[str, Column], came: Column, stays: Column) -> DataFrame:
    """For each slice, named by the key, the sums of the slices before it in its day, and the extremes of those before and after."""
    totals = events.groupBy(*key).agg(
        *(F.sum(v).alias(n) for n, v in sums.items()), F.min(came).alias("came_least"), F.max(came).alias("came_most"), F.min(stays).alias("stays_least"), F.max(stays).alias("stays_most")
    )
    in_day = Window.partitionBy(*key[:2])
    before = in_day.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    after = in_day.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *key, *(F.sum(n).over(before).alias(f"carried_{n}") for n in sums),
        F.min("came_least").over(before).alias("carried_came_least"), F.max("came_most").over(before).alias("carried_came_most"),
        F.min("stays_least").over(after).alias("carried_stays_least"), F.max("stays_most").over(after).alias("carried_stays_most"),
    )


def request_rate(log: DataFrame, limit: int = 100) -> DataFrame:
    """Requests per client and minute, and whether they are over the limit; batch or stream."""
    return (
        log.groupBy("client", F.window("ts", "1 minute").alias("w"))
        .agg(F.count("*").alias("requests"))
        .select("client", F.col("w.start").alias("minute"), "requests", (F.col("requests") > limit).alias("breach"))
    )
