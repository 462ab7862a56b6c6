"""The same work on streams."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidemark.operators import packed
from tidemark.operators.rules import alert_rows, score_rules
from tidemark.operators.velocity import DAY_MICROS, request_rate


def stream_score(stream: DataFrame, variant: str = "service") -> DataFrame:
    """Alerts of a stream of transactions; nothing is kept between rows."""
    return alert_rows(score_rules(stream, variant))


def stream_velocity(
    stream: DataFrame, watermark: str = "1 hour", width: str = "24 hours", step: str = "1 hour", max_count: int = 10, max_volume: int = 50_000, groups: int = 256
) -> DataFrame:
    """Sliding windows per customer: count, volume and breaches.

    Rows are first added up in panes as long as the step, one row of state for a
    customer and pane, with partial sums before the shuffle, so a busy customer is as much work as any.
    A pane that the watermark has passed goes on to the width / step windows it is in: to its customer's
    group (of ``groups``), which keeps panes alone and gives out the windows as the watermark passes them (windows_of_panes).
    Where amounts are no decimals, windows are summed up in the state (windows_in_state), as floating sums can't be differences.
    """
    panes = (
        stream.withWatermark("ts", watermark)
        .groupBy("customer_id", F.window("ts", step).alias("pane"))
        .agg(F.count("*").alias("n"), F.sum("amount").alias("v"))
    )
    exact = panes.schema["v"].dataType.typeName() == "decimal"
    found = windows_of_panes(panes, width, step, groups) if exact else windows_in_state(panes, width, step)
    return found.select(
        "customer_id", "window_start", "window_end", "transactions", "volume",
        (F.col("transactions") >= max_count).alias("high_velocity"), (F.col("volume") > max_volume).alias("over_limit"),
    )


def windows_in_state(panes: DataFrame, width: str, step: str) -> DataFrame:
    windows = panes.groupBy("customer_id", F.window(F.window_time("pane"), width, step).alias("w")).agg(F.sum("n").alias("transactions"), F.sum("v").alias("volume"))
    return windows.select("customer_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "transactions", "volume")


def windows_of_panes(panes: DataFrame, width: str, step: str, groups: int) -> DataFrame:
    """The same by ClosedWindows. The state is kept in RocksDB: the session's state store provider is set to it."""
    spark = panes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    wide, long = (spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL '{x}')").first()[0] for x in (width, step))
    who, scale = panes.schema["customer_id"].dataType, panes.schema["v"].dataType.scale
    # Pandas makes floats of longs with nulls, so nulls are a flag; customers of other types go as text.
    carried = "long" if who.typeName() in ("byte", "short", "integer", "long") else "string"
    # Sums of units go in two parts, as there may be more than a long holds.
    units = F.coalesce((F.col("v") * F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    asked = panes.withColumn("low", F.pmod(units, F.lit(LIMB).cast("decimal(38,0)")).cast("long")).select(
        F.pmod(F.xxhash64("customer_id"), F.lit(groups)).alias("bucket"), F.window_time("pane").alias("at"), F.col("customer_id").isNull().alias("unnamed"),
        F.coalesce(F.col("customer_id").cast(carried), F.lit(0).cast(carried)).alias("customer"), F.unix_micros("pane.start").alias("start"),
        F.col("n"), ((units - F.col("low")) / LIMB).cast("long").alias("high"), "low", F.col("v").isNotNull().cast("long").alias("valued"),
    )
    closed = asked.groupBy("bucket").transformWithStateInPandas(
        ClosedWindows(wide, long), f"unnamed boolean, customer {carried}, start long, n long, high long, low long, valued boolean", "append", "eventTime"
    )
    total = F.col("high").cast("decimal(25,0)") * F.lit(LIMB).cast("decimal(13,0)") + F.col("low")
    volume = (total * F.lit(f"1e-{scale}").cast(f"decimal({scale + 1},{scale})")).cast(f"decimal(38,{scale})")
    return closed.select(
        F.when(~F.col("unnamed"), F.col("customer").cast(who)).alias("customer_id"), F.timestamp_micros("start").alias("window_start"),
        F.timestamp_micros(F.col("start") + wide).alias("window_end"), F.col("n").alias("transactions"), F.when(F.col("valued"), volume).alias("volume"),
    )


#: What a unit of the higher part of a sum stands for.
LIMB = 1 << 40
#: Windows that are given out at once.
WINDOWS_STEP = 1 << 18


class ClosedWindows(StatefulProcessor):
    """The sliding windows of a group of customers, each once, when the watermark has passed its end.

    The state is a list of the panes that came, an entry a batch as Arrow columns, and how far windows have been given out. A timer at the end of the
    next window reads the panes, gives out what is closed and keeps the panes that are in later windows.
    """

    def __init__(self, width: int, step: int) -> None:
        self.width, self.step, self.most = width, step, width // step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes, self.upto = handle.getListState("panes", "packed binary"), handle.getValueState("upto", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows), ignore_index=True).drop(columns=["bucket", "at"])
        self.panes.appendValue((packed.shut(pa.Table.from_pandas(new, preserve_index=False)),))
        # A pane's first window ends with it; a timer is due when the watermark is past its time.
        self.handle.registerTimer((int(new["start"].min()) + self.step) // 1000 - 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        given = self.upto.get()[0] if self.upto.exists() else None
        if given is not None and given >= now or not self.panes.exists():
            return
        panes = pa.concat_tables(pa.ipc.open_stream(p[0]).read_all() for p in self.panes.get()).to_pandas()
        yield from self.closed(panes, given, now)
        self.upto.update((now,))
        # The last window of a pane begins with it.
        left = panes[panes["start"].to_numpy() + self.width > now * 1000]
        self.panes.clear()
        if len(left):
            self.panes.appendValue((packed.shut(pa.Table.from_pandas(left, preserve_index=False)),))
            end = max(int(left["start"].min()) + self.step, (now * 1000 // self.step + 1) * self.step) // 1000
            self.handle.registerTimer(end - 1 if end - 1 > now else end)

    def closed(self, panes: pd.DataFrame, given: int | None, now: int) -> Iterator[pd.DataFrame]:
        """Windows of the panes that end after ``given``, if there is one, and not after ``now`` (milliseconds)."""
        unnamed = panes["unnamed"].to_numpy(bool)
        whose, names = pd.factorize(panes["customer"])
        nth = panes["start"].to_numpy() // self.step
        order = np.lexsort((nth, whose, unnamed))
        unnamed, whose, nth = unnamed[order], whose[order], nth[order]
        first = np.concatenate([[True], (whose[1:] != whose[:-1]) | (unnamed[1:] != unnamed[:-1])])
        sums = {c: np.concatenate([[0], np.cumsum(panes[c].to_numpy(np.int64)[order])]) for c in ("n", "high", "low", "valued")}
        # Windows by their first pane: each of a customer is counted with the first pane that is in it.
        low = nth - self.most + 1
        low[1:] = np.where(first[1:], low[1:], np.maximum(low[1:], nth[:-1] + 1))
        if given is not None:
            low = np.maximum(low, (given * 1000 - self.width) // self.step + 1)
        high = np.minimum(nth, (now * 1000 - self.width) // self.step)
        many = np.maximum(high - low + 1, 0)
        if not many.sum():
            return
        base, span = int(nth.min()) - self.most, int(nth.max() - nth.min()) + 2 * self.most + 2
        rows = np.cumsum(first) - 1
        place = rows * span + nth - base
        done = np.cumsum(many)
        cuts = np.unique([0, *(np.searchsorted(done, np.arange(WINDOWS_STEP, done[-1], WINDOWS_STEP)) + 1), len(nth)])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            pane = np.repeat(np.arange(a, b), many[a:b])
            start = np.arange(len(pane)) - np.repeat(np.cumsum(many[a:b]) - many[a:b], many[a:b]) + low[pane]
            after = np.searchsorted(place, rows[pane] * span + start + self.most - base)
            added = {c: v[after] - v[pane] for c, v in sums.items()}
            added["valued"] = added["valued"] > 0
            added["high"], added["low"] = added["high"] + added["low"] // LIMB, added["low"] % LIMB
            yield pd.DataFrame({"unnamed": unnamed[pane], "customer": names.to_numpy()[whose[pane]], "start": start * self.step, **{c: added[c] for c in ("n", "high", "low", "valued")}})

    def close(self) -> None:
        pass


def stream_request_rate(stream: DataFrame, limit: int = 100, watermark: str = "2 minutes") -> DataFrame:
    """Requests per client and minute of a stream."""
    return request_rate(stream.withWatermark("ts", watermark), limit)


def stream_dedupe(stream: DataFrame, key: str = "external_id", watermark: str = "24 hours") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


OUTPUT = "tx_id long, customer_id long, ts timestamp, amount decimal(18,2), transactions_in_24h long, daily_volume decimal(28,2)"
STATE = "packed binary"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of customers that share a day's state.
GROUPS = 64


class TrailingDay(StatefulProcessor):
    """The rows of a day of a group of customers, each with what came in the 24 hours up to it.

    The state is a list of what the batches brought for the day and from the day before, an entry a
    batch with customers, times and cents as one array: entries are appended, nothing is
    rewritten, and a timer clears the list when the watermark is past the day.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", STATE)

    def kept(self, new: np.ndarray, day: int, watermark_ms: int) -> None:
        """Append rows, unless the day is over."""
        end_ms = (day + 1) * DAY_MICROS // 1000
        if new.size and end_ms > watermark_ms:
            self.rows.appendValue((new.tobytes(),))
            self.handle.registerTimer(end_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows), ignore_index=True)
        asks = bool((new["own"].to_numpy(bool) & new["micros"].notna().to_numpy()).any())
        held = [np.frombuffer(h[0], np.int64).reshape(4, -1) for h in self.rows.get()] if asks else []  # rows for the day after only join the list
        added = as_arrays(new)
        self.kept(added, int(key[1]), timerValues.getCurrentWatermarkInMs())
        own = new[new["own"].to_numpy(bool)].copy()
        if not len(own):
            return
        unnamed, customers, times, cents = np.concatenate([*held, added], axis=1)
        order = np.lexsort((times, customers, unnamed))
        unnamed, customers, times, cents = unnamed[order], customers[order], times[order], cents[order]
        total = np.concatenate([[0], np.cumsum(np.where(cents == NO_AMOUNT, 0, cents))])
        amounts = np.concatenate([[0], np.cumsum(cents != NO_AMOUNT)])
        counts, volumes = np.ones(len(own), np.int64), own["amount"].to_numpy(object, copy=True)
        known = own["micros"].notna().to_numpy()
        # Times of a customer come after those of the customers before, so one search finds a place among all.
        starts = np.flatnonzero(np.concatenate([[True], (customers[1:] != customers[:-1]) | (unnamed[1:] != unnamed[:-1])])) if len(times) else np.zeros(0, np.int64)
        first = int(times.min()) - DAY_MICROS if len(times) else 0
        span = (int(times.max()) - first + 1) if len(times) else 1
        nth = np.zeros(len(times), np.int64)
        nth[starts] = 1
        place = (np.cumsum(nth) - 1) * span + (times - first)
        asked = as_arrays(own)
        at = np.searchsorted(named(unnamed[starts], customers[starts]), named(asked[0], asked[1])) * span + (asked[2] - first)
        low, high = np.searchsorted(place, at - (DAY_MICROS - 1), "left"), np.searchsorted(place, at, "right")
        counts[known] = high - low
        volumes[known] = [Decimal(n).scaleb(-2) if k else None for n, k in zip((total[high] - total[low]).tolist(), (amounts[high] - amounts[low]).tolist(), strict=True)]
        own["transactions_in_24h"], own["daily_volume"] = counts, volumes
        yield own[["tx_id", "customer_id", "ts", "amount", "transactions_in_24h", "daily_volume"]]

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:  # noqa: N802, N803
        self.kept(as_arrays(initialState), int(key[1]), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.rows.clear()
        return iter(())

    def close(self) -> None:
        pass


def as_arrays(rows: pd.DataFrame) -> np.ndarray:
    """Whether the customer is null, the customer, time and cents of the rows that have a time."""
    timed = rows[rows["micros"].notna().to_numpy()]
    cents = [NO_AMOUNT if a is None else int(a.scaleb(2)) for a in timed["amount"]]
    return np.array([timed["unnamed"].to_numpy(np.int64), timed["customer"].to_numpy(np.int64), timed["micros"].to_numpy(np.int64), cents], np.int64).reshape(4, -1)


def named(unnamed: np.ndarray, customers: np.ndarray) -> np.ndarray:
    """Both in one value with the order of the two; fields of a structured array compare one after the other."""
    both = np.empty(len(customers), [("unnamed", np.int64), ("customer", np.int64)])
    both["unnamed"], both["customer"] = unnamed, customers
    return both


#: Stands for a missing amount.
NO_AMOUNT = np.iinfo(np.int64).min


def by_day(df: DataFrame, groups: int, *more: str) -> DataFrame:
    """Rows dealt to the day of their customer's group and to the day after: bucket, day, unnamed, customer, micros, near, own and the named columns."""
    day = F.floor(F.unix_micros("ts") / DAY_MICROS).cast("long")
    copies = F.when(F.col("ts").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = F.xxhash64("tx_id") if "tx_id" in more else F.lit(None).cast("long")
    who = F.col("customer_id").cast("long")
    return (
        df.select(
            *more, "customer_id", "ts", F.col("amount").cast("decimal(18,2)").alias("amount"), F.unix_micros("ts").alias("micros"), F.explode(copies).alias("near"),
            F.pmod(F.xxhash64("customer_id"), F.lit(groups)).alias("bucket"), who.isNull().alias("unnamed"), F.coalesce(who, F.lit(0)).alias("customer"),
        )
        .withColumn("own", F.col("near") == 0)
        .withColumn("day", F.coalesce(day + F.col("near"), F.pmod(spread, F.lit(groups))))  # rows without a time are spread
    )


def stream_velocity_exact(stream: DataFrame, watermark: str = "1 hour", history: DataFrame | None = None, groups: int = GROUPS) -> DataFrame:
    """Each transaction with what its customer did in the 24 hours up to it, peers included.

    Customers are dealt to ``groups`` by hash and rows by (group, day), each also to the day
    after it: a customer with very many rows is many keys, and customers with
    few share one, as each key costs calls between Python and the JVM.  More groups make smaller
    tasks where a day has very many rows.  A row is given out by its own day.  ``history`` (customer_id, ts, amount), a table, is
    what went before the stream's first row.  Equal to the batch windows if a batch's
    rows aren't older than those of earlier batches.  Rows without a time are in no
    window but their own; rows without an amount count but add nothing, and a
    volume of such rows alone is null.

    The state is kept in RocksDB: the session's state store provider is set to it.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    before = by_day(history.where("ts IS NOT NULL"), groups).select("bucket", "day", "unnamed", "customer", "micros", "amount").groupBy("bucket", "day") if history is not None else None
    return by_day(stream.withWatermark("ts", watermark), groups, "tx_id").groupBy("bucket", "day").transformWithStateInPandas(
        TrailingDay(), OUTPUT, "append", "eventTime", initialState=before
    )
