"""The case book: cases, their events and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import parts
from .parts import in_parts
from .results import after

CLOSED = ("CLOSED_NO_ACTION", "CLOSED_FALSE_POSITIVE")
CLOSING = (*CLOSED, "SAR_FILED")
CHANGING = ("update", "assign", "escalate", "file_sar", "close")


def create_cases(requests: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(cases, comments) of requests (request_id, title, priority, assigned_to): open, with deadlines, and a first comment."""
    now = F.to_timestamp(F.lit(as_of))
    digest = F.upper(F.substring(F.sha2(F.concat_ws("|", F.col("request_id").cast("string"), F.lit(as_of)).cast("binary"), 256), 1, 6))
    cases = requests.select(
        F.col("request_id").alias("case_id"), F.concat(F.lit("CASE-"), F.date_format(now, "yyyyMMdd"), F.lit("-"), digest).alias("case_number"),
        "title", F.lit("OPEN").alias("status"), "priority", "assigned_to", after(as_of, "24 HOURS").alias("review_deadline"),
        after(as_of, "30 DAYS").alias("sar_deadline"), now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("timestamp").alias("closed_at"),
    )
    comments = cases.select(
        "case_id", F.lit("SYSTEM").alias("author"), F.lit("SYSTEM").alias("comment_type"),
        F.concat(F.lit("Case created: "), F.col("title")).alias("content"), "created_at",
    )
    return cases, comments


def split_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a case closes in three states only."""
    bad = F.coalesce((F.col("kind") == "close") & ~F.coalesce(F.col("status").isin(*CLOSING), F.lit(False)), F.lit(False))
    return events.where(~bad), events.where(bad)


#: The fields whose last value counts, and the times whose latest does.
FIELDS = ("status", "priority", "assigned_to", "sar_reference")
TIMES = ("sar_filed_at", "closed_at", "updated_at")
#: Groups of a case's events, where there are very many events, that are folded apart first.
SALTS = 16


def case_partials(events: DataFrame, rows: int = 0) -> DataFrame:
    """What accepted events say of a case, a row a case, in a form that can be merged.

    Each field is its last non-null value with its time and sequence (ts, seq, value), each
    time the latest.  Partial maxima, so hot cases don't matter.  ``rows`` says about how many
    events there are: many are dealt to more tasks, those of a case to up to ``SALTS``.
    """
    accepted, _ = split_events(events)
    kind = F.col("kind")
    values = {
        "status": F.when(kind == "escalate", "ESCALATED").when(kind == "file_sar", "SAR_FILED").when(kind.isin("update", "close"), F.col("status")),
        "priority": F.when(kind == "escalate", "HIGH").when(kind == "update", F.col("priority")),
        "assigned_to": F.when(kind.isin("update", "assign"), F.col("assigned_to")),
        "sar_reference": F.when(kind == "file_sar", F.col("sar_reference")),
    }
    times = {
        "sar_filed_at": F.when(kind == "file_sar", F.col("ts")),
        "closed_at": F.when((kind == "close") | ((kind == "update") & F.col("status").isin(*CLOSED)), F.col("ts")),
        "updated_at": F.col("ts"),
    }
    last = (F.max(F.when(v.isNotNull(), F.struct("ts", "seq", v.alias("value")))).alias(n) for n, v in values.items())
    maxima = [*last, *(F.max(v).alias(n) for n, v in times.items())]
    if rows <= parts.ROWS_OF_A_TASK:
        return accepted.groupBy("case_id").agg(*maxima)
    salted = accepted.withColumn("_salt", F.pmod(F.xxhash64("seq"), F.lit(SALTS)))
    salted = in_parts(salted, rows, "case_id", "_salt").groupBy("case_id", "_salt").agg(*maxima)
    return merged(in_parts(salted, rows, "case_id"))


def merged(partials: DataFrame) -> DataFrame:
    return partials.groupBy("case_id").agg(*(F.max(n).alias(n) for n in (*FIELDS, *TIMES)))


def merge_partials(kept: DataFrame, new: DataFrame, rows: int = 0) -> DataFrame:
    """Partials of all events of both, in whatever order they came: older events are not read again.

    ``rows`` says about how many partials there are: many are dealt to more tasks.
    """
    return merged(in_parts(kept.unionByName(new), rows, "case_id"))


def with_partials(cases: DataFrame, partials: DataFrame, rows: int = 0) -> DataFrame:
    """cases with what the partials say: the last value of each field; any event moves updated_at.

    ``rows`` says about how many cases and partials there are: many are dealt to more tasks.
    """
    folded = partials.select("case_id", *(F.col(f"{n}.value").alias(f"_{n}") for n in FIELDS), *(F.col(n).alias(f"_{n}") for n in TIMES))
    return (
        in_parts(cases, rows, "case_id").join(in_parts(folded, rows, "case_id"), "case_id", "left")
        .withColumns(
            {
                "status": F.coalesce("_status", "status"), "priority": F.coalesce("_priority", "priority"),
                "assigned_to": F.coalesce("_assigned_to", "assigned_to"), "closed_at": F.coalesce("_closed_at", "closed_at"),
                "updated_at": F.greatest("updated_at", "_updated_at"), "sar_reference": F.col("_sar_reference"),
                "sar_filed_at": F.col("_sar_filed_at"), "sar_filed": F.col("_sar_filed_at").isNotNull(),
            }
        )
        .drop(*(f"_{n}" for n in (*FIELDS, *TIMES)))
    )


def case_state(cases: DataFrame, events: DataFrame) -> DataFrame:
    """cases with their events folded in."""
    return with_partials(cases, case_partials(events))


def newest_first(
    df: DataFrame, equal: dict[str, object], limit: int, offset: int, key: str, before: tuple[object, object] | None = None
) -> DataFrame:
    """Rows with these values, newest first, ties by key: a page as a top-k, not a full sort.

    For deep pages give ``before``, the (created_at, key) of the last row seen, in place of an offset.
    """
    out = df
    for column, value in equal.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    if before:
        at, last = F.lit(before[0]), F.lit(before[1])
        out = out.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col(key) > last)))
    return out.orderBy(F.desc("created_at"), key).offset(offset).limit(limit)


def list_cases(
    cases: DataFrame,
    status: str | None = None,
    priority: str | None = None,
    assigned_to: str | None = None,
    limit: int = 50,
    offset: int = 0,
    before: tuple[object, object] | None = None,
) -> DataFrame:
    return newest_first(cases, {"status": status, "priority": priority, "assigned_to": assigned_to}, limit, offset, "case_id", before)


def list_alerts(
    alerts: DataFrame,
    alert_type: str | None = None,
    severity: str | None = None,
    active: bool | None = None,
    limit: int = 50,
    before: tuple[object, object] | None = None,
) -> DataFrame:
    return newest_first(alerts, {"alert_type": alert_type, "severity": severity, "is_active": active}, limit, 0, "alert_id", before)


def case_timeline(comments: DataFrame) -> DataFrame:
    """Comments numbered in each case by time, with the number of each type so far."""
    order = Window.partitionBy("case_id").orderBy("created_at", "comment_id")
    of_type = Window.partitionBy("case_id", "comment_type").orderBy("created_at", "comment_id")
    return comments.withColumn("nth", F.row_number().over(order)).withColumn("nth_of_type", F.row_number().over(of_type))


def case_metrics(cases: DataFrame, as_of: str) -> DataFrame:
    """One row of figures; open cases by priority as a map of all four levels."""
    now = F.to_timestamp(F.lit(as_of))
    is_open = F.col("status") == "OPEN"
    day_ago = now - F.expr("INTERVAL 24 HOURS")
    levels = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
    counted = cases.agg(
        F.count_if(is_open).alias("total_open_cases"),
        F.count_if(F.col("status") == "UNDER_REVIEW").alias("under_review"),
        F.count_if(F.col("status") == "ESCALATED").alias("escalated"),
        F.count_if(is_open & (F.col("review_deadline") < now)).alias("overdue_cases"),
        *(F.count_if(is_open & (F.col("priority") == p)).alias(p) for p in levels),
        F.count_if(F.col("created_at") > day_ago).alias("cases_created_24h"),
        F.count_if(F.col("closed_at") > day_ago).alias("cases_closed_24h"),
    )
    by_priority = F.create_map(*(x for p in levels for x in (F.lit(p), F.col(p))))
    return counted.withColumn("cases_by_priority", by_priority).drop(*levels)


def audit_changes(events: DataFrame, fields: tuple[str, ...] = ("status", "priority", "assigned_to")) -> DataFrame:
    """One row per field that an event changes: case_id, seq, ts, field, old_value, new_value."""
    long = events.select(
        "case_id", "seq", "ts", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")
    ).select("case_id", "seq", "ts", "x.*").where("value IS NOT NULL")
    order = Window.partitionBy("case_id", "field").orderBy("ts", "seq")
    return (
        long.withColumn("old_value", F.lag("value").over(order))
        .where(F.col("old_value").isNull() | (F.col("old_value") != F.col("value")))
        .select("case_id", "seq", "ts", "field", "old_value", F.col("value").alias("new_value"))
    )
