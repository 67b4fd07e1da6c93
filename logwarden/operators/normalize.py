"""Raw events to the common event table, constraint checks and read views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import ENUMS, NOTE_MAX_CHARS, ORIGIN_PATTERN
from ..functions.text import contains_ci, event_category, event_severity
from ..fixed_values import SEARCH_COLUMNS


def normalize(df: DataFrame, strict_origin: bool = True) -> DataFrame:
    """Fill defaults and add severity and category. A missing origin is never defaulted.

    With ``strict_origin`` such a row fails the job; otherwise use :func:`split_missing_origin`.
    """

    def default(name: str, value: str) -> Column:
        return F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)

    origin = F.col("origin") if "origin" in df.columns else F.lit(None).cast("string")
    if strict_origin:
        missing = origin.isNull() | (origin == "")
        origin = F.when(missing, F.raise_error(F.lit("raw event has no origin"))).otherwise(origin)
    event = default("event", "unknown")
    replaced = {
        "event": event,
        "event_type": event_category(event),
        "severity": event_severity(event),
        "ip": default("ip", "0.0.0.0"),
        "user": default("user", "unknown"),
        "message": default("message", ""),
        "log_format": default("log_format", "syslog"),
        "origin": origin,
    }
    return df.withColumns(replaced)


def split_missing_origin(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    missing = F.col("origin").isNull() | (F.col("origin") == "")
    return df.where(~missing), df.where(missing)


def enum_violation(column: Column, name: str) -> Column:
    return ~F.coalesce(column.isin(*ENUMS[name]), F.lit(False))


def origin_violation(column: Column) -> Column:
    return ~F.coalesce(column.rlike(ORIGIN_PATTERN), F.lit(False))


def note_violation(column: Column) -> Column:
    length = F.length(F.trim(column))
    return ~F.coalesce((length > 0) & (F.length(column) <= NOTE_MAX_CHARS), F.lit(False))


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """One row per (row, broken rule)."""
    broken = F.array_compact(
        F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()])
    )
    return df.select(key, F.explode(broken).alias("rule"))


def iso_ms(ms: Column) -> Column:
    """Epoch ms to ISO-8601 text in UTC with milliseconds."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def event_view(events: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Stored events with ISO times, nested reputation and, if given, their shadow verdict."""
    flat = [c for c in ("rep_verdict", "rep_score", "rep_sources", "rep_checked", "rep_detail")]
    view = events.withColumn(
        "reputation",
        F.struct(
            F.col("rep_verdict").alias("verdict"),
            F.col("rep_score").alias("score"),
            F.from_json("rep_sources", "array<string>").alias("sources"),
            F.col("rep_checked").cast("boolean").alias("checked"),
            F.col("rep_detail").alias("detail"),
        ),
    ).withColumn("dropped", F.col("dropped").cast("boolean"))
    view = view.withColumn("timestamp", iso_ms(F.col("ts_ms"))).withColumn(
        "ingested_at", iso_ms(F.col("ingested_ts_ms"))
    )
    view = view.drop(*flat, "ts_ms", "ingested_ts_ms")
    if verdicts is None:
        return view
    return view.join(
        verdicts.withColumnRenamed("event_id", "id"), "id", "left"
    )


def search_events(
    df: DataFrame,
    limit: int = 100,
    severity: str | None = None,
    source: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """Newest matching events; the limit is the report's size."""
    if severity:
        df = df.where(F.col("severity") == severity)
    if source:
        df = df.where(F.col("source") == source)
    if search:
        condition = F.lit(False)
        for name in SEARCH_COLUMNS:
            condition = condition | F.coalesce(contains_ci(F.col(name), search), F.lit(False))
        df = df.where(condition)
    return df.orderBy(F.desc("id")).limit(limit)


def has_real_origin(events: DataFrame) -> DataFrame:
    """One row: is there any event that is not synthetic? Reads until the first hit."""
    first = events.where(F.col("origin") != "synthetic").select(F.lit(1).alias("hit")).limit(1)
    return first.agg((F.count("hit") > 0).alias("has_real_origin"))
