"""Dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import LIFETIME_COUNTERS, RECENT_WINDOW, SEVERITIES


def add_counters(totals: DataFrame, batch: DataFrame) -> DataFrame:
    """Lifetime totals (name, value) plus a batch's; totals never fall, and four names always exist."""
    spark = totals.sparkSession
    zeros = spark.createDataFrame([(n, 0) for n in LIFETIME_COUNTERS], "name string, value long")
    parts = zeros.unionByName(totals).unionByName(batch)
    return parts.groupBy("name").agg(F.sum("value").alias("value"))


def timeline(
    events: DataFrame, alerts: DataFrame, as_of_ms: int, buckets: int = 30, seconds: int = 10,
    event_ts: str = "ingested_ts_ms", alert_ts: str = "ts_ms",
) -> DataFrame:
    """Events and alerts per time bucket before ``as_of_ms``; empty buckets are rows too."""
    width = seconds * 1000
    start = as_of_ms - buckets * width

    def part(df: DataFrame, ts: str, logs: int, hits: int) -> DataFrame:
        inside = df.where((F.col(ts) >= start) & (F.col(ts) < as_of_ms))
        bucket = F.floor((F.col(ts) - F.lit(start)) / F.lit(width)).cast("long").alias("bucket")
        return inside.select(bucket, F.lit(logs).alias("l"), F.lit(hits).alias("a"))

    both = part(events, event_ts, 1, 0).unionByName(part(alerts, alert_ts, 0, 1))
    counted = both.groupBy("bucket").agg(F.sum("l").alias("logs"), F.sum("a").alias("alerts"))
    spine = events.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    end = F.lit(start) + (F.col("bucket") + 1) * F.lit(width)
    return spine.join(counted, "bucket", "left").select(
        "bucket",
        F.date_format(F.timestamp_millis(end), "HH:mm:ss").alias("time"),
        F.coalesce("logs", F.lit(0)).alias("logs"),
        F.coalesce("alerts", F.lit(0)).alias("alerts"),
    )


def severity_distribution(alerts: DataFrame) -> DataFrame:
    """One row with every severity, zero when absent, and high plus critical."""
    cells = [F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES]
    return alerts.agg(*cells).withColumn("high_severity_alerts", F.col("critical") + F.col("high"))


def distribution(df: DataFrame, col: str, last_n: int | None = None, order: str = "id") -> DataFrame:
    """Rows per value, over everything or over the newest ``last_n`` rows (a recent-window report)."""
    rows = df if last_n is None else df.select(col, order).orderBy(F.desc(order)).limit(last_n)
    return rows.groupBy(col).agg(F.count("*").alias("n"))


def recent_distribution(df: DataFrame, col: str) -> DataFrame:
    return distribution(df, col, RECENT_WINDOW)


def retained_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counted = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    out = counted[0]
    for other in counted[1:]:
        out = out.unionByName(other)
    return out


def distinct_count(df: DataFrame, col: str, approximate: bool = False) -> DataFrame:
    measure: Column = F.approx_count_distinct(col) if approximate else F.countDistinct(col)
    return df.agg(measure.alias(f"distinct_{col}"))


def known_values(df: DataFrame, col: str, limit: int = 100) -> DataFrame:
    """First ``limit`` distinct values in order: a filter list."""
    return df.select(col).distinct().orderBy(col).limit(limit)


def top_values(df: DataFrame, col: str, n: int = 8) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(n)


def recent(df: DataFrame, limit: int, order: str = "id", lowest: int = 1, highest: int = 1000) -> DataFrame:
    """Newest rows; the asked-for number is clamped to the allowed range."""
    return df.orderBy(F.desc(order)).limit(max(lowest, min(highest, limit)))


def empty_counters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "name string, value long")
