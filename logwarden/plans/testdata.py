"""Security-log tables derived from the benchmark tables, in Spark and in SQL.

Every function reads whole tables. The SQL text next to each says the same in DuckDB's dialect, so
that a query and its oracle start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.net import long_to_ip
from ..functions.text import event_category, event_severity

# The tables span 30 days with hours between events of one actor, so windows are days, not seconds.
WINDOW_S = 72 * 3600
COOLDOWN_S = 6 * 3600
BLOCK_TTL_S = 48 * 3600
AS_OF_MS = 1_706_659_200_000  # 2024-01-31T00:00:00Z, just after the last event
ACTOR_BASE = 754_974_721  # 45.0.0.1
ACTOR_STEP = 4099
HOT_IP = "45.0.0.1"  # half of all rows on one address: what one busy source does to a log


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def ip_sql(value: str) -> str:
    parts = [f"CAST((({value}) >> {s}) & 255 AS VARCHAR)" for s in (24, 16, 8, 0)]
    return "(" + " || '.' || ".join(parts) + ")"


def mix(key: Column, salt: int) -> Column:
    """A 32-bit address spread over all ranges."""
    return F.pmod(key * F.lit(2654435761) + F.lit(salt), F.lit(4294967296))


def mix_sql(key: str, salt: int) -> str:
    return f"((CAST({key} AS BIGINT) * 2654435761 + {salt}) % 4294967296)"


EVENT_NAMES = {
    "error": "failed_login",
    "signup": "login_success",
    "click": "normal_traffic",
    "view": "file_access",
    "purchase": "suspicious_ip",
}


def actor_events(spark: SparkSession, sf: str) -> DataFrame:
    """The ``events`` table as normalised security events."""
    return actor_events_of(table(spark, sf, "events"))


def hot_address(df: DataFrame) -> DataFrame:
    return df.withColumn("ip", F.when(F.col("user_id") % 2 == 0, HOT_IP).otherwise(F.col("ip")))


def actor_events_of(e: DataFrame) -> DataFrame:
    event = F
    for raw, name in EVENT_NAMES.items():
        event = event.when(F.col("event_type") == raw, name)
    user = F.col("user_id")
    origin = (
        F.when(user % 5 == 0, "syslog").when(user % 5 == 1, "file").when(user % 5 == 2, "replay:hdfs")
        .otherwise("synthetic")
    )
    return e.select(
        F.col("event_id").alias("id"),
        epoch_ms(F.col("ts")).alias("ts_ms"),
        epoch_ms(F.col("ts")).alias("ingested_ts_ms"),
        F.concat(F.lit("host"), (user % 12).cast("string")).alias("source"),
        event.otherwise("unknown").alias("event"),
        long_to_ip(user * ACTOR_STEP + ACTOR_BASE).alias("ip"),
        F.concat(F.lit("user"), user.cast("string")).alias("user"),
        F.concat("event_type", F.lit(" "), "props").alias("message"),
        F.lit("syslog").alias("log_format"),
        origin.alias("origin"),
        F.when(user % 25 == 0, 40).otherwise(0).alias("rep_hundredths"),
        F.col("user_id"),
        F.col("value"),
    ).withColumns(
        {"event_type": event_category(F.col("event")), "severity": event_severity(F.col("event"))}
    )


EVENTS_SQL = f"""
ev AS (
  SELECT event_id AS id, epoch_us(ts) // 1000 AS ts_ms, epoch_us(ts) // 1000 AS ingested_ts_ms,
    'host' || CAST(user_id % 12 AS VARCHAR) AS source,
    CASE event_type WHEN 'error' THEN 'failed_login' WHEN 'signup' THEN 'login_success'
      WHEN 'click' THEN 'normal_traffic' WHEN 'view' THEN 'file_access'
      WHEN 'purchase' THEN 'suspicious_ip' ELSE 'unknown' END AS event,
    CASE event_type WHEN 'error' THEN 'authentication' WHEN 'signup' THEN 'authentication'
      WHEN 'click' THEN 'network' WHEN 'view' THEN 'file_system'
      WHEN 'purchase' THEN 'network' ELSE 'other' END AS event_type,
    CASE event_type WHEN 'error' THEN 'medium' WHEN 'purchase' THEN 'high' ELSE 'low' END AS severity,
    {ip_sql(f"user_id * {ACTOR_STEP} + {ACTOR_BASE}")} AS ip,
    'user' || CAST(user_id AS VARCHAR) AS "user",
    event_type || ' ' || props AS message, 'syslog' AS log_format,
    CASE user_id % 5 WHEN 0 THEN 'syslog' WHEN 1 THEN 'file' WHEN 2 THEN 'replay:hdfs'
      ELSE 'synthetic' END AS origin,
    CASE WHEN user_id % 25 = 0 THEN 40 ELSE 0 END AS rep_hundredths, user_id, value
  FROM events
)"""

WINDOWS_SQL = EVENTS_SQL + f""",
win AS (
  SELECT *,
    count(*) FILTER (WHERE event = 'failed_login') OVER w AS failed_attempts_count,
    count(*) OVER w AS request_frequency
  FROM ev
  WINDOW w AS (PARTITION BY ip ORDER BY ingested_ts_ms
               RANGE BETWEEN {WINDOW_S * 1000 - 1} PRECEDING AND CURRENT ROW)
)"""

SCORED_SQL = WINDOWS_SQL + """,
pts AS (
  SELECT *,
    CASE WHEN failed_attempts_count >= 5 THEN 40 WHEN failed_attempts_count >= 3 THEN 20 ELSE 0 END AS fp,
    CASE WHEN event = 'suspicious_ip' THEN 35 ELSE 0 END AS ep,
    CASE WHEN request_frequency > 15 THEN 20 WHEN request_frequency > 8 THEN 10 ELSE 0 END AS qp
  FROM win
),
scored AS (
  SELECT *, least(100, rep_hundredths + fp + ep + qp) AS score_hundredths FROM pts
)"""

# Alerts without cooldown and without blocks: every row that reaches the threshold.
CANDIDATES_SQL = SCORED_SQL + """,
cand AS (SELECT * FROM scored WHERE score_hundredths >= 45)"""

COOLDOWN_SQL = CANDIDATES_SQL + f""",
sel(ip, event, id, ms) AS (
  SELECT ip, event, arg_min(id, ingested_ts_ms), min(ingested_ts_ms) FROM cand GROUP BY ip, event
  UNION ALL
  SELECT s.ip, s.event, n.id, n.ms FROM sel s,
    LATERAL (SELECT arg_min(c.id, c.ingested_ts_ms) AS id, min(c.ingested_ts_ms) AS ms FROM cand c
             WHERE c.ip = s.ip AND c.event = s.event
               AND c.ingested_ts_ms >= s.ms + {COOLDOWN_S * 1000}) n
  WHERE n.id IS NOT NULL
)"""


def scored_events(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.rules import rule_windows, score_rules

    windows = {"failed_seconds": WINDOW_S, "frequency_seconds": WINDOW_S}
    return score_rules(rule_windows(actor_events(spark, sf), **windows), rules={}, **windows)


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return scored_events(spark, sf).where("is_anomaly").withColumn("ruleset_version", F.lit("rules"))


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alert rows of every candidate (no cooldown): the table the read views work on."""
    from ..operators.rules import make_alerts

    return make_alerts(candidates(spark, sf))


ALERTS_SQL = CANDIDATES_SQL + """,
alerts AS (
  SELECT id AS alert_id, id AS event_id, ingested_ts_ms AS ts_ms, event, ip, source, "user",
    severity, message, origin, score_hundredths, 'open' AS status, 'new' AS review_status
  FROM cand
)"""


def sql(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"
