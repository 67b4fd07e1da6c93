"""Queries: dashboard aggregates, listings, views, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, dashboard, metrics, normalize, ordering, response
from ..sources.parsers import multi_source
from .catalog import query
from .testdata import ALERTS_SQL, AS_OF_MS, EVENTS_SQL, actor_events, alerts, sql, table

TIMELINE_BUCKETS, TIMELINE_SECONDS = 400, 7200


@query(
    "timeline_buckets",
    sql(
        ALERTS_SQL,
        f"""SELECT b.bucket, strftime(make_timestamp(({AS_OF_MS} - {TIMELINE_BUCKETS * TIMELINE_SECONDS * 1000}
              + (b.bucket + 1) * {TIMELINE_SECONDS * 1000}) * 1000), '%H:%M:%S') AS time,
            (SELECT count(*) FROM ev WHERE (ingested_ts_ms - ({AS_OF_MS} - {TIMELINE_BUCKETS * TIMELINE_SECONDS * 1000}))
               // {TIMELINE_SECONDS * 1000} = b.bucket AND ingested_ts_ms >= {AS_OF_MS} - {TIMELINE_BUCKETS * TIMELINE_SECONDS * 1000}
               AND ingested_ts_ms < {AS_OF_MS}) AS logs,
            (SELECT count(*) FROM alerts WHERE (ts_ms - ({AS_OF_MS} - {TIMELINE_BUCKETS * TIMELINE_SECONDS * 1000}))
               // {TIMELINE_SECONDS * 1000} = b.bucket AND ts_ms >= {AS_OF_MS} - {TIMELINE_BUCKETS * TIMELINE_SECONDS * 1000}
               AND ts_ms < {AS_OF_MS}) AS alerts
            FROM (SELECT unnest(range({TIMELINE_BUCKETS})) AS bucket) b""",
    ),
)
def timeline_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.timeline(
        actor_events(spark, sf), alerts(spark, sf), AS_OF_MS, TIMELINE_BUCKETS, TIMELINE_SECONDS
    )


@query(
    "severity_distribution",
    sql(
        ALERTS_SQL,
        """SELECT count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'medium') AS medium,
           count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'critical') AS critical,
           count(*) FILTER (WHERE severity IN ('high', 'critical')) AS high_severity_alerts FROM alerts""",
    ),
)
def severity_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.severity_distribution(alerts(spark, sf))


@query(
    "recent_event_distribution",
    sql(EVENTS_SQL, "SELECT event, count(*) AS n FROM (SELECT event FROM ev ORDER BY id DESC LIMIT 200) GROUP BY event"),
)
def recent_event_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.recent_distribution(actor_events(spark, sf), "event")


@query(
    "recent_source_distribution",
    sql(EVENTS_SQL, "SELECT source, count(*) AS n FROM (SELECT source FROM ev ORDER BY id DESC LIMIT 200) GROUP BY source"),
)
def recent_source_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.recent_distribution(actor_events(spark, sf), "source")


@query("origin_distribution", sql(EVENTS_SQL, "SELECT origin, count(*) AS n FROM ev GROUP BY origin"))
def origin_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.distribution(actor_events(spark, sf), "origin")


@query(
    "retained_counts",
    sql(
        ALERTS_SQL,
        """SELECT 'events' AS "table", count(*) AS rows FROM ev UNION ALL SELECT 'alerts', count(*) FROM alerts
           UNION ALL SELECT 'blocks', count(*) FROM ev""",
    ),
)
def retained_counts(spark: SparkSession, sf: str) -> DataFrame:
    events = actor_events(spark, sf)
    return dashboard.retained_counts({"events": events, "alerts": alerts(spark, sf), "blocks": events})


@query(
    "counters",
    sql(
        EVENTS_SQL,
        """SELECT name, CAST(sum(value) AS BIGINT) AS value FROM (
             SELECT 'events' AS name, count(*) AS value FROM ev
             UNION ALL SELECT event, count(*) FROM ev GROUP BY event
             UNION ALL SELECT unnest(['events', 'alerts', 'blocks', 'soar']), 0) GROUP BY name""",
    ),
)
def counters(spark: SparkSession, sf: str) -> DataFrame:
    events = actor_events(spark, sf)
    first = events.where("origin = 'synthetic'").agg(F.count("*").alias("value")).select(F.lit("events").alias("name"), "value")
    second = events.where("origin <> 'synthetic'").agg(F.count("*").alias("value")).select(F.lit("events").alias("name"), "value")
    by_event = events.groupBy(F.col("event").alias("name")).agg(F.count("*").alias("value"))
    totals = dashboard.add_counters(dashboard.empty_counters(spark), first)
    return dashboard.add_counters(totals, second.unionByName(by_event))


@query("known_sources", sql(EVENTS_SQL, "SELECT DISTINCT source FROM ev ORDER BY source LIMIT 100"))
def known_sources(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.known_values(actor_events(spark, sf), "source")


@query(
    "top_event_types",
    sql(EVENTS_SQL, "SELECT event, count(*) AS n FROM ev GROUP BY event ORDER BY n DESC, event LIMIT 8"),
)
def top_event_types(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.top_values(actor_events(spark, sf), "event")


@query(
    "recent_alerts",
    sql(ALERTS_SQL, "SELECT alert_id, ip, event, ts_ms FROM alerts ORDER BY alert_id DESC LIMIT 500"),
)
def recent_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.recent(alerts(spark, sf), 5000, "alert_id", highest=500).select("alert_id", "ip", "event", "ts_ms")


@query(
    "search_events",
    sql(
        EVENTS_SQL,
        """SELECT id, ip, event, source, message FROM ev WHERE severity = 'high' AND source = 'host3' AND (
           contains(lower(message), 'k": 4') OR contains(lower(ip), 'k": 4') OR contains(lower("user"), 'k": 4')
           OR contains(lower(event), 'k": 4') OR contains(lower(source), 'k": 4')
           OR contains(lower(severity), 'k": 4') OR contains(lower(origin), 'k": 4'))
           ORDER BY id DESC LIMIT 100""",
    ),
)
def search_events(spark: SparkSession, sf: str) -> DataFrame:
    found = normalize.search_events(actor_events(spark, sf), severity="high", source="host3", search='K": 4')
    return found.select("id", "ip", "event", "source", "message")


@query(
    "has_real_origin",
    sql(EVENTS_SQL, "SELECT bool_or(origin <> 'synthetic') AS has_real_origin FROM ev"),
)
def has_real_origin(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.has_real_origin(actor_events(spark, sf))


@query(
    "normalize_events",
    """SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE m.event END AS event,
         CASE WHEN event_id % 11 = 0 THEN 'low' ELSE m.severity END AS severity,
         CASE WHEN event_id % 11 = 0 THEN 'other' ELSE m.category END AS event_type,
         CASE WHEN event_id % 4 = 0 THEN '0.0.0.0' ELSE '10.0.0.1' END AS ip, 'unknown' AS "user",
         CASE WHEN event_id % 3 = 0 THEN '' ELSE props END AS message, 'syslog' AS log_format, 'syslog' AS origin
       FROM events JOIN (VALUES
         (0,'login_success','low','authentication'),(1,'failed_login','medium','authentication'),
         (2,'auth_invalid_user','medium','authentication'),(3,'brute_force','critical','attack'),
         (4,'suspicious_ip','high','network'),(5,'port_scan','high','reconnaissance'),
         (6,'malware_detected','critical','malware'),(7,'file_access','low','file_system'),
         (8,'privilege_escalation','critical','attack'),(9,'data_exfiltration','critical','data_leak'),
         (10,'normal_traffic','low','network'),(11,'log_debug','low','application'),
         (12,'log_info','low','application'),(13,'log_notice','low','application'),
         (14,'log_warning','medium','application'),(15,'log_error','high','application'),
         (16,'log_critical','critical','application'),(17,'log_alert','critical','application'),
         (18,'log_emergency','critical','application'),(19,'something_else','low','other')
       ) AS m(k, event, severity, category) ON m.k = user_id % 20""",
)
def normalize_events(spark: SparkSession, sf: str) -> DataFrame:
    names = [
        "login_success", "failed_login", "auth_invalid_user", "brute_force", "suspicious_ip", "port_scan",
        "malware_detected", "file_access", "privilege_escalation", "data_exfiltration", "normal_traffic",
        "log_debug", "log_info", "log_notice", "log_warning", "log_error", "log_critical", "log_alert",
        "log_emergency", "something_else",
    ]
    raw = table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 11 != 0, F.get(F.array(*[F.lit(n) for n in names]), (F.col("user_id") % 20).cast("int"))).alias("event"),
        F.when(F.col("event_id") % 4 != 0, "10.0.0.1").alias("ip"),
        F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("message"),
        F.lit("syslog").alias("origin"),
    )
    return normalize.normalize(raw).select(
        "id", "event", "severity", "event_type", "ip", "user", "message", "log_format", "origin"
    )


@query(
    "constraint_violations",
    """SELECT event_id AS id, unnest(list_filter([
         CASE WHEN user_id % 6 = 0 THEN 'severity' END,
         CASE WHEN user_id % 7 IN (0, 1, 2) THEN 'origin' END,
         CASE WHEN user_id % 5 IN (0, 4) THEN 'note' END,
         CASE WHEN event_type = 'view' THEN 'status' END], lambda x: x IS NOT NULL)) AS rule FROM events""",
)
def constraint_violations(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id")
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.when(user % 6 == 0, "urgent").otherwise("low").alias("severity"),
        F.when(user % 7 == 0, "replay:").when(user % 7 == 1, "SYSLOG").when(user % 7 == 2, None)
        .when(user % 7 == 3, "replay:x").otherwise("file").alias("origin"),
        F.when(user % 5 == 0, "   ").when(user % 5 == 4, F.repeat(F.lit("x"), 501)).otherwise("fine").alias("note"),
        F.when(F.col("event_type") == "view", F.lit("gone")).otherwise("open").alias("status"),
    )
    rules = {
        "severity": normalize.enum_violation(F.col("severity"), "severity"),
        "origin": normalize.origin_violation(F.col("origin")),
        "note": normalize.note_violation(F.col("note")),
        "status": normalize.enum_violation(F.col("status"), "status"),
    }
    return normalize.violations(rows, rules, "id")


@query(
    "event_view",
    sql(
        EVENTS_SQL,
        """SELECT id, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp,
           id % 4 = 0 AS dropped, CASE WHEN rep_hundredths > 0 THEN 'tor_exit' ELSE 'unlisted' END AS verdict,
           rep_hundredths / 100.0::DOUBLE AS score, CASE WHEN rep_hundredths > 0 THEN 'a,b' ELSE '' END AS sources,
           user_id % 2 = 0 AS checked, CASE WHEN id % 3 <> 0 THEN 'scored' END AS shadow_status FROM ev""",
    ),
)
def event_view(spark: SparkSession, sf: str) -> DataFrame:
    events = actor_events(spark, sf)
    listed = F.col("rep_hundredths") > 0
    stored = events.select(
        "id", "ts_ms", "ingested_ts_ms", "event", "ip",
        F.when(F.col("id") % 4 == 0, 1).otherwise(0).alias("dropped"),
        F.when(listed, "tor_exit").otherwise("unlisted").alias("rep_verdict"),
        (F.col("rep_hundredths") / F.lit(100.0)).alias("rep_score"),
        F.when(listed, '["a", "b"]').otherwise("[]").alias("rep_sources"),
        F.when(F.col("user_id") % 2 == 0, 1).otherwise(0).alias("rep_checked"),
        F.lit("").alias("rep_detail"),
    )
    verdicts = events.where("id % 3 <> 0").select(F.col("id").alias("event_id"), F.lit("scored").alias("shadow_status"))
    view = normalize.event_view(stored, verdicts)
    return view.select(
        "id", "timestamp", "dropped", F.col("reputation.verdict").alias("verdict"),
        F.col("reputation.score").alias("score"), F.array_join("reputation.sources", ",").alias("sources"),
        F.col("reputation.checked").alias("checked"), "shadow_status",
    )


@query(
    "multi_source_union",
    sql(
        EVENTS_SQL,
        """SELECT origin, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (
             SELECT id, 'file' AS origin FROM ev UNION ALL SELECT o_orderkey, 'replay:hdfs' FROM orders
             UNION ALL SELECT id, 'syslog' FROM (SELECT row_number() OVER (ORDER BY conv_id, turn) AS id FROM conversations)) GROUP BY origin""",
    ),
)
def multi_source_union(spark: SparkSession, sf: str) -> DataFrame:
    merged = multi_source(
        actor_events(spark, sf).select("id", "ip", F.lit("file").alias("origin")),
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("replay:hdfs").alias("origin")),
        ordering.with_ordinal(table(spark, sf, "conversations"), "conv_id", "id", width=10_000, ties=("turn",)).select(
            "id", F.lit("syslog").alias("origin")
        ),
    )
    return merged.groupBy("origin").agg(
        F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


RETENTION_HOURS = 240
RETENTION_SQL = ALERTS_SQL + f""",
old AS (SELECT * FROM ev WHERE ingested_ts_ms < {AS_OF_MS} - {RETENTION_HOURS} * 3600000),
pruned AS (SELECT * FROM old WHERE id NOT IN (SELECT event_id FROM alerts))"""


@query("retention_prune", sql(RETENTION_SQL, "SELECT id, ip, ingested_ts_ms FROM pruned"))
def retention_prune(spark: SparkSession, sf: str) -> DataFrame:
    _, gone = response.split_retention(actor_events(spark, sf), alerts(spark, sf), RETENTION_HOURS, AS_OF_MS)
    return gone.select("id", "ip", "ingested_ts_ms")


@query(
    "retention_keep",
    sql(RETENTION_SQL, "SELECT id, ip, ingested_ts_ms FROM ev WHERE id NOT IN (SELECT id FROM pruned)"),
)
def retention_keep(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = response.split_retention(actor_events(spark, sf), alerts(spark, sf), RETENTION_HOURS, AS_OF_MS)
    return kept.select("id", "ip", "ingested_ts_ms")


@query(
    "recent_per_actor",
    sql(
        EVENTS_SQL,
        "SELECT ip, id, rank FROM (SELECT ip, id, row_number() OVER (PARTITION BY ip ORDER BY id DESC) AS rank FROM ev) "
        "WHERE rank <= 20",
    ),
)
def recent_per_actor(spark: SparkSession, sf: str) -> DataFrame:
    return response.recent_per_actor(actor_events(spark, sf)).select("ip", "id", F.col("rank").cast("long").alias("rank"))


@query(
    "stage_percentiles",
    sql(
        EVENTS_SQL,
        """SELECT event AS stage, count(*) AS samples, quantile_disc(value, 0.5) AS p50,
           CASE WHEN count(*) >= 20 THEN quantile_disc(value, 0.95) END AS p95
           FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY id DESC) AS r FROM ev) WHERE r <= 512
           GROUP BY event""",
    ),
)
def stage_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    samples = actor_events(spark, sf).select(F.col("event").alias("stage"), "value", "id")
    return metrics.stage_percentiles(samples, "stage", "value", "id", 512)


RATE_AS_OF, RATE_SECONDS = 1_705_276_800_000, 36_000


@query(
    "events_per_second",
    sql(
        EVENTS_SQL,
        f"""SELECT count(*) AS events, round(count(*) / (({RATE_AS_OF} - min(ingested_ts_ms)) / 1000.0::DOUBLE), 3) AS per_second
            FROM ev WHERE ingested_ts_ms BETWEEN {RATE_AS_OF - RATE_SECONDS * 1000} AND {RATE_AS_OF}""",
    ),
)
def events_per_second(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.event_rate(actor_events(spark, sf), "ingested_ts_ms", RATE_AS_OF, RATE_SECONDS)


@query(
    "alert_with_event",
    sql(
        ALERTS_SQL,
        "SELECT alert_id, e.id AS event_id, e.message AS event_message, e.source AS event_source FROM alerts a JOIN ev e ON e.id = a.event_id",
    ),
)
def alert_with_event(spark: SparkSession, sf: str) -> DataFrame:
    joined = response.alert_with_event(
        alerts(spark, sf).select("alert_id", "event_id"), actor_events(spark, sf).select("id", "message", "source")
    )
    return joined.select("alert_id", "event_id", "event_message", "event_source")


@query(
    "matrix_digest",
    """SELECT count(*) AS rows, count(DISTINCT sha256(l_orderkey || '|' || l_linenumber)) > 0 AS has_digest
       FROM lineitem""",
)
def matrix_digest(spark: SparkSession, sf: str) -> DataFrame:
    """The digest itself has no SQL twin; equality under reordering is part of the checked value."""
    lines = table(spark, sf, "lineitem")
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
    one = blocks.table_digest(lines, cols)
    other = blocks.table_digest(lines.repartition("l_suppkey"), cols)
    return one.join(other.withColumnRenamed("rows", "rows2"), "digest").select(
        "rows", (F.length("digest") == 64).alias("has_digest")
    )


PAGE_CURSOR = 400


@query(
    "review_page",
    f"""WITH r AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, role FROM conversations),
        p AS (SELECT id, role FROM r WHERE id < {PAGE_CURSOR} ORDER BY id DESC LIMIT 100)
        SELECT id, role, true AS has_more, (SELECT min(id) FROM p) AS next_cursor FROM p""",
)
def review_page(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    numbered = ordering.with_ordinal(turns, "conv_id", "id", width=10_000, ties=("turn",)).select("id", "role")
    page, info = ordering.keyset_page(numbered, "id", PAGE_CURSOR, 100)
    return page.withColumn("info", info.select(F.struct("*")).scalar()).select("id", "role", "info.*")


