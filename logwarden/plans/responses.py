"""Queries: playbooks, responses, the blocklist, review, incident evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import response
from ..operators.ordering import with_ordinal
from .catalog import query
from .testdata import ALERTS_SQL, BLOCK_TTL_S, HOT_IP, actor_events, alerts, hot_address, sql, table

# Orders stand for alerts of every event type; seven types, the last without a playbook.
ALERT_TYPES = (
    "brute_force", "data_exfiltration", "malware_detected", "port_scan", "privilege_escalation",
    "suspicious_ip", "failed_login",
)
TYPED_SQL = """
al AS (
  SELECT o_orderkey AS alert_id, '10.0.' || (o_custkey % 200) || '.1' AS ip, 'u{' || (o_custkey % 50) || '}' AS "user",
    'host' || (o_custkey % 9) AS source, epoch_us(o_orderdate) // 1000 AS ts_ms, list_extract(['brute_force',
    'data_exfiltration', 'malware_detected', 'port_scan', 'privilege_escalation', 'suspicious_ip', 'failed_login'],
    o_custkey % 7 + 1) AS event FROM orders
)"""


def typed_alerts(spark: SparkSession, sf: str) -> DataFrame:
    cust = F.col("o_custkey")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("alert_id"),
        F.concat(F.lit("10.0."), (cust % 200).cast("string"), F.lit(".1")).alias("ip"),
        F.concat(F.lit("u{"), (cust % 50).cast("string"), F.lit("}")).alias("user"),
        F.concat(F.lit("host"), (cust % 9).cast("string")).alias("source"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"),
        F.get(F.array(*[F.lit(t) for t in ALERT_TYPES]), (cust % 7).cast("int")).alias("event"),
    )


@query(
    "playbook_assign",
    f"""WITH {TYPED_SQL} SELECT alert_id, event, CASE event WHEN 'brute_force' THEN 'Brute force containment'
        WHEN 'data_exfiltration' THEN 'Data exfiltration response' WHEN 'malware_detected' THEN 'Malware response'
        WHEN 'port_scan' THEN 'Port scan containment' WHEN 'privilege_escalation' THEN 'Privilege escalation response'
        WHEN 'suspicious_ip' THEN 'Flagged address containment' ELSE 'Default notification' END AS playbook,
        CASE WHEN event IN ('port_scan', 'suspicious_ip') THEN 'P2' WHEN event = 'failed_login' THEN 'P3' ELSE 'P1' END AS priority FROM al""",
)
def playbook_assign(spark: SparkSession, sf: str) -> DataFrame:
    assigned = response.assign_playbook(typed_alerts(spark, sf), response.policy_table(spark))
    return assigned.select("alert_id", "event", F.col("playbook.name").alias("playbook"), F.col("playbook.priority").alias("priority"))


STEPS_SQL = """
st(event, position, action, required, ttl_seconds, reason, message) AS (VALUES
  ('brute_force', 0, 'block_ip', true, 3600, 'repeated authentication failures', NULL),
  ('brute_force', 1, 'incident_report', true, NULL, NULL, NULL),
  ('brute_force', 2, 'webhook', false, NULL, NULL, NULL),
  ('brute_force', 3, 'notify', false, NULL, NULL, 'security team paged for brute force from {ip}'),
  ('data_exfiltration', 0, 'block_ip', true, 7200, 'large transfer to an external address', NULL),
  ('data_exfiltration', 1, 'incident_report', true, NULL, NULL, NULL),
  ('data_exfiltration', 2, 'webhook', false, NULL, NULL, NULL),
  ('malware_detected', 0, 'incident_report', true, NULL, NULL, NULL),
  ('malware_detected', 1, 'webhook', false, NULL, NULL, NULL),
  ('malware_detected', 2, 'notify', false, NULL, NULL, 'malware signature reported from {ip} — host isolation NOT performed'),
  ('port_scan', 0, 'block_ip', true, 900, 'sequential port scan', NULL),
  ('port_scan', 1, 'notify', false, NULL, NULL, 'port scan from {ip}'),
  ('privilege_escalation', 0, 'incident_report', true, NULL, NULL, NULL),
  ('privilege_escalation', 1, 'webhook', false, NULL, NULL, NULL),
  ('privilege_escalation', 2, 'notify', false, NULL, NULL, 'privilege escalation by {user} on {source} — session NOT terminated'),
  ('suspicious_ip', 0, 'block_ip', true, 1800, 'address appears on a cached public threat feed', NULL),
  ('suspicious_ip', 1, 'webhook', false, NULL, NULL, NULL),
  ('suspicious_ip', 2, 'notify', false, NULL, NULL, 'connection from flagged address {ip}'),
  ('failed_login', 0, 'notify', false, NULL, NULL, '{event} from {ip} — no playbook is defined for this event type'))"""
PLAN_SQL = f"""{TYPED_SQL}, {STEPS_SQL},
plan AS (
  SELECT alert_id, ip, al.event, ts_ms, CAST(position AS INTEGER) AS position, action, required, CAST(ttl_seconds AS BIGINT) AS ttl_seconds, reason,
    replace(replace(replace(replace(message, '{{ip}}', ip), '{{event}}', al.event), '{{source}}', source), '{{user}}', "user") AS message
  FROM al JOIN st ON st.event = al.event
)"""


def plan(spark: SparkSession, sf: str) -> DataFrame:
    return response.response_plan(typed_alerts(spark, sf), response.policy_table(spark))


@query("response_plan", f"WITH {PLAN_SQL} SELECT alert_id, position, action, required, ttl_seconds, reason, message FROM plan")
def response_plan(spark: SparkSession, sf: str) -> DataFrame:
    return plan(spark, sf).select("alert_id", "position", "action", "required", "ttl_seconds", "reason", "message")


# Step outcomes by arithmetic: webhooks are skipped, some steps fail.
OUTCOME_SQL = f"""{PLAN_SQL},
outc AS (
  SELECT alert_id AS execution_id, alert_id, position, action, required,
    CASE WHEN action = 'webhook' THEN 'skipped' WHEN (alert_id + position) % 11 = 0 THEN 'failed'
      WHEN (alert_id + position) % 7 = 0 THEN 'skipped' ELSE 'executed' END AS status FROM plan
)"""


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("alert_id") + F.col("position")
    status = F.when(F.col("action") == "webhook", "skipped").when(key % 11 == 0, "failed").when(key % 7 == 0, "skipped").otherwise("executed")
    return plan(spark, sf).select(
        F.col("alert_id").alias("execution_id"), "alert_id", "position", "action", "required", status.alias("status")
    )


STATUS_SQL = f"""{OUTCOME_SQL},
stat AS (
  SELECT execution_id, CASE WHEN bool_or(status = 'failed' AND required) THEN 'action_failed'
    WHEN bool_or(status = 'executed' AND action = 'block_ip') THEN 'contained'
    WHEN bool_or(status = 'executed') AND bool_or(required AND action = 'block_ip') THEN 'mitigated' ELSE 'open' END AS status
  FROM outc GROUP BY execution_id
)"""


@query("response_status", f"WITH {STATUS_SQL} SELECT execution_id, status FROM stat")
def response_status(spark: SparkSession, sf: str) -> DataFrame:
    return response.response_status(outcomes(spark, sf))


@query(
    "response_view",
    f"""WITH {OUTCOME_SQL} SELECT execution_id, string_agg(action, ',' ORDER BY position) AS playbook_steps,
        string_agg(CASE WHEN action = 'webhook' THEN 'webhook ' || status ELSE 'did ' || action END, ',' ORDER BY position) AS details,
        count(*) FILTER (WHERE status = 'executed') AS ran_steps FROM outc GROUP BY execution_id""",
)
def response_view(spark: SparkSession, sf: str) -> DataFrame:
    steps = outcomes(spark, sf).withColumns(
        {
            "executed": F.col("status") == "executed",
            "detail": F.when(F.col("action") == "webhook", "https://secret").otherwise(F.concat(F.lit("did "), "action")),
        }
    )
    executions = typed_alerts(spark, sf).select(F.col("alert_id").alias("execution_id"))
    view = response.response_view(executions, steps)
    return view.select(
        "execution_id", F.array_join("playbook_steps", ",").alias("playbook_steps"),
        F.array_join(F.transform("steps", lambda s: s["detail"]), ",").alias("details"), "ran_steps",
    )


@query(
    "alert_view",
    sql(
        ALERTS_SQL,
        """SELECT a.alert_id, a.ip, r.execution_id, r.status AS response_status FROM alerts a LEFT JOIN (
             SELECT alert_id, max(execution_id) AS execution_id, 'run' || (max(execution_id) % 2) AS status FROM (
               SELECT alert_id, alert_id * 2 + 1 AS execution_id FROM alerts WHERE alert_id % 3 <> 0
               UNION ALL SELECT alert_id, alert_id * 2 FROM alerts WHERE alert_id % 5 <> 0) GROUP BY alert_id) r USING (alert_id)""",
    ),
)
def alert_view(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf).select("alert_id", "event_id", "ip")
    runs = F.explode(
        F.array_compact(
            F.array(
                F.when(F.col("alert_id") % 3 != 0, F.col("alert_id") * 2 + 1),
                F.when(F.col("alert_id") % 5 != 0, F.col("alert_id") * 2),
            )
        )
    )
    responses = a.select("alert_id", runs.alias("execution_id"))
    responses = responses.withColumn("status", F.concat(F.lit("run"), (F.col("execution_id") % 2).cast("string")))
    view = response.alert_view(a, responses)
    return view.select("alert_id", "ip", "response.execution_id", F.col("response.status").alias("response_status"))


# --- blocklist ------------------------------------------------------------------------------------
BLOCKS_SQL = f"""{PLAN_SQL},
facts AS (SELECT ip, alert_id AS seq, ts_ms AS created_ms, ttl_seconds, reason, alert_id FROM plan WHERE action = 'block_ip'),
bl AS (
  SELECT ip, arg_max(reason, seq) AS reason, arg_max(alert_id, seq) AS alert_id, min(created_ms) AS created_ms,
    max(created_ms + ttl_seconds * 1000) AS expires_ms, count(*) AS hits FROM facts GROUP BY ip
)"""
BLOCK_AS_OF = 786_240_000_000  # 1994-12-01


def block_facts(spark: SparkSession, sf: str) -> DataFrame:
    return plan(spark, sf).where("action = 'block_ip'").select(
        "ip", F.col("alert_id").alias("seq"), F.col("ts_ms").alias("created_ms"), "ttl_seconds", "reason", "alert_id"
    )


def blocklist(spark: SparkSession, sf: str) -> DataFrame:
    facts = block_facts(spark, sf)
    hits = facts.groupBy("ip").agg(F.count("*").alias("hits"))
    return response.build_blocklist(facts).join(hits, "ip")


@query("blocklist_build", f"WITH {BLOCKS_SQL} SELECT ip, reason, alert_id, created_ms, expires_ms FROM bl")
def blocklist_build(spark: SparkSession, sf: str) -> DataFrame:
    return response.build_blocklist(block_facts(spark, sf))


@query(
    "blocklist_view",
    f"""WITH {BLOCKS_SQL} SELECT ip, hits, expires_ms <= {BLOCK_AS_OF} AS expired,
        greatest(0, (expires_ms - {BLOCK_AS_OF}) // 1000) AS seconds_remaining FROM bl ORDER BY hits DESC, created_ms DESC LIMIT 100""",
)
def blocklist_view(spark: SparkSession, sf: str) -> DataFrame:
    view = response.blocklist_view(blocklist(spark, sf), BLOCK_AS_OF, include_expired=True)
    return view.select("ip", "hits", "expired", "seconds_remaining")


@query(
    "blocklist_totals",
    f"""WITH {BLOCKS_SQL} SELECT count(*) FILTER (WHERE expires_ms > {BLOCK_AS_OF}) AS active_blocks,
        CAST(coalesce(sum(hits) FILTER (WHERE expires_ms > {BLOCK_AS_OF}), 0) AS BIGINT) AS dropped_by_active_blocks,
        CAST(sum(hits) AS BIGINT) AS dropped_lifetime FROM bl""",
)
def blocklist_totals(spark: SparkSession, sf: str) -> DataFrame:
    return response.blocklist_totals(blocklist(spark, sf), BLOCK_AS_OF)


@query("blocklist_purge", f"WITH {BLOCKS_SQL} SELECT ip, expires_ms FROM bl WHERE expires_ms > {BLOCK_AS_OF}")
def blocklist_purge(spark: SparkSession, sf: str) -> DataFrame:
    return response.purge_expired(blocklist(spark, sf), BLOCK_AS_OF).select("ip", "expires_ms")


INTERVAL_SQL = ALERTS_SQL + f""",
iv AS (SELECT ip, alert_id, ts_ms AS start_ms, ts_ms + {BLOCK_TTL_S * 1000} AS expires_ms FROM alerts WHERE event = 'suspicious_ip'),
hit AS (
  SELECT DISTINCT e.id, e.ip, e.ingested_ts_ms AS ts_ms FROM ev e JOIN iv ON iv.ip = e.ip
    AND e.ingested_ts_ms > iv.start_ms AND e.ingested_ts_ms < iv.expires_ms
)"""


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    return alerts(spark, sf).where("event = 'suspicious_ip'").select(
        "ip", "alert_id", F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + BLOCK_TTL_S * 1000).alias("expires_ms")
    )


@query("blocked_interval_join", sql(INTERVAL_SQL, "SELECT id, ip, id IN (SELECT id FROM hit) AS blocked FROM ev"))
def blocked_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    events = actor_events(spark, sf).select("id", "ip", "ingested_ts_ms")
    return response.mark_blocked(events, intervals(spark, sf)).select("id", "ip", "blocked")


HOT_INTERVAL_SQL = INTERVAL_SQL + f""",
hot_ev AS (SELECT id, CASE WHEN user_id % 2 = 0 THEN '{HOT_IP}' ELSE ip END AS ip, ingested_ts_ms AS ms FROM ev),
hot_iv AS (SELECT CASE WHEN user_id % 2 = 0 THEN '{HOT_IP}' ELSE ip END AS ip, iv.alert_id, start_ms, expires_ms FROM iv JOIN (SELECT id, user_id FROM ev) e ON e.id = iv.alert_id)"""


@query(
    "blocked_hot_address",
    sql(
        HOT_INTERVAL_SQL,
        """SELECT id, ip, EXISTS (SELECT 1 FROM hot_iv b WHERE b.ip = e.ip AND (ms > start_ms OR ms = start_ms AND id > alert_id) AND ms < expires_ms) AS blocked
           FROM hot_ev e""",
    ),
)
def blocked_hot_address(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the events and of the blocks, which overlap, on one address."""
    events = hot_address(actor_events(spark, sf).select("id", "ip", "user_id", "ingested_ts_ms"))
    owners = events.select(F.col("id").alias("alert_id"), F.col("ip").alias("new_ip"))
    blocks = intervals(spark, sf).join(owners, "alert_id").select(F.col("new_ip").alias("ip"), "alert_id", "start_ms", "expires_ms")
    return response.mark_blocked(events, blocks).select("id", "ip", "blocked")


@query("block_hits", sql(INTERVAL_SQL, "SELECT ip, count(*) AS hits, max(ts_ms) AS last_hit_ms FROM hit GROUP BY ip"))
def block_hits(spark: SparkSession, sf: str) -> DataFrame:
    events = actor_events(spark, sf).select("id", "ip", "ingested_ts_ms")
    return response.block_hits(events, intervals(spark, sf))


# --- review: conversation turns as requests ---------------------------------------------------------
REQUEST_SQL = """
req AS (
  SELECT conv_id AS alert_id, row_number() OVER (ORDER BY conv_id, turn) AS id,
    CASE (conv_id + length(text)) % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'closed' WHEN 2 THEN 'closed' ELSE 'investigating' END AS target
  FROM conversations
),
num AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY id) AS rn FROM req),
walk AS (
  SELECT alert_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, '' AS target, 'new' AS from_status, false AS accepted,
    'new' AS state FROM (SELECT DISTINCT alert_id FROM num)
  UNION ALL
  SELECT n.alert_id, n.rn, n.id, n.target, w.state,
    (w.state = 'new' AND n.target = 'investigating') OR (w.state = 'investigating' AND n.target = 'closed')
      OR (w.state = 'closed' AND n.target = 'investigating'),
    CASE WHEN (w.state = 'new' AND n.target = 'investigating') OR (w.state = 'investigating' AND n.target = 'closed')
      OR (w.state = 'closed' AND n.target = 'investigating') THEN n.target ELSE w.state END
  FROM walk w JOIN num n ON n.alert_id = w.alert_id AND n.rn = w.rn + 1
)"""


def review_steps(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    numbered = with_ordinal(turns, "conv_id", "id", width=10_000, ties=("turn",))
    kind = (F.col("conv_id") + F.length("text")) % 5
    target = F.when(kind == 0, "new").when(kind.isin(1, 2), "closed").otherwise("investigating")
    requests = numbered.select(F.col("conv_id").alias("alert_id"), "id", target.alias("target"))
    return response.review_steps(requests, width=3)


@query(
    "review_state",
    sql(
        REQUEST_SQL,
        """SELECT alert_id, arg_max(state, rn) AS review_status, count(*) FILTER (WHERE accepted) AS accepted_steps,
           count(*) FILTER (WHERE NOT accepted AND rn > 0) AS refused_steps FROM walk GROUP BY alert_id""",
    ),
)
def review_state(spark: SparkSession, sf: str) -> DataFrame:
    return response.review_state(review_steps(spark, sf))


@query(
    "review_conflicts",
    sql(REQUEST_SQL, "SELECT alert_id, id, from_status, target FROM walk WHERE rn > 0 AND NOT accepted"),
)
def review_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return response.review_conflicts(review_steps(spark, sf)).select("alert_id", "id", "from_status", "target")


@query(
    "incident_evidence",
    sql(
        ALERTS_SQL,
        """SELECT alert_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS event_ids, string_agg((id + 1)::VARCHAR, ',' ORDER BY id) AS heights,
           'recent_ip_events' AS evidence_scope,
           CASE WHEN count(*) = 1 THEN (min(id) + 1)::VARCHAR ELSE (min(id) + 1)::VARCHAR || '–' || (max(id) + 1)::VARCHAR END AS range_text
           FROM (SELECT a.alert_id, e.id, row_number() OVER (PARTITION BY a.alert_id ORDER BY e.id DESC) AS r
             FROM alerts a JOIN ev e ON e.ip = a.ip AND e.id <= a.event_id) WHERE r <= 20 GROUP BY alert_id""",
    ),
)
def incident_evidence(spark: SparkSession, sf: str) -> DataFrame:
    events = actor_events(spark, sf)
    ledger = events.select(F.col("id").alias("event_id"), (F.col("id") + 1).alias("block_id"))
    found = response.incident_evidence(alerts(spark, sf), events, ledger)
    return found.select(
        "alert_id", F.array_join(F.transform("event_ids", lambda x: x.cast("string")), ",").alias("event_ids"),
        F.array_join(F.transform("heights", lambda x: x.cast("string")), ",").alias("heights"),
        "evidence_scope", "range_text",
    )
