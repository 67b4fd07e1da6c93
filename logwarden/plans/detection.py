"""Queries: windows, rules, alerts, cooldown, the closed loop, the shadow profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import PLAYBOOKS
from ..operators import metrics, profile
from ..operators.loop import block_intervals, closed_loop
from ..operators.response import policy_table
from ..operators.rules import apply_cooldown, make_alerts, rule_windows, window_counts
from .catalog import query
from .testdata import (
    ALERTS_SQL,
    BLOCK_TTL_S,
    CANDIDATES_SQL,
    COOLDOWN_S,
    COOLDOWN_SQL,
    EVENTS_SQL,
    HOT_IP,
    SCORED_SQL,
    WINDOW_S,
    WINDOWS_SQL,
    actor_events,
    actor_events_of,
    alerts,
    candidates,
    hot_address,
    scored_events,
    sql,
    table,
)


@query(
    "failed_logins_window",
    sql(WINDOWS_SQL, "SELECT id, ip, ingested_ts_ms, failed_attempts_count FROM win"),
)
def failed_logins_window(spark: SparkSession, sf: str) -> DataFrame:
    counted = window_counts(
        actor_events(spark, sf),
        {"failed_attempts_count": (WINDOW_S, F.col("event") == "failed_login")},
        slice_windows=1,
    )
    return counted.select("id", "ip", "ingested_ts_ms", "failed_attempts_count")


@query(
    "request_frequency_window",
    sql(WINDOWS_SQL, "SELECT id, ip, ingested_ts_ms, request_frequency FROM win"),
)
def request_frequency_window(spark: SparkSession, sf: str) -> DataFrame:
    counted = window_counts(
        actor_events(spark, sf), {"request_frequency": (WINDOW_S, None)}, slice_windows=2
    )
    return counted.select("id", "ip", "ingested_ts_ms", "request_frequency")


@query(
    "rule_score",
    sql(
        SCORED_SQL,
        "SELECT id, ip, event, failed_attempts_count, request_frequency, "
        "CAST(score_hundredths AS INTEGER) AS score_hundredths, "
        "score_hundredths / 100.0::DOUBLE AS anomaly_score, score_hundredths >= 45 AS is_anomaly FROM scored",
    ),
)
def rule_score(spark: SparkSession, sf: str) -> DataFrame:
    return scored_events(spark, sf).select(
        "id", "ip", "event", "failed_attempts_count", "request_frequency", "score_hundredths",
        "anomaly_score", "is_anomaly",
    )


@query(
    "rule_reasons",
    sql(
        SCORED_SQL,
        f"""SELECT id, CASE WHEN rep_hundredths + fp + ep + qp = 0 THEN 'No rule matched' ELSE concat_ws(' + ',
          CASE WHEN rep_hundredths > 0 THEN ip || ' — ' END,
          CASE WHEN fp > 0 THEN failed_attempts_count || ' failed logins from ' || ip || ' in {WINDOW_S}s' END,
          CASE WHEN ep > 0 THEN 'High-risk event: ' || replace(event, '_', ' ') END,
          CASE WHEN qp > 0 THEN request_frequency || ' events from ' || ip || ' in {WINDOW_S}s' END) END
          AS explanation FROM scored""",
    ),
)
def rule_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return scored_events(spark, sf).select("id", "explanation")


@query(
    "alerts",
    sql(
        ALERTS_SQL,
        "SELECT alert_id, event_id, ts_ms, event, ip, source, \"user\", severity, "
        "CAST(score_hundredths AS INTEGER) AS score_hundredths, status, review_status FROM alerts",
    ),
)
def alert_rows(spark: SparkSession, sf: str) -> DataFrame:
    return alerts(spark, sf).select(
        "alert_id", "event_id", "ts_ms", "event", "ip", "source", "user", "severity",
        "score_hundredths", "status", "review_status",
    )


@query("cooldown_alerts", sql(COOLDOWN_SQL, "SELECT ip, event, id, ms AS ingested_ts_ms FROM sel"))
def cooldown_alerts(spark: SparkSession, sf: str) -> DataFrame:
    chosen = apply_cooldown(candidates(spark, sf), COOLDOWN_S, chunk_cooldowns=16)
    return chosen.select("ip", "event", "id", "ingested_ts_ms")


@query(
    "cooldown_counterfactual",
    sql(
        COOLDOWN_SQL,
        """SELECT 'with_cooldown' AS policy, count(*) AS alerts, count(DISTINCT ip) AS alerted_ips FROM sel
           UNION ALL
           SELECT 'without_cooldown', count(*), count(DISTINCT ip) FROM cand""",
    ),
)
def cooldown_counterfactual(spark: SparkSession, sf: str) -> DataFrame:
    every = candidates(spark, sf)
    parts = {"with_cooldown": apply_cooldown(every, COOLDOWN_S), "without_cooldown": every}
    rows = [
        df.agg(F.count("*").alias("alerts"), F.countDistinct("ip").alias("alerted_ips")).select(
            F.lit(name).alias("policy"), "alerts", "alerted_ips"
        )
        for name, df in parts.items()
    ]
    return rows[0].unionByName(rows[1])


HOT_COOLDOWN_SQL = CANDIDATES_SQL + f""",
hot AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN '{HOT_IP}' ELSE ip END AS ip, event, id, ingested_ts_ms AS ms, 0 AS epoch FROM cand
)"""
RESET_SQL = CANDIDATES_SQL + """,
hot AS (
  SELECT ip, event, id, ingested_ts_ms AS ms, (ingested_ts_ms >= 1704844800000)::INT + (ingested_ts_ms >= 1705708800000)::INT AS epoch FROM cand
)"""
GREEDY_SQL = f""",
sel(ip, event, epoch, id, ms) AS (
  SELECT ip, event, epoch, arg_min(id, (ms, id)), min(ms) FROM hot GROUP BY ip, event, epoch
  UNION ALL
  SELECT s.ip, s.event, s.epoch, n.id, n.ms FROM sel s,
    LATERAL (SELECT arg_min(c.id, (c.ms, c.id)) AS id, min(c.ms) AS ms FROM hot c
             WHERE c.ip = s.ip AND c.event = s.event AND c.epoch = s.epoch AND c.ms >= s.ms + {COOLDOWN_S * 1000}) n
  WHERE n.id IS NOT NULL
)"""


@query("cooldown_hot_address", sql(HOT_COOLDOWN_SQL + GREEDY_SQL, "SELECT ip, event, id, ms AS ingested_ts_ms FROM sel"))
def cooldown_hot_address(spark: SparkSession, sf: str) -> DataFrame:
    """Cooldown where one address has half of the candidates, spread over chunks of 1,000 rows."""
    chosen = apply_cooldown(hot_address(candidates(spark, sf)), COOLDOWN_S, chunk_rows=1000)
    return chosen.select("ip", "event", "id", "ingested_ts_ms")


@query("cooldown_resets", sql(RESET_SQL + GREEDY_SQL, "SELECT ip, event, id, ms AS ingested_ts_ms FROM sel"))
def cooldown_resets(spark: SparkSession, sf: str) -> DataFrame:
    """Cooldown that manual unblocks of every address at two midnights reset."""
    every = candidates(spark, sf)
    resets = every.select("ip").distinct().select("ip", F.explode(F.array(*[F.lit(d) for d in UNBLOCK_DAYS])).alias("ingested_ts_ms"))
    return apply_cooldown(every, COOLDOWN_S, resets=resets).select("ip", "event", "id", "ingested_ts_ms")


def test_policy(spark: SparkSession) -> DataFrame:
    """The fixed policy with every block lengthened to the test data's time scale."""
    return policy_table(
        spark,
        [
            (name, trigger, priority, [
                (a, req, BLOCK_TTL_S if a == "block_ip" else ttl, reason, text)
                for a, req, ttl, reason, text in steps
            ])
            for name, trigger, priority, steps in PLAYBOOKS
        ],
    )


LOOP_PARAMS = {"failed_seconds": WINDOW_S, "frequency_seconds": WINDOW_S, "cooldown_seconds": COOLDOWN_S}


def looped(spark: SparkSession, sf: str) -> DataFrame:
    return closed_loop(actor_events(spark, sf), test_policy(spark), params=LOOP_PARAMS)


# One step per event of an address, all addresses side by side: kept and failed hold the times of
# counted rows, last the latest alert per event, until the block's expiry.
def loop_sql(unblocks: str = "", source: str = "ev", ctes: str = "", window_s: int = WINDOW_S) -> str:
    return EVENTS_SQL + ctes + f""",
ord AS (
  SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ms, id) AS rn FROM (
    SELECT id, ip, event, ingested_ts_ms AS ms, rep_hundredths,
      CASE WHEN event = 'suspicious_ip' THEN 35 ELSE 0 END AS weight
    FROM {source} {unblocks})
),
step AS (
  SELECT ip, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, false AS dropped, false AS alerted,
    CAST(0 AS BIGINT) AS failed_n, CAST(0 AS BIGINT) AS freq_n, CAST(0 AS BIGINT) AS score,
    CAST([] AS BIGINT[]) AS kept, CAST([] AS BIGINT[]) AS failed,
    CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)) AS last, CAST(0 AS BIGINT) AS until
  FROM (SELECT DISTINCT ip FROM ord)
  UNION ALL
  SELECT ip, rn, id, dropped, alerted, failed_n, freq_n, score, kept, failed,
    CASE WHEN event = 'unblock' AND until > 0 THEN CAST(MAP {{}} AS MAP(VARCHAR, BIGINT))
      WHEN alerted THEN map_concat(last, MAP([event], [ms])) ELSE last END,
    CASE WHEN event = 'unblock' THEN 0 WHEN alerted AND event = 'suspicious_ip' THEN greatest(until, ms + {BLOCK_TTL_S * 1000}) ELSE until END
  FROM (
    SELECT *, NOT dropped AND event <> 'unblock' AND score >= 45
      AND coalesce(last[event], -1) <= ms - {COOLDOWN_S * 1000} AS alerted
    FROM (
      SELECT *, CASE WHEN dropped THEN 0 ELSE least(100, rep_hundredths + weight
          + CASE WHEN failed_n >= 5 THEN 40 WHEN failed_n >= 3 THEN 20 ELSE 0 END
          + CASE WHEN freq_n > 15 THEN 20 WHEN freq_n > 8 THEN 10 ELSE 0 END) END AS score
      FROM (
        SELECT *, CASE WHEN dropped THEN 0 ELSE len(kept) END AS freq_n,
          CASE WHEN dropped THEN 0 ELSE len(failed) END AS failed_n
        FROM (
          SELECT o.ip, o.rn, o.id, o.event, o.ms, o.rep_hundredths, o.weight, s.last, s.until,
            s.until > o.ms AND o.event <> 'unblock' AS dropped,
            CASE WHEN s.until > o.ms OR o.event = 'unblock' THEN s.kept
              ELSE list_append(list_filter(s.kept, lambda x: x > o.ms - {window_s * 1000}), o.ms) END AS kept,
            CASE WHEN s.until > o.ms OR o.event = 'unblock' THEN s.failed
              WHEN o.event = 'failed_login'
                THEN list_append(list_filter(s.failed, lambda x: x > o.ms - {window_s * 1000}), o.ms)
              ELSE list_filter(s.failed, lambda x: x > o.ms - {window_s * 1000}) END AS failed
          FROM step s JOIN ord o ON o.ip = s.ip AND o.rn = s.rn + 1
        )
      )
    )
  )
)"""


UNBLOCK_DAYS = (1_704_844_800_000, 1_705_708_800_000)
LOOP_SQL = loop_sql()
UNBLOCK_SQL = loop_sql(
    "UNION ALL SELECT -1, ip, 'unblock', day, 0, 0 FROM (SELECT DISTINCT ip FROM ev), "
    f"(SELECT unnest([{UNBLOCK_DAYS[0]}, {UNBLOCK_DAYS[1]}]) AS day)"
)


@query(
    "closed_loop",
    sql(
        LOOP_SQL,
        "SELECT id, ip, dropped, alerted, failed_n AS failed_attempts_count, freq_n AS request_frequency, "
        "CAST(score AS INTEGER) AS score_hundredths FROM step WHERE rn > 0",
    ),
)
def closed_loop_query(spark: SparkSession, sf: str) -> DataFrame:
    return looped(spark, sf).select(
        "id", "ip", "dropped", "alerted", "failed_attempts_count", "request_frequency", "score_hundredths"
    )


@query(
    "closed_loop_blocks",
    sql(
        LOOP_SQL,
        f"""SELECT s.ip, s.id AS alert_id, o.ms AS start_ms, o.ms + {BLOCK_TTL_S * 1000} AS expires_ms
            FROM step s JOIN ord o ON o.id = s.id WHERE s.alerted AND o.event = 'suspicious_ip'""",
    ),
)
def closed_loop_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return block_intervals(looped(spark, sf))


@query(
    "closed_loop_unblock",
    sql(
        UNBLOCK_SQL,
        "SELECT id, ip, dropped, alerted, CAST(score AS INTEGER) AS score_hundredths FROM step WHERE rn > 0 AND id >= 0",
    ),
)
def closed_loop_unblock(spark: SparkSession, sf: str) -> DataFrame:
    """The loop with manual unblocks: every actor is released at each midnight of day 10 and 20."""
    events = actor_events(spark, sf)
    days = F.explode(F.array(*[F.lit(d) for d in UNBLOCK_DAYS]))
    unblocks = events.select("ip").distinct().select("ip", days.alias("ingested_ts_ms")).withColumn(
        "id", F.lit(-1).cast("long")
    )
    result = closed_loop(events, test_policy(spark), unblocks=unblocks, params=LOOP_PARAMS, wave_rows=2000)
    return result.select("id", "ip", "dropped", "alerted", "score_hundredths")


HOT_WINDOW_S = 24 * 3600  # shorter than a block, so that the loop is a path of blocks
HOT_LOOP_SQL = loop_sql(
    source="hot", window_s=HOT_WINDOW_S,
    ctes=f""",
hot AS (SELECT * REPLACE (CASE WHEN user_id % 2 = 0 THEN '{HOT_IP}' ELSE ip END AS ip) FROM ev)""",
)


@query(
    "closed_loop_hot_address",
    sql(
        HOT_LOOP_SQL,
        "SELECT id, ip, dropped, alerted, failed_n AS failed_attempts_count, freq_n AS request_frequency, "
        "CAST(score AS INTEGER) AS score_hundredths FROM step WHERE rn > 0",
    ),
)
def closed_loop_hot_address(spark: SparkSession, sf: str) -> DataFrame:
    """The loop where one address sends half of the rows and every block outlasts the windows."""
    params = LOOP_PARAMS | {"failed_seconds": HOT_WINDOW_S, "frequency_seconds": HOT_WINDOW_S}
    result = closed_loop(hot_address(actor_events(spark, sf)), test_policy(spark), params=params)
    return result.select("id", "ip", "dropped", "alerted", "failed_attempts_count", "request_frequency", "score_hundredths")


PROFILE_SQL = SCORED_SQL + """,
feat AS (
  SELECT id, ip, event, failed_attempts_count, request_frequency, rep_hundredths / 100.0::DOUBLE AS rep,
    id % 7 = 0 AS dropped FROM scored
),
base AS (SELECT * FROM feat WHERE event <> 'suspicious_ip'),
c AS (
  SELECT quantile_cont(failed_attempts_count, 0.5) AS c1, quantile_cont(request_frequency, 0.5) AS c2,
    quantile_cont(rep, 0.5) AS c3, count(*) AS n FROM base
),
prof AS (
  SELECT any_value(n) AS n, any_value(c1) AS c1, any_value(c2) AS c2, any_value(c3) AS c3,
    greatest(1.0, 1.4826 * quantile_cont(abs(failed_attempts_count - c1), 0.5)) AS s1,
    greatest(1.0, 1.4826 * quantile_cont(abs(request_frequency - c2), 0.5)) AS s2,
    greatest(0.05, 1.4826 * quantile_cont(abs(rep - c3), 0.5)) AS s3
  FROM base, c
)"""


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return scored_events(spark, sf).select(
        "id", "ip", "event", "failed_attempts_count", "request_frequency",
        (F.col("rep_hundredths") / F.lit(100.0)).alias("ip_reputation_score"),
        (F.col("id") % 7 == 0).alias("dropped"),
    )


@query(
    "robust_profile",
    sql(
        PROFILE_SQL,
        """SELECT n AS normal_windows, c1::DOUBLE AS center_failed_attempts_count,
           c2::DOUBLE AS center_request_frequency, c3::DOUBLE AS center_ip_reputation_score,
           round(s1::DOUBLE, 6) AS scale_failed_attempts_count,
           round(s2::DOUBLE, 6) AS scale_request_frequency,
           round(s3::DOUBLE, 6) AS scale_ip_reputation_score FROM prof""",
    ),
)
def robust_profile(spark: SparkSession, sf: str) -> DataFrame:
    fitted = profile.fit_profile(_features(spark, sf).where("event <> 'suspicious_ip'"))
    return fitted.select(
        "normal_windows",
        *[f"center_{f}" for f in profile.PROFILE_FEATURES],
        *[F.round(f"scale_{f}", 6).alias(f"scale_{f}") for f in profile.PROFILE_FEATURES],
    )


@query(
    "shadow_score",
    sql(
        PROFILE_SQL,
        """SELECT id, CASE WHEN dropped THEN 'skipped' ELSE 'scored' END AS shadow_status,
           CASE WHEN dropped THEN 'blocked_event' END AS shadow_reason,
           CASE WHEN NOT dropped THEN round(top, 4) END AS shadow_score,
           CASE WHEN NOT dropped THEN top > 1 END AS shadow_anomaly,
           CASE WHEN dropped THEN NULL WHEN d1 = top THEN 'failed_attempts_count'
             WHEN d2 = top THEN 'request_frequency' ELSE 'ip_reputation_score' END AS shadow_top_feature
           FROM (SELECT *, greatest(d1, d2, d3) AS top FROM (
             SELECT id, dropped, greatest(0.0::DOUBLE, failed_attempts_count - c1) / (3.0::DOUBLE * s1) AS d1,
               greatest(0.0::DOUBLE, request_frequency - c2) / (3.0::DOUBLE * s2) AS d2,
               greatest(0.0::DOUBLE, rep - c3) / (3.0::DOUBLE * s3) AS d3 FROM feat, prof))""",
    ),
)
def shadow_score(spark: SparkSession, sf: str) -> DataFrame:
    features = _features(spark, sf)
    fitted = profile.fit_profile(features.where("event <> 'suspicious_ip'"))
    return profile.score_profile(features, fitted).select(
        "id", "shadow_status", "shadow_reason", "shadow_score", "shadow_anomaly", "shadow_top_feature"
    )


@query(
    "distinct_actors",
    sql(
        CANDIDATES_SQL,
        """SELECT (SELECT count(DISTINCT ip) FROM cand) AS alerted_ips,
           (SELECT count(DISTINCT ip) FROM ev WHERE event IN ('failed_login', 'auth_invalid_user',
             'login_success')) AS auth_ips""",
    ),
)
def distinct_actors(spark: SparkSession, sf: str) -> DataFrame:
    flagged = scored_events(spark, sf).select(
        F.when(F.col("is_anomaly"), F.col("ip")).alias("alerted"),
        F.when(F.col("event").isin("failed_login", "auth_invalid_user", "login_success"), F.col("ip")).alias("auth"),
    )
    return flagged.agg(
        F.countDistinct("alerted").alias("alerted_ips"), F.countDistinct("auth").alias("auth_ips")
    )


@query(
    "set_digest",
    sql(
        CANDIDATES_SQL,
        """SELECT count(*) AS size,
           sha256('[' || coalesce(string_agg('"' || ip || '"', ',' ORDER BY ip), '') || ']') AS digest
           FROM (SELECT DISTINCT ip FROM cand)""",
    ),
)
def set_digest(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.set_digest(candidates(spark, sf), "ip")


@query(
    "closed_loop_stream",
    sql(
        LOOP_SQL,
        "SELECT id, ip, dropped, alerted, failed_n AS failed_attempts_count, freq_n AS request_frequency, "
        "CAST(score AS INTEGER) AS score_hundredths FROM step WHERE rn > 0",
    ),
)
def closed_loop_stream_query(spark: SparkSession, sf: str) -> DataFrame:
    """The event table arriving in three parts: the stream is stopped and restarted between them, so that windows,
    cooldowns and blocks that span two parts live in saved state only."""
    return spark.read.parquet(f"{_run_loop_stream(spark, sf)}-rows").select(
        "id", "ip", "dropped", "alerted", "failed_attempts_count", "request_frequency", "score_hundredths"
    )


def _run_loop_stream(spark: SparkSession, sf: str, where: Column | None = None, idle_seconds: int | None = None) -> str:
    from ..streaming.loop_stream import closed_loop_stream
    from ..streaming.sinks import record_batches
    from .parsing import scratch_path

    events, out = table(spark, sf, "events"), scratch_path(spark)
    if where is not None:
        events = events.where(where)
    at = F.col("ts").cast("timestamp").cast("double")
    first, second = events.select(at.alias("at")).approxQuantile("at", [1 / 3, 2 / 3], 0.01)
    for part in (at <= first, (at > first) & (at <= second), at > second):
        events.where(part).write.mode("append").parquet(f"{out}-in")
        raw = spark.readStream.schema(events.schema).parquet(f"{out}-in")
        looped_rows = closed_loop_stream(actor_events_of(raw), test_policy(spark), LOOP_PARAMS, idle_seconds)
        record_batches(looped_rows, f"{out}-rows", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return out


# Every third actor is silent for the middle of the month, so that its state goes and comes back.
IDLE_S = WINDOW_S
SILENT = "user_id % 3 <> 0 OR ts < TIMESTAMP '2024-01-08' OR ts >= TIMESTAMP '2024-01-20' AND user_id % 2 = 0"
IDLE_LOOP_SQL = loop_sql().replace("FROM events", f"FROM events WHERE {SILENT}", 1)


@query(
    "closed_loop_stream_idle",
    sql(
        IDLE_LOOP_SQL,
        "SELECT id, ip, dropped, alerted, failed_n AS failed_attempts_count, freq_n AS request_frequency, "
        "CAST(score AS INTEGER) AS score_hundredths FROM step WHERE rn > 0",
    ),
)
def closed_loop_stream_idle(spark: SparkSession, sf: str) -> DataFrame:
    """The streamed loop with idle expiry: actors whose state went away count afresh when they return."""
    return spark.read.parquet(f"{_run_loop_stream(spark, sf, F.expr(SILENT), IDLE_S)}-rows").select(
        "id", "ip", "dropped", "alerted", "failed_attempts_count", "request_frequency", "score_hundredths"
    )


@query(
    "idle_actor_state",
    sql(
        EVENTS_SQL.replace("FROM events", f"FROM events WHERE {SILENT}"),
        f"SELECT ip FROM ev GROUP BY ip HAVING max(ts_ms) + {IDLE_S * 1000} + 1 > (SELECT max(ts_ms) FROM ev) - 60000",
    ),
)
def idle_actor_state(spark: SparkSession, sf: str) -> DataFrame:
    """The actors that the stopped loop still keeps: those that fell silent are gone."""
    from ..streaming.loop_stream import tracked_addresses

    return tracked_addresses(spark, f"{_run_loop_stream(spark, sf, F.expr(SILENT), IDLE_S)}-state")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Events, windows, rules, alerts in time order."""
    windows = {"failed_seconds": WINDOW_S, "frequency_seconds": WINDOW_S}
    from ..operators.rules import score_rules

    scored = score_rules(rule_windows(actor_events(spark, sf), **windows), rules={}, **windows)
    return make_alerts(scored.where("is_anomaly")).select(
        "alert_id", "ts_ms", "ip", "event", "severity", "anomaly_score", "explanation", "status"
    ).orderBy("ts_ms", "alert_id")
