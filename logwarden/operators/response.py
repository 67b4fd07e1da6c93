"""Playbooks, response plans and outcomes, the blocklist, and incident evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import DEFAULT_TTL_S, PLAYBOOKS, REVIEW_EDGES
from ..functions.text import fill_template
from .ordering import carry_last, top_per_key
from .sweep import covered

POLICY_SCHEMA = (
    "name string, trigger string, priority string, steps array<struct<action: string, "
    "required: boolean, ttl_seconds: int, reason: string, message: string>>"
)


def policy_table(spark: SparkSession, playbooks=PLAYBOOKS) -> DataFrame:
    """The response policy: one row per playbook."""
    return spark.createDataFrame([(n, t, p, list(s)) for n, t, p, s in playbooks], POLICY_SCHEMA)


def assign_playbook(alerts: DataFrame, policy: DataFrame) -> DataFrame:
    """Add ``playbook`` (a struct): the one triggered by the event, else the wildcard one."""
    book = F.struct("name", "trigger", "priority", "steps")
    named = policy.select(F.col("trigger").alias("event"), book.alias("named"))
    wild = policy.where("trigger = '*'").select(book).scalar()
    joined = alerts.join(named, "event", "left")
    return joined.withColumn("playbook", F.coalesce(F.col("named"), wild)).drop("named")


def response_plan(alerts: DataFrame, policy: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """One row per alert and step, with the step's message filled from the alert."""
    fields = fields or tuple(
        c for c in ("event", "ip", "user", "source", "severity", "explanation", "message")
        if c in alerts.columns
    )
    steps = assign_playbook(alerts, policy).select(
        "*", F.posexplode("playbook.steps").alias("position", "step")
    )
    action = F.col("step.action")
    message = F.when(
        action == "notify",
        fill_template(F.coalesce("step.message", F.lit("alert raised")), {f: F.col(f) for f in fields}),
    )
    blocks = action == "block_ip"
    return steps.select(
        "alert_id",
        "ip",
        "event",
        "ts_ms",
        F.col("playbook.name").alias("playbook"),
        F.col("playbook.priority").alias("priority"),
        "position",
        action.alias("action"),
        F.col("step.required").alias("required"),
        F.when(blocks, F.coalesce("step.ttl_seconds", F.lit(DEFAULT_TTL_S)).cast("long")).alias("ttl_seconds"),
        F.when(blocks, F.coalesce("step.reason", "event")).alias("reason"),
        message.alias("message"),
    )


def response_status(outcomes: DataFrame, key: str = "execution_id") -> DataFrame:
    """Alert status of each execution from its step outcomes.

    ``outcomes``: key, action, required, status (executed / failed / skipped).
    """
    executed = F.col("status") == "executed"
    enforcing = F.col("action") == "block_ip"
    grouped = outcomes.groupBy(key).agg(
        F.bool_or((F.col("status") == "failed") & F.col("required")).alias("required_failed"),
        F.bool_or(executed & enforcing).alias("enforced"),
        F.bool_or(executed).alias("any_executed"),
        F.bool_or(F.col("required") & enforcing).alias("closes"),
    )
    status = (
        F.when(F.col("required_failed"), "action_failed")
        .when(F.col("enforced"), "contained")
        .when(F.col("any_executed") & F.col("closes"), "mitigated")
        .otherwise("open")
    )
    return grouped.select(key, status.alias("status"))


def redact_steps(steps: Column) -> Column:
    """A webhook's detail may hold a credential: only its status is shown."""
    return F.transform(
        steps,
        lambda s: s.withField(
            "detail",
            F.when(s["action"] == "webhook", F.concat(F.lit("webhook "), s["status"])).otherwise(s["detail"]),
        ),
    )


def response_view(executions: DataFrame, steps: DataFrame) -> DataFrame:
    """Executions with their steps nested in order; a playbook's step count bounds the list."""
    nested = steps.groupBy("execution_id").agg(
        F.array_sort(
            F.collect_list(F.struct("position", "action", "status", "executed", "required", "detail"))
        ).alias("steps")
    )
    view = executions.join(nested, "execution_id", "left").withColumn("steps", redact_steps(F.col("steps")))
    return view.withColumns(
        {
            "playbook_steps": F.transform("steps", lambda s: s["action"]),
            "ran_steps": F.size(F.filter("steps", lambda s: s["executed"])).cast("long"),
        }
    )


def alert_view(
    alerts: DataFrame, responses: DataFrame, verdicts: DataFrame | None = None
) -> DataFrame:
    """Alerts with their last response (highest execution id) and shadow verdict."""
    payload = [c for c in responses.columns if c != "alert_id"]
    last = responses.groupBy("alert_id").agg(
        F.max_by(F.struct(*payload), F.col("execution_id")).alias("response")
    )
    view = alerts.join(last, "alert_id", "left")
    return view if verdicts is None else view.join(verdicts, "event_id", "left")


def alert_with_event(alerts: DataFrame, events: DataFrame) -> DataFrame:
    renamed = events.select([F.col(c).alias("event_id" if c == "id" else f"event_{c}") for c in events.columns])
    return alerts.join(renamed, "event_id")


# --- blocklist ------------------------------------------------------------------------------------
def build_blocklist(blocks: DataFrame) -> DataFrame:
    """One row per address from block facts (ip, seq, created_ms, ttl_seconds, reason, alert_id).

    The latest expiry holds, the last reason and alert win, the first block dates the row.
    """
    expires = F.col("created_ms") + F.col("ttl_seconds") * 1000
    return blocks.where("ttl_seconds > 0").groupBy("ip").agg(
        F.max_by(F.struct("reason", "alert_id"), "seq").alias("last"),
        F.min("created_ms").alias("created_ms"),
        F.max(expires).alias("expires_ms"),
    ).select("ip", "last.reason", "last.alert_id", "created_ms", "expires_ms")


def blocked_rows(events: DataFrame, blocks: DataFrame, ts: str = "ingested_ts_ms", seq: str = "id") -> DataFrame:
    """(id, ip, ts_ms) of the events that arrive while a block of their address runs, each once, by one sweep over both."""
    points = events.select(F.col("ip").alias("grp"), F.col(ts).alias("at"), F.col(seq).alias("seq"))
    # an event follows the alert that blocks it, so the block starts after the alert's own place
    starts = blocks.select(F.col("ip").alias("grp"), F.col("start_ms").alias("at"), (F.col("alert_id") + 1).alias("seq"), F.col("expires_ms").alias("end"))
    return covered(points, starts).select(F.col("seq").alias("id"), F.col("grp").alias("ip"), F.col("at").alias("ts_ms"))


def mark_blocked(events: DataFrame, blocks: DataFrame, ts: str = "ingested_ts_ms", seq: str = "id") -> DataFrame:
    """Add ``blocked``."""
    hit = blocked_rows(events, blocks, ts, seq).select(F.col("id").alias("__id"), F.lit(True).alias("__hit"))
    return events.join(hit, F.col(seq) == F.col("__id"), "left").withColumn("blocked", F.coalesce("__hit", F.lit(False))).drop("__hit", "__id")


def block_hits(events: DataFrame, blocks: DataFrame, ts: str = "ingested_ts_ms", seq: str = "id") -> DataFrame:
    """Per address: dropped events and the time of the last one."""
    return blocked_rows(events, blocks, ts, seq).groupBy("ip").agg(F.count("*").alias("hits"), F.max("ts_ms").alias("last_hit_ms"))


def blocklist_view(blocklist: DataFrame, as_of_ms: int, include_expired: bool = False, limit: int = 100) -> DataFrame:
    """Blocks by hits, then newest; ``limit`` is the report's size."""
    left = F.col("expires_ms") - F.lit(as_of_ms)
    view = blocklist if include_expired else blocklist.where(left > 0)
    return (
        view.withColumn("expired", left <= 0)
        .withColumn("seconds_remaining", F.greatest(F.lit(0), F.floor(left / 1000)).cast("long"))
        .orderBy(F.desc("hits"), F.desc("created_ms"))
        .limit(limit)
    )


def blocklist_totals(blocklist: DataFrame, as_of_ms: int) -> DataFrame:
    active = F.col("expires_ms") > as_of_ms
    return blocklist.agg(
        F.count(F.when(active, 1)).alias("active_blocks"),
        F.coalesce(F.sum(F.when(active, F.col("hits"))), F.lit(0)).alias("dropped_by_active_blocks"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("dropped_lifetime"),
    )


def purge_expired(blocklist: DataFrame, as_of_ms: int) -> DataFrame:
    return blocklist.where(F.col("expires_ms") > as_of_ms)


# --- retention --------------------------------------------------------------------------------------
def split_retention(events: DataFrame, alerts: DataFrame, hours: int, as_of_ms: int) -> tuple[DataFrame, DataFrame]:
    """(kept, pruned): old events go unless an alert cites them."""
    cutoff = as_of_ms - hours * 3_600_000
    cited = alerts.where("event_id is not null").select(F.col("event_id").alias("id")).distinct()
    young = events.where(F.col("ingested_ts_ms") >= cutoff)
    old = events.where(F.col("ingested_ts_ms") < cutoff)
    return young.unionByName(old.join(cited, "id", "left_semi")), old.join(cited, "id", "left_anti")


# --- review -----------------------------------------------------------------------------------------
def review_steps(requests: DataFrame, alert: str = "alert_id", seq: str = "id", target: str = "target", **options) -> DataFrame:
    """Each request with the state it met (``from_status``) and whether it was ``accepted``.

    From the three edges: an "investigating" request leads there from anywhere; "closed" counts only
    once that has happened; "new" is never reached again. So the state is the last such target.
    """
    carried = carry_last(
        requests, seq,
        {
            "__last": F.when(F.col(target).isin("investigating", "closed"), F.col(target)),
            "__opened": F.when(F.col(target) == "investigating", F.lit(True)),
        },
        by=(alert,), **options,
    )
    # "closed" requests before the first "investigating" one were refused and left the alert new.
    state = F.when(F.col("__opened"), F.col("__last")).otherwise("new")
    edges = F.array(*[F.lit(f"{a}>{b}") for a, b in REVIEW_EDGES])
    return carried.withColumn("from_status", state).withColumn(
        "accepted",
        F.array_contains(edges, F.concat("from_status", F.lit(">"), F.coalesce(F.col(target), F.lit("")))),
    ).drop("__last", "__opened")


def review_state(steps: DataFrame, alert: str = "alert_id", seq: str = "id", target: str = "target") -> DataFrame:
    return steps.groupBy(alert).agg(
        F.coalesce(F.max_by(target, F.when(F.col("accepted"), F.col(seq))), F.lit("new")).alias("review_status"),
        F.count(F.when(F.col("accepted"), 1)).alias("accepted_steps"),
        F.count(F.when(~F.col("accepted"), 1)).alias("refused_steps"),
    )


def review_conflicts(steps: DataFrame) -> DataFrame:
    return steps.where("not accepted")


# --- incident evidence ------------------------------------------------------------------------------
def incident_evidence(alerts: DataFrame, events: DataFrame, ledger: DataFrame, n: int = 20) -> DataFrame:
    """Per alert: up to ``n`` evidence events up to the alert and the ledger heights covering them.

    Evidence is the address's newest events; a local privilege escalation on loopback cites its
    trigger only. Candidate pairs stay bounded: each event is ranked inside its address once, and an
    alert reads the n ranks that end at its own trigger.
    """
    from .ordering import with_ordinal

    covering = ledger.groupBy("event_id").agg(F.min("block_id").alias("block_id"))
    ranked = with_ordinal(events.select("id", "ip", "event", "origin"), "id", "rank", by=("ip",))
    ranked = ranked.join(covering.withColumnRenamed("event_id", "id"), "id", "left")
    local = (F.col("origin") == "file") & (F.col("event") == "privilege_escalation") & (F.col("ip") == "127.0.0.1")
    triggers = alerts.select("alert_id", F.col("event_id").alias("id")).join(ranked, "id").select(
        "alert_id", "ip", "rank", local.alias("local_only")
    )
    span = F.when(F.col("local_only"), 1).otherwise(n)
    wanted = triggers.select(
        "alert_id", "ip", "local_only",
        F.explode(F.sequence(F.greatest(F.lit(1), F.col("rank") - span + 1), F.col("rank"))).alias("rank"),
    )
    return (
        wanted.join(ranked.select("ip", "rank", "id", "block_id"), ["ip", "rank"])
        .groupBy("alert_id", "local_only")
        .agg(
            F.array_sort(F.collect_list("id")).alias("event_ids"),
            F.array_sort(F.collect_list("block_id")).alias("heights"),
        )
        .withColumn(
            "evidence_scope",
            F.when(F.col("local_only"), "triggering_local_event").otherwise("recent_ip_events"),
        )
        .withColumn("range_text", height_range_text(F.col("heights")))
        .drop("local_only")
    )


def height_range_text(heights: Column) -> Column:
    return (
        F.when(F.size(heights) == 0, "(none — the events were pruned by retention)")
        .when(F.size(heights) == 1, F.get(heights, F.lit(0)).cast("string"))
        .otherwise(
            F.concat(F.array_min(heights).cast("string"), F.lit("–"), F.array_max(heights).cast("string"))
        )
    )


def recent_per_actor(events: DataFrame, n: int = 20, actor: str = "ip") -> DataFrame:
    return top_per_key(events, [actor], [F.desc("id")], n)
