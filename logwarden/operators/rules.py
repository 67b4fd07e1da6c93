"""Sliding-window features, weighted rules, alerts and cooldown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import (
    ALERT_COOLDOWN_S,
    ALERT_THRESHOLD,
    EVENT_WEIGHTS,
    FAILED_LOGIN_TIERS,
    FAILED_LOGIN_WINDOW_S,
    FREQUENCY_TIERS,
    FREQUENCY_WINDOW_S,
)
from ..functions.text import lookup
from ..session import cut_lineage
from .greedy import CHUNK, next_at_least, path
from .ordering import running_sums, with_ordinal

SLICE_WINDOWS = 8


def window_counts(
    df: DataFrame,
    counts: dict[str, tuple[int, Column | None]],
    actor: str = "ip",
    ts: str = "ingested_ts_ms",
    seq: str = "id",
    slice_windows: int = SLICE_WINDOWS,
) -> DataFrame:
    """Per row, how many of the actor's rows lie in the last ``seconds`` (lower bound excluded).

    ``counts`` maps an output name to (seconds, condition). The row counts itself; rows of the same
    millisecond count when they come earlier in ``seq``.

    An actor's rows are cut into time slices of ``slice_windows`` windows. A row near the end of its
    slice is also sent to the next one, stripped to its keys, as context. So no task holds more than
    one slice of one actor, and one shuffle serves every count.
    """
    width = max(seconds for seconds, _ in counts.values()) * 1000
    slice_ms = width * slice_windows
    own = F.floor(F.col(ts) / F.lit(slice_ms)).cast("long")
    reach = F.floor((F.col(ts) + F.lit(width - 1)) / F.lit(slice_ms)).cast("long")
    flags = {
        n: (F.lit(1) if cond is None else F.coalesce(cond.cast("int"), F.lit(0)))
        for n, (_, cond) in counts.items()
    }
    rows = df.select(
        F.col(actor).alias("__actor"),
        F.col(ts).alias("__ts"),
        F.col(seq).alias("__seq"),
        *[c.alias(f"__f_{n}") for n, c in flags.items()],
        F.struct(*[F.col(c) for c in df.columns]).alias("__row"),
        own.alias("__own"),
        F.explode(F.array_distinct(F.array(own, reach))).alias("__slice"),
    )
    rows = rows.withColumn("__row", F.when(F.col("__slice") == F.col("__own"), F.col("__row")))
    part = Window.partitionBy("__actor", "__slice")
    so_far = part.orderBy("__ts", "__seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outputs = []
    for name, (seconds, _) in counts.items():
        # Two growing frames cost one pass each; a sliding frame would be re-read per row.
        too_old = part.orderBy("__ts").rangeBetween(Window.unboundedPreceding, -seconds * 1000)
        flag = F.col(f"__f_{name}")
        outputs.append(
            (F.sum(flag).over(so_far) - F.coalesce(F.sum(flag).over(too_old), F.lit(0)))
            .cast("long")
            .alias(name)
        )
    counted = rows.select("__row", *outputs).where("__row is not null")
    return counted.select("__row.*", *counts)


def rule_windows(
    df: DataFrame,
    failed_seconds: int = FAILED_LOGIN_WINDOW_S,
    frequency_seconds: int = FREQUENCY_WINDOW_S,
    **keys,
) -> DataFrame:
    """The two counts the rules use. Dropped rows leave every window, if ``dropped`` is known."""
    kept = ~F.col("dropped").cast("boolean") if "dropped" in df.columns else F.lit(True)
    return window_counts(
        df,
        {
            "failed_attempts_count": (failed_seconds, kept & (F.col("event") == "failed_login")),
            "request_frequency": (frequency_seconds, kept),
        },
        **keys,
    )


Rules = dict[str, tuple[Column, int]]


def register_rule(rules: Rules, name: str, condition: Column, weight_hundredths: int) -> Rules:
    """``rules`` and one more weighted condition, for ``score_rules``; its name becomes the reason."""
    return {**rules, name: (condition, weight_hundredths)}


def failed_login_points(count: Column) -> Column:
    points = F
    for limit, weight in FAILED_LOGIN_TIERS:
        points = points.when(count >= limit, weight)
    return points.otherwise(0)


def frequency_points(count: Column) -> Column:
    points = F
    for limit, weight in FREQUENCY_TIERS:
        points = points.when(count > limit, weight)
    return points.otherwise(0)


def event_points(event: Column) -> Column:
    return F.coalesce(lookup(EVENT_WEIGHTS, event), F.lit(0))


def score_rules(
    df: DataFrame,
    threshold: int = ALERT_THRESHOLD,
    failed_seconds: int = FAILED_LOGIN_WINDOW_S,
    frequency_seconds: int = FREQUENCY_WINDOW_S,
    rules: Rules | None = None,
) -> DataFrame:
    """Score in exact hundredths, reasons in rule order, and whether the threshold is reached."""
    has_rep = "rep_hundredths" in df.columns
    rep = F.coalesce(F.col("rep_hundredths"), F.lit(0)) if has_rep else F.lit(0)
    detail = F.coalesce(F.col("rep_detail"), F.lit("")) if "rep_detail" in df.columns else F.lit("")
    failed, freq, event = F.col("failed_attempts_count"), F.col("request_frequency"), F.col("event")
    f_points, e_points, q_points = failed_login_points(failed), event_points(event), frequency_points(freq)
    total = rep + f_points + e_points + q_points
    reasons = [
        F.when(rep > 0, F.concat("ip", F.lit(" — "), detail)),
        F.when(
            f_points > 0,
            F.concat(failed.cast("string"), F.lit(" failed logins from "), "ip", F.lit(f" in {failed_seconds}s")),
        ),
        F.when(e_points > 0, F.concat(F.lit("High-risk event: "), F.replace(event, F.lit("_"), F.lit(" ")))),
        F.when(
            q_points > 0,
            F.concat(freq.cast("string"), F.lit(" events from "), "ip", F.lit(f" in {frequency_seconds}s")),
        ),
    ]
    for name, (condition, weight) in (rules or {}).items():
        total = total + F.when(condition, weight).otherwise(0)
        reasons.append(F.when(condition, F.lit(name)))
    score = F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")
    found = F.array_compact(F.array(*reasons))
    out = df.withColumn("score_hundredths", score).withColumn(
        "reasons", F.when(F.size(found) == 0, F.array(F.lit("No rule matched"))).otherwise(found)
    )
    return out.withColumns(
        {
            "anomaly_score": F.col("score_hundredths") / F.lit(100.0),
            "is_anomaly": F.col("score_hundredths") >= threshold,
            "explanation": F.array_join("reasons", " + "),
        }
    )


# --- cooldown -------------------------------------------------------------------------------------
# Selecting alerts greedily is a path: from an alert to the first candidate of its group that is a
# cooldown later. All these links come from one search, the path from doubled jumps.

CHUNK_COOLDOWNS = 256  # cooldowns in a bucket of the search


def apply_cooldown(
    candidates: DataFrame,
    seconds: int = ALERT_COOLDOWN_S,
    keys: tuple[str, ...] = ("ip", "event", "ruleset_version"),
    ts: str = "ingested_ts_ms",
    seq: str = "id",
    resets: DataFrame | None = None,
    actor: str = "ip",
    chunk_cooldowns: int = CHUNK_COOLDOWNS,
    chunk_rows: int = CHUNK,
) -> DataFrame:
    """The candidates that become alerts: one per group and cooldown, first come first.

    ``resets`` (actor, ``ts``) forget an address's earlier alerts from that moment on. A group may hold any share of the
    rows: searches run in buckets of ``chunk_cooldowns`` cooldowns, paths in chunks of ``chunk_rows`` candidates.
    """
    cooldown = seconds * 1000
    if cooldown <= 0:
        return candidates
    chunk_ms = cooldown * chunk_cooldowns
    group = F.to_json(F.struct(*[F.col(k) for k in keys]))
    rows = candidates
    if resets is not None:
        marked = candidates.select(actor, ts, seq, F.lit(0).alias("__reset")).unionByName(
            resets.select(actor, ts, F.lit(-1).cast("long").alias(seq), F.lit(1).alias("__reset"))
        )
        epochs = running_sums(
            marked, ts, {"__epoch": F.col("__reset")}, by=(actor,), ties=(seq,), width=chunk_ms
        )
        epochs = epochs.where("__reset = 0").select(seq, "__epoch")
        rows = candidates.join(epochs, seq)
        group = F.to_json(F.struct(*[F.col(k) for k in keys], F.col("__epoch")))
    # Only the first candidate of a millisecond can be chosen, so one row per (group, ms) is enough.
    firsts = rows.groupBy(group.alias("grp"), F.col(ts).alias("ms")).agg(F.min(seq).alias("seq"))
    firsts = cut_lineage(with_ordinal(firsts, "ms", "i", by=("grp",), width=chunk_ms))
    points = firsts.select("grp", "i", F.col("ms").alias("key"))
    free = firsts.select("grp", "i", (F.col("ms") + cooldown).alias("key"))
    links = next_at_least(points, free, width=chunk_ms)
    chosen = firsts.join(path(links, chunk_rows), ["grp", "i"]).select(F.col("seq").alias("__seq"))
    return candidates.join(chosen, F.col(seq) == F.col("__seq"), "left_semi")


def make_alerts(scored: DataFrame, ruleset_version: str = "rules") -> DataFrame:
    """Alert rows: status open, review new; ``alert_id`` is the id of the event that raised it."""
    features = F.create_map(
        F.lit("failed_attempts_count"), F.col("failed_attempts_count").cast("double"),
        F.lit("request_frequency"), F.col("request_frequency").cast("double"),
    )
    extra = [c for c in ("source", "user", "severity", "message", "origin") if c in scored.columns]
    return scored.select(
        F.col("id").alias("alert_id"),
        F.col("id").alias("event_id"),
        F.col("ingested_ts_ms").alias("ts_ms"),
        "event",
        "ip",
        *extra,
        "score_hundredths",
        "anomaly_score",
        F.lit(ruleset_version).alias("ruleset_version"),
        "explanation",
        "reasons",
        features.alias("features"),
        F.lit("open").alias("status"),
        F.lit("new").alias("review_status"),
    )
