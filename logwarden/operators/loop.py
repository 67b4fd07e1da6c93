"""The closed loop: check the block, count, score, cool down, alert, block from then on.

A block changes which later events count, so an address is a recurrence. It is kept distributed:

1. Windows without drops bound every score from above. Only rows that could alert matter.
2. Time is cut into slices as long as any effect can last. A slice without such a row ends all
   effects, so runs of active slices (with one neighbour on each side) are independent episodes.
   Rows outside every episode keep their plain window counts and need no fold. This is where the
   bulk of a busy but harmless address goes.
3. Episodes are folded in waves of bounded size. A wave is one stage in which every episode
   processes its next stretch of slices; a small state row per episode is carried to the next wave.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import (
    ALERT_COOLDOWN_S,
    ALERT_THRESHOLD,
    FAILED_LOGIN_TIERS,
    FAILED_LOGIN_WINDOW_S,
    FREQUENCY_TIERS,
    FREQUENCY_WINDOW_S,
)
from ..session import cut_lineage
from .loop_paths import closed_loop_by_paths
from .rules import event_points, rule_windows, score_rules

DEFAULT_PARAMS = {
    "failed_seconds": FAILED_LOGIN_WINDOW_S,
    "frequency_seconds": FREQUENCY_WINDOW_S,
    "cooldown_seconds": ALERT_COOLDOWN_S,
    "threshold": ALERT_THRESHOLD,
}
WAVE_ROWS = 2_000_000
SPANS = 1  # longest effects in a bucket of the searches, over which a hot address's rows are spread
FOLD_INPUT = "ip string, episode long, ms long, id long, kind int, event string, base int, ttl_s long, state string"
FOLD_OUTPUT = (
    "ip string, episode long, kind int, id long, dropped boolean, failed_attempts_count long, "
    "request_frequency long, score_hundredths int, alerted boolean, state string"
)
STATE, EVENT, UNBLOCK = -1, 0, 1


class ActorState:
    """What the loop remembers of one address: kept times, last alerts, block expiry."""

    __slots__ = ("kept", "failed", "last", "until", "params")

    def __init__(self, params: dict, text: str | None = None):
        self.params = params
        saved = json.loads(text) if text else {}
        self.kept = _unpack(saved.get("kept", []))
        self.failed = _unpack(saved.get("failed", []))
        self.last = saved.get("last", {})
        self.until = saved.get("until", None)

    def dump(self, now_ms: int) -> str:
        p = self.params
        kept = _pack(self.kept, now_ms - p["frequency_seconds"] * 1000)
        failed = _pack(self.failed, now_ms - p["failed_seconds"] * 1000)
        horizon = now_ms - p["cooldown_seconds"] * 1000
        last = {e: t for e, t in self.last.items() if t > horizon}
        return json.dumps({"kept": kept, "failed": failed, "last": last, "until": self.until})


def _pack(times: list[int], after: int) -> list[list[int]]:
    """Run-length form of the times still inside the window."""
    values, counts = np.unique(np.asarray(times, dtype=np.int64), return_counts=True)
    return [[int(v), int(c)] for v, c in zip(values, counts) if v > after]


def _unpack(runs: list[list[int]]) -> list[int]:
    return [v for v, c in runs for _ in range(c)]


def _tier(count: int, tiers: tuple, inclusive: bool) -> int:
    for limit, weight in tiers:
        if count >= limit if inclusive else count > limit:
            return weight
    return 0


def fold_rows(state: ActorState, ms, kind, event, base, ttl_s) -> dict[str, np.ndarray]:
    """Run one address's rows, in order, through the loop. ``state`` moves on."""
    p = state.params
    n = len(ms)
    out = {
        "dropped": np.zeros(n, bool),
        "failed": np.zeros(n, np.int64),
        "freq": np.zeros(n, np.int64),
        "score": np.zeros(n, np.int32),
        "alerted": np.zeros(n, bool),
    }
    kept, failed = state.kept, state.failed
    k_head = f_head = 0
    controls = np.flatnonzero(kind == UNBLOCK)
    f_span, q_span = p["failed_seconds"] * 1000, p["frequency_seconds"] * 1000
    cooldown, threshold = p["cooldown_seconds"] * 1000, p["threshold"]
    i = 0
    while i < n:
        now = int(ms[i])
        if kind[i] == UNBLOCK:
            if state.until is not None:
                state.until, state.last = None, {}
            i += 1
            continue
        if state.until is not None and state.until > now:
            # Everything up to the expiry is dropped, unless the block is lifted before.
            j = int(np.searchsorted(ms, state.until, "left"))
            nxt = controls[np.searchsorted(controls, i)] if len(controls) and controls[-1] > i else n
            j = min(j, int(nxt))
            out["dropped"][i:j] = True
            i = j
            continue
        kept.append(now)
        while kept[k_head] <= now - q_span:
            k_head += 1
        freq = len(kept) - k_head
        if event[i] == "failed_login":
            failed.append(now)
        while f_head < len(failed) and failed[f_head] <= now - f_span:
            f_head += 1
        fails = len(failed) - f_head
        score = int(base[i]) + _tier(fails, FAILED_LOGIN_TIERS, True) + _tier(freq, FREQUENCY_TIERS, False)
        score = max(0, min(100, score))
        out["failed"][i], out["freq"][i], out["score"][i] = fails, freq, score
        if score >= threshold:
            previous = state.last.get(event[i])
            if previous is None or previous <= now - cooldown:
                out["alerted"][i] = True
                state.last[event[i]] = now
                ttl = ttl_s[i]
                if ttl is not None and ttl == ttl and ttl > 0:
                    until = now + int(ttl) * 1000
                    state.until = until if state.until is None else max(state.until, until)
        i += 1
    state.kept, state.failed = kept[k_head:], failed[f_head:]
    return out


def _fold(params: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, last_ms = None, None, 0

        def closing() -> pd.DataFrame:
            return pd.DataFrame(
                {
                    "ip": [key[0]], "episode": [key[1]], "kind": [STATE], "id": [None], "dropped": [None],
                    "failed_attempts_count": [None], "request_frequency": [None],
                    "score_hundredths": [None], "alerted": [None], "state": [state.dump(last_ms)],
                }
            )

        for batch in batches:
            if batch.empty:
                continue
            ips, episodes = batch["ip"].to_numpy(), batch["episode"].to_numpy()
            change = np.ones(len(batch), bool)
            change[1:] = (ips[1:] != ips[:-1]) | (episodes[1:] != episodes[:-1])
            bounds = [*np.flatnonzero(change), len(batch)]
            pieces = []
            for a, b in zip(bounds, bounds[1:]):
                group = (ips[a], int(episodes[a]))
                if group != key:
                    if key is not None:
                        pieces.append(closing())
                    key, state = group, ActorState(params)
                rows = batch.iloc[a:b]
                if rows["kind"].iloc[0] == STATE:
                    state = ActorState(params, rows["state"].iloc[0])
                    rows = rows.iloc[1:]
                if rows.empty:
                    continue
                ms = rows["ms"].to_numpy()
                last_ms = int(ms[-1])
                got = fold_rows(
                    state, ms, rows["kind"].to_numpy(), rows["event"].to_numpy(),
                    rows["base"].to_numpy(), rows["ttl_s"].to_numpy(),
                )
                pieces.append(
                    pd.DataFrame(
                        {
                            "ip": rows["ip"].to_numpy(), "episode": group[1], "kind": rows["kind"].to_numpy(),
                            "id": rows["id"].to_numpy(), "dropped": got["dropped"],
                            "failed_attempts_count": got["failed"], "request_frequency": got["freq"],
                            "score_hundredths": got["score"], "alerted": got["alerted"], "state": None,
                        }
                    )
                )
            if pieces:
                yield pd.concat(pieces, ignore_index=True)
        if key is not None:
            yield closing()

    return run


def block_ttls(policy: DataFrame) -> DataFrame:
    """(trigger, ttl_s): how long a playbook blocks an address; null when it does not block."""
    return policy.select(
        "trigger",
        F.array_max(
            F.transform(
                F.filter("steps", lambda s: (s["action"] == "block_ip") & (s["ttl_seconds"] > 0)),
                lambda s: s["ttl_seconds"],
            )
        ).cast("long").alias("ttl_s"),
    )


def with_block_ttl(df: DataFrame, policy: DataFrame) -> DataFrame:
    """Add ``ttl_s`` of the playbook that answers the row's event (the wildcard one if none does)."""
    ttls = block_ttls(policy)
    named = ttls.select(F.col("trigger").alias("event"), "ttl_s", F.lit(True).alias("named"))
    wild = ttls.where("trigger = '*'").select("ttl_s").scalar()
    joined = df.join(named, "event", "left")
    return joined.withColumn("ttl_s", F.when(F.col("named"), F.col("ttl_s")).otherwise(wild)).drop("named")


def closed_loop(
    events: DataFrame,
    policy: DataFrame,
    unblocks: DataFrame | None = None,
    params: dict | None = None,
    wave_rows: int = WAVE_ROWS,
) -> DataFrame:
    """Every event with ``dropped``, its two window counts, its score and ``alerted``.

    ``events`` needs ip, event, ingested_ts_ms, id (unique, the arrival order of equal times) and
    may carry rep_hundredths. ``unblocks`` (ip, ingested_ts_ms, id) are manual block removals.

    Where no block is removed or shorter than a window or the cooldown, the loop is followed as a path (``loop_paths``);
    else in waves.
    """
    spark = events.sparkSession
    params = {**DEFAULT_PARAMS, **(params or {})}
    windows = {k: params[k] for k in ("failed_seconds", "frequency_seconds")}
    # Two numbers of the policy, a table with one row per playbook.
    shortest_ttl, longest_ttl = block_ttls(policy).agg(F.min("ttl_s"), F.max("ttl_s")).first()
    longest_ttl = longest_ttl or 0
    span_ms = 1000 * (max(longest_ttl, params["cooldown_seconds"]) + max(windows.values()))

    plain = events.drop("dropped")
    rep = F.coalesce(F.col("rep_hundredths"), F.lit(0)) if "rep_hundredths" in events.columns else F.lit(0)
    if unblocks is None and shortest_ttl and shortest_ttl >= max(params["cooldown_seconds"], *windows.values()):
        based = with_block_ttl(plain, policy).withColumn("base", (rep + event_points(F.col("event"))).cast("int"))
        return closed_loop_by_paths(based, plain.columns, params, width_ms=span_ms * SPANS)
    upper = score_rules(rule_windows(plain, **windows), params["threshold"], rules={}, **windows)
    upper = with_block_ttl(upper, policy).withColumn(
        "base", (rep + event_points(F.col("event"))).cast("int")
    )
    upper = upper.withColumn("slice", F.floor(F.col("ingested_ts_ms") / F.lit(span_ms)).cast("long"))

    # One row per address and slice from here to the wave plan.
    load = upper.groupBy("ip", "slice").agg(
        F.count("*").alias("rows"), F.max(F.col("is_anomaly").cast("int")).alias("active")
    )
    by_ip = Window.partitionBy("ip").orderBy("slice")
    active = load.where("active = 1").select(
        "ip", "slice",
        F.when(F.col("slice") - F.lag("slice").over(by_ip) <= 2, 0).otherwise(1).alias("starts"),
    )
    active = active.withColumn("episode", F.sum("starts").over(by_ip))
    # The slice before a run gives its windows their past; its own rows keep their plain counts.
    steps = F.explode(F.array(*[F.struct((F.col("slice") + d).alias("slice"), F.lit(d).alias("d")) for d in (-1, 0, 1)]))
    reach = active.select("ip", "episode", steps.alias("s")).groupBy(
        "ip", "episode", F.col("s.slice").alias("slice")
    ).agg((F.max("s.d") >= 0).alias("inside"))
    # Slices without rows stay in the plan: a block may be lifted there.
    plan = reach.join(load, ["ip", "slice"], "left").select(
        "ip", "slice", "episode", "inside", F.coalesce("rows", F.lit(0)).alias("rows")
    )
    earlier = (
        Window.partitionBy("ip", "episode").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    plan = plan.withColumn(
        "wave", F.floor(F.coalesce(F.sum("rows").over(earlier), F.lit(0)) / F.lit(wave_rows)).cast("long")
    )
    plan = cut_lineage(plan)
    last_wave = plan.agg(F.max("wave")).first()[0]

    loose = upper.select(
        *events.drop("dropped").columns, "slice", "ttl_s", "base",
        "failed_attempts_count", "request_frequency", "score_hundredths",
    )
    tagged = loose.join(plan.drop("rows"), ["ip", "slice"], "left")
    if last_wave is None:
        folded = None
    else:
        rows = tagged.where("episode is not null").select(
            "ip", "episode", F.col("ingested_ts_ms").alias("ms"), "id", F.lit(EVENT).alias("kind"),
            "event", "base", "ttl_s", F.lit(None).cast("string").alias("state"), "wave",
        )
        if unblocks is not None:
            lifted = unblocks.withColumn(
                "slice", F.floor(F.col("ingested_ts_ms") / F.lit(span_ms)).cast("long")
            ).join(plan.drop("rows", "inside"), ["ip", "slice"])
            rows = rows.unionByName(
                lifted.select(
                    "ip", "episode", F.col("ingested_ts_ms").alias("ms"), "id",
                    F.lit(UNBLOCK).alias("kind"), F.lit(None).cast("string").alias("event"),
                    F.lit(0).alias("base"), F.lit(None).cast("long").alias("ttl_s"),
                    F.lit(None).cast("string").alias("state"), "wave",
                )
            )
        waves = []
        state = None
        for wave in range(last_wave + 1):
            part = rows.where(F.col("wave") == wave).drop("wave")
            if state is not None:
                going_on = part.select("ip", "episode").distinct()
                part = part.unionByName(state.join(going_on, ["ip", "episode"]))
            result = (
                part.repartition("ip", "episode")
                .sortWithinPartitions("ip", "episode", "ms", "id", "kind")
                .select("ip", "episode", "ms", "id", "kind", "event", "base", "ttl_s", "state")
                .mapInPandas(_fold(params), FOLD_OUTPUT)
            )
            if last_wave > 0:
                result = cut_lineage(result)
                state = result.where(F.col("kind") == STATE).select(
                    "ip", "episode", F.lit(-(1 << 62)).cast("long").alias("ms"),
                    F.lit(None).cast("long").alias("id"), F.lit(STATE).alias("kind"),
                    F.lit(None).cast("string").alias("event"), F.lit(None).cast("int").alias("base"),
                    F.lit(None).cast("long").alias("ttl_s"), "state",
                )
            waves.append(result.where(F.col("kind") == EVENT))
        folded = waves[0]
        for other in waves[1:]:
            folded = folded.unionByName(other)
    columns = [c for c in events.columns if c != "dropped"]
    measures = ["failed_attempts_count", "request_frequency", "score_hundredths"]
    quiet = tagged.where("not coalesce(inside, false)").select(
        *columns, "ttl_s", *measures, F.lit(False).alias("dropped"), F.lit(False).alias("alerted")
    )
    if folded is None:
        return quiet
    busy = tagged.where("inside").select(*columns, "ttl_s").join(
        folded.select("id", *measures, "dropped", "alerted"), "id"
    )
    return quiet.unionByName(busy.select(quiet.columns))


def loop_alerts(looped: DataFrame) -> DataFrame:
    return looped.where("alerted")


def block_intervals(looped: DataFrame) -> DataFrame:
    """(ip, alert_id, start_ms, expires_ms) of every block the loop's alerts caused."""
    return looped.where("alerted and ttl_s > 0").select(
        "ip",
        F.col("id").alias("alert_id"),
        F.col("ingested_ts_ms").alias("start_ms"),
        (F.col("ingested_ts_ms") + F.col("ttl_s") * 1000).alias("expires_ms"),
    )
