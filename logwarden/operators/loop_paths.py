"""The closed loop as a path of blocks, for policies whose blocks outlast every window and cooldown.

Such a block empties an address's state, so what follows depends on nothing but where it ends. A row of a blocking event
raises an alert for all restarts up to a certain row, its mark: the windows of a later restart hold too few rows. The next
block after a restart is therefore the first row whose mark is no smaller, which one search finds for all blocks that could
ever be; the blocks that happen are the path from the first one (``greedy``). With them known, rows are dropped, counted and
cooled down as usual. No address is folded, whatever its share of the rows.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import FAILED_LOGIN_TIERS, FREQUENCY_TIERS
from ..session import cut_lineage
from .greedy import CHUNK, next_at_least, path
from .ordering import carry_last, running_sums
from .rules import apply_cooldown, rule_windows, score_rules


def _marks(rows: DataFrame, params: dict) -> DataFrame:
    """(ip, i, ms, ttl_s, mark) of the rows that raise a block if the address restarted at row ``mark`` or before."""
    need = F.lit(params["threshold"]) - F.col("base")
    found = rows.where("ttl_s > 0").where(need <= FAILED_LOGIN_TIERS[0][1] + FREQUENCY_TIERS[0][1])
    failed = rows.where("event = 'failed_login'")
    f_from, q_from = (F.col("ms") - params[k] * 1000 for k in ("failed_seconds", "frequency_seconds"))
    # per tier, the row at which the window must begin at the latest; the whole window if the tier is not needed
    f_tiers, q_tiers = [(F.col("i"), 0)], [(F.col("i"), 0)]
    for limit, weight in FAILED_LOGIN_TIERS:
        at = failed.select("ip", (F.col("fo") + (limit - 1)).alias("fo"), F.col("i").alias(f"fi{limit}"), F.col("ms").alias(f"fm{limit}"))
        found = found.join(at, ["ip", "fo"], "left")
        f_tiers.append((F.when(F.col(f"fm{limit}") > f_from, F.col(f"fi{limit}")), weight))
    for limit, weight in FREQUENCY_TIERS:
        at = rows.select("ip", (F.col("i") + limit).alias("i"), F.col("ms").alias(f"qm{limit}"))
        found = found.join(at, ["ip", "i"], "left")
        q_tiers.append((F.when(F.col(f"qm{limit}") > q_from, F.col("i") - limit), weight))
    marks = [
        F.when(F.lit(fw + qw) >= need, F.when(f.isNotNull() & q.isNotNull(), F.least(f, q)))
        for (f, fw), (q, qw) in product(f_tiers, q_tiers)
    ]
    return found.select("ip", "i", "ms", "ttl_s", F.greatest(*marks).alias("mark")).where("mark IS NOT NULL")


def closed_loop_by_paths(rows: DataFrame, columns: list[str], params: dict, width_ms: int, chunk_rows: int = CHUNK) -> DataFrame:
    """``closed_loop`` of ``rows`` with base and ttl_s, whose every positive ttl_s is no less than any window or cooldown."""
    ms = F.col("ingested_ts_ms")
    failed = (F.col("event") == "failed_login").cast("long")
    numbered = running_sums(rows, "ingested_ts_ms", {"i": F.lit(1).cast("long"), "fo": failed}, by=("ip",), ties=("id",), width=width_ms)
    numbered = cut_lineage(numbered)
    bare = numbered.select("ip", "i", "fo", "event", "base", "ttl_s", ms.alias("ms"))
    triggers = cut_lineage(_marks(bare, params))
    ends = triggers.select("ip", "i", (F.col("ms") + F.col("ttl_s") * 1000).alias("key"))
    restarts = next_at_least(bare.select("ip", "i", F.col("ms").alias("key")), ends, "ip", width_ms).where("next IS NOT NULL")
    links = next_at_least(triggers.select("ip", "i", F.col("mark").alias("key")), restarts.select("ip", "i", F.col("next").alias("key")), "ip")
    nodes = triggers.select(F.col("ip").alias("grp"), "i").join(links.select(F.col("ip").alias("grp"), "i", "next"), ["grp", "i"], "left")
    blocks = path(nodes, chunk_rows).select(F.col("grp").alias("ip"), "i", F.lit(True).alias("blocks"))
    until = F.when(F.col("blocks"), ms + F.col("ttl_s") * 1000)
    marked = carry_last(numbered.join(blocks, ["ip", "i"], "left"), "i", {"until": until}, by=("ip",))
    dropped = cut_lineage(marked.select(*columns, "ttl_s", F.coalesce(ms < F.col("until"), F.lit(False)).alias("dropped")))
    windows = {k: params[k] for k in ("failed_seconds", "frequency_seconds")}
    scored = score_rules(rule_windows(dropped, **windows), params["threshold"], rules={}, **windows)
    scored = scored.select(*columns, "ttl_s", "failed_attempts_count", "request_frequency", "score_hundredths", "dropped", "is_anomaly")
    candidates = scored.where("is_anomaly AND NOT dropped").select("ip", "event", "id", "ingested_ts_ms")
    chosen = apply_cooldown(candidates, params["cooldown_seconds"], keys=("ip", "event"), chunk_rows=chunk_rows)
    alerted = scored.join(chosen.select("id", F.lit(True).alias("__alerted")), "id", "left")
    count = lambda c: F.when(F.col("dropped"), 0).otherwise(F.col(c)).cast(scored.schema[c].dataType).alias(c)
    return alerted.select(
        *columns, "ttl_s", *[count(c) for c in ("failed_attempts_count", "request_frequency", "score_hundredths")],
        "dropped", F.coalesce("__alerted", F.lit(False)).alias("alerted"),
    )
