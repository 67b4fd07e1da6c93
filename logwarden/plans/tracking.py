"""Queries: live scores of blocks in a bounded table, by reuse distance, and on a stream with idle expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as blk
from ..operators import recency
from ..operators import templates as tpl
from ..session import cut_lineage
from .blocks import LIVE_SQL, block_log, live_lines
from .catalog import query
from .testdata import sql, table

LIMIT = 12  # blocks tracked; the log has some 35 long-lived ones beside its current run
IDLE_S = 24 * 3600
LATENESS_S = 60

TRACKED_SQL = LIVE_SQL + f""",
touch AS (
  SELECT position, template_id, unnest(blocks) AS block_id, generate_subscripts(blocks, 1) - 1 AS place FROM lt
),
sequence AS (SELECT *, row_number() OVER (ORDER BY position, place) AS t FROM touch),
previous AS (SELECT *, t - place AS q, lag(t) OVER (PARTITION BY block_id ORDER BY t) AS p FROM sequence),
distance AS (SELECT a.t, count(DISTINCT b.block_id) AS d FROM previous a JOIN sequence b ON b.t > a.p AND b.t < a.q GROUP BY a.t),
marked AS (SELECT previous.*, coalesce(d >= {LIMIT}, false) AS evicted FROM previous LEFT JOIN distance USING (t)),
episodes AS (SELECT *, count(*) FILTER (evicted) OVER (PARTITION BY block_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS episode FROM marked)"""


def touches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines, vocab = live_lines(spark, sf)
    weights = vocab.select("column", (0.25 * (F.col("column") - 3)).alias("weight"))
    return lines.select("position", "column", F.posexplode("blocks").alias("place", "block_id")), weights


@query(
    "tracked_block_scores",
    sql(
        TRACKED_SQL,
        """SELECT position, block_id, evicted, count(*) OVER w AS lines,
             round(1 / (1 + exp(-(-1.5 + coalesce(sum(0.25 * (col - 3)) OVER w, 0)::DOUBLE))), 4) AS probability
           FROM episodes LEFT JOIN lc USING (template_id)
           WINDOW w AS (PARTITION BY block_id, episode ORDER BY t ROWS UNBOUNDED PRECEDING)""",
    ),
)
def tracked_block_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of partial blocks when only the latest blocks are kept: an evicted block starts anew."""
    rows, weights = touches(spark, sf)
    kept = cut_lineage(recency.tracked(rows, LIMIT))
    scored = blk.partial_block_scores(kept, -1.5, weights, by=("block_id", "episode"))
    return scored.select("position", "block_id", "evicted", "lines", "probability")


@query(
    "block_evictions",
    sql(
        TRACKED_SQL,
        f"""SELECT count(DISTINCT block_id) AS blocks_seen, least({LIMIT}, count(DISTINCT block_id)) AS blocks_tracked,
             count(*) FILTER (evicted) AS blocks_returned,
             count(*) FILTER (evicted) + greatest(0, count(DISTINCT block_id) - {LIMIT}) AS evicted FROM marked""",
    ),
)
def block_evictions(spark: SparkSession, sf: str) -> DataFrame:
    return recency.eviction_counts(recency.reuse(touches(spark, sf)[0], LIMIT), LIMIT)


IDLE_SQL = LIVE_SQL + f""",
timed AS (
  SELECT position, template_id, unnest(blocks) AS block_id, epoch_us(ts) // 1000 AS ms FROM lt JOIN events ON event_id = position - 1
),
paused AS (SELECT *, coalesce(ms - lag(ms) OVER (PARTITION BY block_id ORDER BY position) > {IDLE_S * 1000}, false) AS pause FROM timed),
idle AS (SELECT *, count(*) FILTER (pause) OVER (PARTITION BY block_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS episode FROM paused)"""


def run_score_stream(spark: SparkSession, sf: str) -> str:
    """The block log in two sources, read as one stream that is stopped and restarted twice; the folder of its rows."""
    from ..streaming.score_stream import score_blocks_stream
    from ..streaming.sinks import record_batches
    from .parsing import scratch_path

    lines, vocab = live_lines(spark, sf)
    shapes = lines.select("masked", "column").distinct()
    out = scratch_path(spark)
    shapes.write.parquet(f"{out}-shapes")
    vocab.select("column", (0.25 * (F.col("column") - 3)).alias("weight")).write.parquet(f"{out}-weights")
    shapes, weights = spark.read.parquet(f"{out}-shapes"), spark.read.parquet(f"{out}-weights")
    log = block_log(spark, sf).join(table(spark, sf, "events").select((F.col("event_id") + 1).alias("position"), F.col("ts").cast("timestamp").alias("at")), "position")
    log = log.select("position", "at", "value", (F.col("user_id") % 2).alias("source"))
    first, second = log.approxQuantile("position", [1 / 3, 2 / 3], 0.01)
    position = F.col("position")
    for part in (position <= first, (position > first) & (position <= second), position > second):
        sources = []
        for source in (0, 1):
            log.where(part & (F.col("source") == source)).drop("source").write.mode("append").parquet(f"{out}-in{source}")
            sources.append(spark.readStream.schema("position long, at timestamp, value string").parquet(f"{out}-in{source}"))
        both = tpl.with_mask(blk.with_blocks(sources[0].unionByName(sources[1])))
        rows = both.join(shapes, "masked", "left").select("position", "at", "column", F.explode("blocks").alias("block_id"))
        scored = score_blocks_stream(rows, weights, -1.5, IDLE_S, lateness=f"{LATENESS_S} seconds")
        record_batches(scored, f"{out}-rows", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return out


@query(
    "block_score_stream",
    sql(
        IDLE_SQL,
        """SELECT position, block_id, count(*) OVER w AS lines, 'partial block' AS basis,
             round(1 / (1 + exp(-(-1.5 + coalesce(sum(0.25 * (col - 3)) OVER w, 0)::DOUBLE))), 4) AS probability
           FROM idle LEFT JOIN lc USING (template_id)
           WINDOW w AS (PARTITION BY block_id, episode ORDER BY position ROWS UNBOUNDED PRECEDING)""",
    ),
)
def block_score_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of partial blocks as lines arrive; blocks that pause for a day start anew."""
    return spark.read.parquet(f"{run_score_stream(spark, sf)}-rows").select("position", "block_id", "lines", "probability", "basis")


@query(
    "idle_block_state",
    sql(
        IDLE_SQL,
        f"""SELECT block_id, count(*) AS lines FROM idle JOIN (SELECT block_id, max(episode) AS episode, max(ms) AS last FROM idle GROUP BY block_id) USING (block_id, episode)
           WHERE last + {IDLE_S * 1000} + 1 > (SELECT max(ms) FROM timed) - {LATENESS_S * 1000} GROUP BY block_id""",
    ),
)
def idle_block_state(spark: SparkSession, sf: str) -> DataFrame:
    """What the stopped stream keeps: blocks that paused too long are gone, those that came back count from their return."""
    from ..streaming.score_stream import tracked_blocks

    return tracked_blocks(spark, f"{run_score_stream(spark, sf)}-state")
