"""Scores of partial blocks on a stream: per block its counts, in keyed state that an event-time timer clears."""

from __future__ import annotations

import sys
import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import BASIS, WEIGHT_UNITS, probability
from .keyed import BUCKETS, BucketProcessor, bucket, kept_entries
from .loop_stream import ROCKSDB


class BlockProcessor(BucketProcessor):
    """Running line count and weight sum of every block of a bucket.

    A pause of more than ``idle_ms`` between two lines starts the block anew, whether or not the timer that frees its state
    has run by then; so results do not depend on how the lines fall into micro-batches. Rows of one micro-batch come in
    any order and are sorted first; their number is bounded by the sources' trigger options.
    """

    key = "block_id"
    fields = {"block_id": "string", "lines": "long", "units": "long", "ms": "long"}

    def fold(self, entries: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        batch = rows.sort_values(["block_id", "position"], kind="stable")
        code, names = pd.factorize(batch["block_id"])
        ms, weight = batch["ms"].to_numpy(), batch["units"].to_numpy()
        first = np.diff(code, prepend=-1) != 0
        saved = entries.set_index("block_id").reindex(names, fill_value=0)
        known = pd.Index(names).isin(entries["block_id"])
        before = np.concatenate((ms[:1], ms[:-1]))
        before[first] = np.where(known, saved["ms"].to_numpy(), ms[first])
        begins = first | (ms - before > self.idle_ms)  # the others go on from the row before, or from the saved state
        goes_on = first & (ms - before <= self.idle_ms)
        at = np.flatnonzero(begins)
        part = np.cumsum(begins) - 1
        lines, units = (np.where(goes_on, saved[c].to_numpy()[code], 0)[at][part] for c in ("lines", "units"))
        summed = np.cumsum(weight)
        counted = np.arange(1, len(ms) + 1) - at[part] + lines
        summed = summed - (summed - weight)[at][part] + units
        last = np.concatenate((np.flatnonzero(first)[1:] - 1, [len(ms) - 1]))
        out = pd.DataFrame({"block_id": batch["block_id"].to_numpy(), "position": batch["position"].to_numpy(), "lines": counted, "units": summed})
        return out, pd.DataFrame({"block_id": names, "lines": counted[last], "units": summed[last], "ms": ms[last]})


def score_blocks_stream(
    lines: DataFrame, weights: DataFrame, intercept: float, idle_seconds: int, at: str = "at", lateness: str = "1 minute", buckets: int = BUCKETS
) -> DataFrame:
    """Streaming twin of ``blocks.partial_block_scores``: (block_id, position, lines, probability, basis).

    ``lines`` is a stream, or a union of several, of (position, at, block_id, column), ``weights`` a static table (column,
    weight); a line without a column counts but weighs nothing. Blocks idle for more than ``idle_seconds`` of event time
    leave the state once the watermark has passed, and start anew on return. Lines later than the watermark are dropped.
    State is kept in ``buckets`` of blocks.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    cloudpickle.register_pickle_by_value(sys.modules[__package__.split(".")[0]])
    units = F.round(F.col("weight") * WEIGHT_UNITS).cast("long")
    weighed = lines.withWatermark(at, lateness).join(weights.select("column", units.alias("units")), "column", "left")
    rows = weighed.select("block_id", "position", at, F.unix_millis(at).alias("ms"), F.coalesce("units", F.lit(0).cast("long")).alias("units"))
    scored = rows.withColumn("bucket", bucket("block_id", buckets)).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=BlockProcessor(idle_seconds * 1000), outputStructType="block_id string, position long, lines long, units long",
        outputMode="Append", timeMode="EventTime",
    )
    margin = F.lit(float(intercept)) + F.col("units") / F.lit(float(WEIGHT_UNITS))
    return scored.select("block_id", "position", "lines", probability(margin).alias("probability"), F.lit(BASIS).alias("basis"))


def tracked_blocks(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(block_id, lines) that a stopped stream still keeps, read from its state store."""
    return kept_entries(spark, checkpoint, "block_id", "lines")
