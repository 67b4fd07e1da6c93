"""Tracking the most recently touched keys: which of them a bounded table would have evicted.

The table at the start of a line is the ``limit`` latest keys before it, whatever came earlier. So the log is cut into buckets
of line numbers and each bucket's own latest keys are found first. A bucket with ``limit`` keys of its own is all the next
one needs to know; those with fewer are folded after it, up to the next full one. With its table at hand a bucket is followed
line by line: a touch that misses the table takes the key up anew, and is an eviction's return unless it is the key's first.
Buckets span 16 times the limit at least, so the handed tables hold at most a sixteenth as many rows as the log has lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import WIDTH, running_sums, top_per_key

PARTS = 16  # buckets here are this much narrower than those of running sums, and this many times the limit at least


def _trim(table: dict, limit: int) -> None:
    while len(table) > limit:
        del table[next(iter(table))]


def _handed(limit: int, key: str, line: str, place: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Latest keys of buckets, by segment, bucket and last touch, to the table that the next bucket starts with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, bucket, following, table = None, None, None, {}

        def handed(schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            if following is not None:
                rows = [{"__bucket": following, line: at, place: p, key: k} for k, (at, p) in table.items()]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([schema.field(n) for n in ("__bucket", line, place, key)]))

        schema = None
        for batch in batches:
            schema = batch.schema
            for s, b, n, at, p, k in zip(*(batch.column(c).to_pylist() for c in ("__segment", "__bucket", "__next", line, place, key)), strict=True):
                if b != bucket:
                    yield from handed(schema)
                    if s != segment:
                        table = {}
                    segment, bucket, following = s, b, n
                table.pop(k, None)
                table[k] = (at, p)
                _trim(table, limit)
        if schema is not None:
            yield from handed(schema)

    return run


def _followed(limit: int, key: str, line: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows by bucket, line and place, the handed table before each bucket's own, with ``taken_up``: a miss of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, current, table = None, None, {}
        for batch in batches:
            missed = []
            for b, at, k in zip(*(batch.column(c).to_pylist() for c in ("__bucket", line, key)), strict=True):
                if b != bucket:
                    bucket, current, table = b, at, {}
                if at != current:
                    current = at
                    _trim(table, limit)
                missed.append(table.pop(k, None) is None)
                table[k] = True
            kept = batch.append_column("taken_up", pa.array(missed, pa.bool_()))
            kept = kept.filter(pc.invert(kept.column("__handed")))
            yield kept.drop_columns(["__bucket", "__handed"])

    return run


def _taken_up(touches: DataFrame, limit: int, key: str, line: str, place: str, width: int) -> DataFrame:
    """``touches`` with ``taken_up``: the table of the ``limit`` latest keys did not hold the key."""
    span = max(width // PARTS, PARTS * limit, 1)
    rows = touches.withColumn("__bucket", F.floor(F.col(line) / F.lit(span)).cast("long"))
    last = rows.groupBy("__bucket", key).agg(F.max(F.struct(line, place)).alias("__last"))
    tails = top_per_key(last, ["__bucket"], [F.desc("__last")], limit, "__rank")
    tails = cut_lineage(tails.select("__bucket", f"__last.{line}", f"__last.{place}", key))
    # One row per bucket: they are ordered as a whole.
    whole = Window.orderBy("__bucket")
    full = F.count_if(F.col("__n") >= limit).over(whole.rowsBetween(Window.unboundedPreceding, 0))
    buckets = tails.groupBy("__bucket").agg(F.count("*").alias("__n")).select("__bucket", full.alias("__segment"), F.lead("__bucket").over(whole).alias("__next"))
    ordered = tails.join(buckets, "__bucket").repartition("__segment").sortWithinPartitions("__segment", "__bucket", line, place)
    tables = ordered.mapInArrow(_handed(limit, key, line, place), rows.select("__bucket", line, place, key).schema)
    both = rows.withColumn("__handed", F.lit(False)).unionByName(tables.withColumn("__handed", F.lit(True)), allowMissingColumns=True)
    both = both.repartition("__bucket").sortWithinPartitions("__bucket", line, place)
    return both.mapInArrow(_followed(limit, key, line), touches.withColumn("taken_up", F.lit(True)).schema)


def tracked(touches: DataFrame, limit: int, key: str = "block_id", line: str = "position", place: str = "place", width: int = WIDTH) -> DataFrame:
    """``touches`` with ``evicted`` (the key was dropped since its last touch from a table of the ``limit`` latest keys) and
    ``episode``: how often it was dropped before; what is kept of a key starts anew in each.

    A line's touches are its ``place`` 0, 1, ...; keys are dropped after a line, oldest touch first. A key's first touch is not
    an eviction. (line, place) must be unique; other columns stay.
    """
    rows = cut_lineage(_taken_up(touches, limit, key, line, place, width))
    # a key's first touch always misses the table
    counted = running_sums(rows, line, {"episode": F.col("taken_up").cast("long")}, by=(key,), ties=(place,), width=width)
    episode = F.col("episode") - 1
    return counted.select(*touches.columns, (F.col("taken_up") & (episode > 0)).alias("evicted"), episode.alias("episode"))


def reuse(touches: DataFrame, limit: int, key: str = "block_id", line: str = "position", place: str = "place", width: int = WIDTH) -> DataFrame:
    """``tracked`` without ``episode``."""
    return tracked(touches, limit, key, line, place, width).drop("episode")


def eviction_counts(rows: DataFrame, limit: int, key: str = "block_id") -> DataFrame:
    """One row over the rows of ``reuse``: keys seen, tracked at the end, and evictions, those not touched again included."""
    counts = rows.agg(F.count_if("evicted").alias("returned"), F.count_distinct(key).alias("seen"))
    tracked_now = F.least("seen", F.lit(limit))
    return counts.select(
        F.col("seen").alias("blocks_seen"), tracked_now.alias("blocks_tracked"), F.col("returned").alias("blocks_returned"),
        (F.col("returned") + F.col("seen") - tracked_now).alias("evicted"),
    )
