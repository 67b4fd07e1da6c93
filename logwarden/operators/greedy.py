"""Paths of greedy choices: from each choice the next one is known, and only those met from the first one count.

The links are found by one search for all rows at a time. A path is then followed without walking it: rows fall into chunks
of bounded size, every chunk finds the row at which a path that enters at any of its rows leaves it, and jumps over whole
chunks are doubled by joins until they pass the end of every path. A group with most of the rows is spread over its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .batches import whole_groups
from .ordering import running_min

CHUNK = 1 << 16  # rows of a chunk


def next_at_least(points: DataFrame, queries: DataFrame, grp: str = "grp", width: int = 1 << 20) -> DataFrame:
    """(grp, i, next): for each of ``queries`` (grp, i, key) the smallest ``i`` of the ``points`` (grp, i, key) with no smaller key."""
    both = points.select(grp, (-F.col("key")).alias("back"), F.lit(0).alias("asks"), "i", F.col("i").alias("found")).unionByName(
        queries.select(grp, (-F.col("key")).alias("back"), F.lit(1).alias("asks"), "i", F.lit(None).cast("long").alias("found"))
    )
    done = running_min(both, "back", {"next": F.col("found")}, by=(grp,), ties=("asks",), width=width)
    return done.where("asks = 1").select(grp, "i", "next")


def _jumped(target: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers followed two, four, ... steps as long as they stay inside."""
    return np.where(inside, target[np.where(inside, target, 0)], target), inside & inside[np.where(inside, target, 0)]


def _local(rows: pa.Table, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number of the next row if it is in the same chunk, whether it is): rows sorted by (chunk, grp, i)."""
    i, grp, nxt = rows.column("i").to_numpy(), rows.column("grp").combine_chunks().dictionary_encode().indices.to_numpy(), rows.column("next").fill_null(-1).to_numpy()
    chunk = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    new = np.concatenate(([True], (chunk[1:] != chunk[:-1]) | (grp[1:] != grp[:-1])))
    part = np.cumsum(new) - 1
    # one number per row that rises with (part, i): the part times the span of i, plus i
    low = min(int(i.min()), int(nxt.min()))
    span = max(int(i.max()), int(nxt.max())) - low + 1
    if span * (int(part[-1]) + 1) < 1 << 62:
        rank, wanted = part * span + (i - low), part * span + (nxt - low)
    else:
        values, rank = np.unique(np.concatenate((i, nxt)), return_inverse=True)
        rank, wanted = part * len(values) + rank[: len(i)], part * len(values) + rank[len(i) :]
    at = np.minimum(np.searchsorted(rank, wanted), len(i) - 1)
    return at, (nxt >= 0) & (rank[at] == wanted)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, offsets in whole_groups(batches, "chunk"):
        at, inside = _local(rows, offsets)
        last = np.where(inside, at, np.arange(len(at)))
        while True:
            further = last[last]
            if (further == last).all():
                break
            last = further
        yield pa.RecordBatch.from_arrays(
            [rows.column("grp").combine_chunks(), rows.column("i").combine_chunks(), rows.column("next").combine_chunks().take(pa.array(last))], ["grp", "i", "next"]
        )


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, offsets in whole_groups(batches, "chunk"):
        at, inside = _local(rows, offsets)
        met = rows.column("entry").to_numpy(zero_copy_only=False).astype(bool)
        while True:
            reached = met.copy()
            reached[at[met & inside]] = True
            if (reached == met).all() and not inside.any():
                break
            met = reached
            at, inside = _jumped(at, inside)
        keep = pa.array(np.flatnonzero(met))
        yield pa.RecordBatch.from_arrays([rows.column("grp").combine_chunks().take(keep), rows.column("i").combine_chunks().take(keep)], ["grp", "i"])


def path(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(grp, i) of the rows met from each group's smallest ``i`` on, by ``next`` (null: the end).

    ``nodes`` has grp, i (long, unique in a group, ideally without large gaps) and next, the larger ``i`` of another row.
    """
    rows = cut_lineage(nodes.select("grp", "i", "next"))
    keyed = rows.withColumn("chunk", F.xxhash64("grp", F.floor(F.col("i") / chunk)))
    exits = keyed.repartition("chunk").sortWithinPartitions("chunk", "grp", "i").mapInArrow(_exits, rows.schema)
    exits = cut_lineage(exits)
    first = rows.groupBy("grp").agg(F.min("i").alias("i"))
    entered = exits.where("next IS NOT NULL").select("grp", F.col("next").alias("i")).unionByName(first).distinct()
    jump = cut_lineage(exits.join(entered, ["grp", "i"]).where("next IS NOT NULL"))
    met = first
    while not jump.isEmpty():
        step = jump.select("grp", F.col("i").alias("from"), F.col("next").alias("to"))
        reached = met.join(step, (met["grp"] == step["grp"]) & (met["i"] == step["from"])).select(met["grp"], F.col("to").alias("i"))
        met = cut_lineage(met.unionByName(reached).distinct())
        onward = jump.select(F.col("grp").alias("g"), F.col("i").alias("at"), F.col("next").alias("then"))
        jump = cut_lineage(jump.join(onward, (F.col("grp") == F.col("g")) & (F.col("next") == F.col("at"))).select("grp", "i", F.col("then").alias("next")))
    entries = keyed.join(met.withColumn("entry", F.lit(True)), ["grp", "i"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return entries.repartition("chunk").sortWithinPartitions("chunk", "grp", "i").mapInArrow(_marked, rows.drop("next").schema)
