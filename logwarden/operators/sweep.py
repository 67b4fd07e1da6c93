"""Points against intervals in one sorted pass: no bins, no pairs of points and intervals.

Interval starts and points are sorted together in range partitions; a point is covered if the furthest end of the starts before it
lies beyond it. Each partition tells the furthest end of the key that it ends in, which is carried to the partitions that
go on with that key: one row per partition. Any point, key or interval may have any share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

NONE = -(1 << 62)  # before every end
START, POINT, TAIL = 0, 1, 2
ORDER = ("grp", "at", "seq", "kind")


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, key, reach, opens = TaskContext.get().partitionId(), None, NONE, True
    kind_of = None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind_of = batch.schema.field("grp").type
        codes = batch.column("grp").dictionary_encode()
        group, first = codes.indices.to_numpy(), codes.dictionary[0].as_py()
        if key is not None and first != key:
            reach, opens = NONE, False
        begins = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1))
        ends = np.where(batch.column("kind").to_numpy() == START, batch.column("end").to_numpy(), NONE)
        best = np.empty(len(ends), np.int64)
        for a, b in zip(begins, [*begins[1:], len(ends)]):
            best[a:b] = np.maximum(np.maximum.accumulate(ends[a:b]), reach)
            if b < len(ends):
                reach = NONE
        known = np.full(len(ends), opens)
        if len(begins) > 1:
            known[begins[1] :] = opens = False
        reach, key = int(best[-1]), batch.column("grp")[-1].as_py()
        keep = np.flatnonzero(batch.column("kind").to_numpy() == POINT)
        rows = batch.take(pa.array(keep))
        yield pa.RecordBatch.from_arrays(
            [rows.column("grp"), rows.column("at"), rows.column("seq"), rows.column("kind"), pa.array(best[keep]), pa.array(known[keep]), pa.array(np.full(len(keep), part, np.int64))],
            OUT,
        )
    if kind_of is not None:
        one = [pa.array([key], kind_of), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([TAIL], pa.int32()), pa.array([reach], pa.int64()), pa.array([opens]), pa.array([part], pa.int64())]
        yield pa.RecordBatch.from_arrays(one, OUT)


OUT = ["grp", "at", "seq", "kind", "reach", "goes_on", "part"]


def reach_of(points: DataFrame, starts: DataFrame) -> DataFrame:
    """``points`` (grp, at, seq) with ``reach``: the furthest end of the ``starts`` (grp, at, seq, end) of their group that come no later.

    Order is by at, then seq; at equal places starts come first. Without such a start ``reach`` is null. Repeated points stay; rows with
    a null group meet nothing.
    """
    none = F.lit(NONE).cast("long")
    rows = starts.select("grp", "at", "seq", F.lit(START).alias("kind"), "end").unionByName(points.select("grp", "at", "seq", F.lit(POINT).alias("kind"), none.alias("end")))
    rows = rows.where("grp IS NOT NULL AND at IS NOT NULL").withColumn("salt", F.rand(5))
    ordered = rows.repartitionByRange(*ORDER, "salt").sortWithinPartitions(*ORDER).drop("salt")
    kind = rows.schema["grp"].dataType.simpleString()
    swept = cut_lineage(ordered.mapInArrow(_reached, f"grp {kind}, at long, seq long, kind int, reach long, goes_on boolean, part long"))
    # one row per partition from here to the join
    tails = swept.where(F.col("kind") == TAIL)
    by = Window.partitionBy("grp").orderBy("part")
    carried = tails.select(
        F.col("grp").alias("g"), F.lead("part").over(Window.orderBy("part")).alias("p"), F.max("reach").over(by).alias("carried")
    ).where("p IS NOT NULL")
    joined = swept.where(F.col("kind") == POINT).join(carried, F.col("goes_on") & (F.col("grp") == F.col("g")) & (F.col("part") == F.col("p")), "left")
    reach = F.greatest("reach", F.coalesce("carried", none))
    return joined.select("grp", "at", "seq", F.when(reach > none, reach).alias("reach"))


def covered(points: DataFrame, starts: DataFrame, inclusive: bool = False) -> DataFrame:
    """The points of ``reach_of`` that lie before the furthest end, or on it."""
    found = reach_of(points, starts)
    inside = F.col("reach") >= F.col("at") if inclusive else F.col("reach") > F.col("at")
    return found.where(inside)
