"""Rows in an order that no single task holds: places within keys, and digests of a key's rows read in turn."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

PART = 33  # monotonically_increasing_id counts in 33 bits within a partition


def placed(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` written in order of ``key`` and ``order``, with ``pos`` (long), which rises in that order, nulls first, over the whole table.

    The ranges are cut by key and order together, with a salt for equal rows, so neither a key with many rows nor a row with
    many copies is one task's.
    """
    by = [F.col(key), *order, F.rand(11)]
    columns = [f"_o{i}" for i in range(len(by))]
    keyed = rows.select("*", *[c.alias(n) for c, n in zip(by, columns)])
    ordered = keyed.repartitionByRange(*columns).sortWithinPartitions(*columns).drop(*columns)
    return stored(ordered.withColumn("pos", F.monotonically_increasing_id()), name)


def spans(rows: DataFrame, key: str) -> DataFrame:
    """(key, part, base, n, before, total) of the rows of ``placed``: one row per key and partition."""
    by = Window.partitionBy(key)
    return (
        rows.groupBy(key, F.shiftright("pos", PART).alias("part"))
        .agg(F.min("pos").alias("base"), F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("total", F.sum("n").over(by))
    )


def digests(rows: DataFrame, keys: list[str], order: list[str], piece: str, glue: str) -> DataFrame:
    """(keys, sha256): the lower-case hex digest of a key's ``piece`` strings, in ``order`` and joined by ``glue``.

    A key's rows pass through one task in turn, since the digest is one chain, but are never held together.
    """
    schema = rows.select(*keys, F.lit("").alias("sha256")).schema
    ordered = rows.select(*keys, *order, piece).repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, done = None, None, []
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            owners = zip(*[batch.column(k).to_pylist() for k in keys])
            for owner, text in zip(owners, batch.column(piece).to_pylist()):
                if sha is None or owner != now:
                    if sha is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = owner, hashlib.sha256()
                else:
                    sha.update(glue.encode())
                sha.update(text.encode())
            if len(done) >= 5000:
                yield _rows(done, keys, kinds)
                done = []
        if sha is not None:
            done.append((*now, sha.hexdigest()))
        if done:
            yield _rows(done, keys, kinds)

    return ordered.mapInArrow(run, schema)


def _rows(done: list[tuple], keys: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*done))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*kinds, pa.string()))], [*keys, "sha256"])
