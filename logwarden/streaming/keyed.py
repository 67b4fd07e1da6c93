"""Keyed state in buckets: one state value and one timer hold the entries of many keys.

A call of a stateful processor and each of its reads, writes and timers cost far more than the few rows that a key has in
a micro-batch. So keys are dealt into a fixed number of buckets by their hash, and what is kept of a bucket's keys is read and
written at once. A bucket's one timer stands at its first expiry; when it fires, all entries past theirs go.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BUCKETS = 1024  # the same for the whole life of a stream
STATE = "entries"


def bucket(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


class BucketProcessor(StatefulProcessor):
    """``fold`` gets the sorted entries of a bucket and its new rows, and returns the output and the entries of the keys met.

    ``fields`` are the columns of an entry: ``key`` and ``ms``, the time of its last row, among them.
    """

    key: str
    fields: dict[str, str]

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = ", ".join(f"{name} array<{kind}>" for name, kind in self.fields.items())
        self.state = handle.getValueState(STATE, f"{columns}, timer long")

    def fold(self, entries: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entries, timer = self._saved()
        out, met = self.fold(entries, pd.concat(list(rows), ignore_index=True))
        others = entries[~entries[self.key].isin(met[self.key])]
        self._save(pd.concat([others, met], ignore_index=True) if len(others) else met, timer)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        entries, _ = self._saved()
        self._save(entries[entries["ms"] + self.idle_ms + 1 > timerValues.getCurrentWatermarkInMs()], None)
        return iter(())

    def close(self) -> None:
        pass

    def _saved(self) -> tuple[pd.DataFrame, int | None]:
        saved = self.state.get() if self.state.exists() else None
        *columns, timer = saved if saved is not None else [*([] for _ in self.fields), None]
        kinds = {name: "int64" if kind == "long" else "object" for name, kind in self.fields.items()}
        return pd.DataFrame({n: pd.Series(list(c), dtype=kinds[n]) for n, c in zip(self.fields, columns)}), timer

    def _save(self, entries: pd.DataFrame, timer: int | None) -> None:
        due = None
        if self.idle_ms is not None and len(entries):
            due = int(entries["ms"].min()) + self.idle_ms + 1
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if len(entries):
            self.state.update((*(entries[name].tolist() for name in self.fields), due))
        else:
            self.state.clear()


def kept_entries(spark: SparkSession, checkpoint: str, *fields: str) -> DataFrame:
    """``fields`` of every entry that a stopped stream still keeps, read from its state store."""
    state = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint)
    return state.select(F.explode(F.arrays_zip(*[F.col(f"value.{f}").alias(f) for f in fields])).alias("e")).select("e.*")
