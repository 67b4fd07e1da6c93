"""Arrow batches of sorted rows, cut between groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by a long ``key``, cut between its values: (rows, group offsets). Holds one batch and one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(key).to_numpy()
        last = int(np.searchsorted(ids, ids[-1]))
        if held and (last or held[-1].column(key)[-1].as_py() != ids[-1]):
            yield _group([*held, batch.slice(0, last)], key)
            held = []
        elif last:
            yield _group([batch.slice(0, last)], key)
        held.append(batch.slice(last))
    if held:
        yield _group(held, key)


def _group(parts: list[pa.RecordBatch], key: str) -> tuple[pa.Table, np.ndarray]:
    rows = pa.Table.from_batches([p for p in parts if p.num_rows]).combine_chunks()
    ids = rows.column(key).to_numpy()
    cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
    return rows, np.concatenate(([0], cuts, [len(ids)]))
