"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle set, each class holding sizes within a factor of ``GROWTH``. For a
class with sizes up to u, a document is read as windows of 2u shingles, u apart: a passage of u shingles lies whole in one
of them, so an item contained in a long document is similar to a window however long the document is. Windows and
items are compared by one-permutation MinHash: per permutation, the least hash in each of 32 bins; one agreeing bin
makes a candidate. Candidates are verified by exact shingle containment in the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import arrays
from .registry import query, table

SHINGLE = 5
CONTAINED = 0.8
GROWTH = 1.5
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)  # one permutation each
BINS = 32
BLOCK_BYTES = 8 << 20  # of item text broadcast at a time
_TOP, _SIEVE = np.uint64(59), np.uint64(48)


class Items:
    """The shingle sets of a block of test items, and for each size class the bin minima of its items."""

    def __init__(self, items: list[Row], k: int, contained: float) -> None:
        self.ids = [row.item for row in items]
        self.k, self.contained = k, contained
        self.sets: dict[int, np.ndarray] = dict(arrays.shingle_sets(pa.array([row.text for row in items], pa.string()), k))
        classes: dict[int, list[int]] = {}
        for i, s in self.sets.items():
            classes.setdefault(int(np.floor(np.log(len(s)) / np.log(GROWTH) + 1e-9)), []).append(i)
        self.classes = []
        for members in classes.values():
            tables = []
            for seed in SEEDS:
                keys, owners = [], []
                for i in members:
                    v = np.sort(arrays.mix(self.sets[i] ^ np.uint64(seed)))
                    first = np.flatnonzero(np.concatenate(([True], v[1:] >> _TOP != v[:-1] >> _TOP)))
                    keys.append(v[first])
                    owners.append(np.full(len(first), i))
                key, owner = np.concatenate(keys), np.concatenate(owners)
                order = np.argsort(key, kind="stable")
                sieve = np.zeros(1 << 16, bool)
                sieve[key >> _SIEVE] = True
                tables.append((key[order], owner[order], sieve))
            self.classes.append((max(len(self.sets[i]) for i in members), tables))

    def candidates(self, h: np.ndarray, rows: np.ndarray, n_rows: int) -> set[tuple[int, int]]:
        """(row, item) pairs with an agreeing bin in some window."""
        out: set[tuple[int, int]] = set()
        at = arrays.bounds(rows, n_rows)
        for u, tables in self.classes:
            blocks = -(-np.diff(at) // u)
            first = np.cumsum(blocks) - blocks
            row_of = np.repeat(np.arange(n_rows), blocks)
            total = int(blocks.sum())
            cell = (np.arange(len(h)) - at[rows]) + first[rows] * u
            joined = np.flatnonzero(row_of[1:] == row_of[:-1])
            for seed, (key, owner, sieve) in zip(SEEDS, tables, strict=True):
                padded = np.full(total * u, ~np.uint64(0))
                padded[cell] = arrays.mix(h ^ np.uint64(seed))
                sorted_ = np.sort(padded.reshape(total, u), axis=1)
                bins = (sorted_ >> _TOP).astype(np.int64)
                lead = np.ones(sorted_.shape, bool)
                lead[:, 1:] = bins[:, 1:] != bins[:, :-1]
                least = np.full((total, BINS), ~np.uint64(0))
                block, _ = np.nonzero(lead)
                least[block, bins[lead]] = sorted_[lead]
                window = least.copy()  # a last block is a window by itself
                window[joined] = np.minimum(least[joined], least[joined + 1])
                b, c = np.nonzero(sieve[window >> _SIEVE])
                value = window[b, c]
                low, high = np.searchsorted(key, value, "left"), np.searchsorted(key, value, "right")
                hit = np.flatnonzero(high > low)
                for r, i, j in zip(row_of[b[hit]].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                    out.update((r, item) for item in owner[i:j].tolist())
        return out

    def contained_in(self, column: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of every verified containment."""
        for i, j, data, offsets in arrays.slices(column):
            starts, ends, rows = arrays.words(data, offsets)
            h, r = arrays.shingles(arrays.hash_words(data, starts, ends), rows, j - i, self.k)
            if not len(h):
                continue
            at = arrays.bounds(r, j - i)
            sets: dict[int, np.ndarray] = {}
            for row, item in sorted(self.candidates(h, r, j - i)):
                if row not in sets:
                    sets = {row: np.unique(h[at[row] : at[row + 1]])}
                wanted = self.sets[item]
                place = np.minimum(np.searchsorted(sets[row], wanted), len(sets[row]) - 1)
                shared = int((sets[row][place] == wanted).sum())
                if shared >= self.contained * len(wanted) - 1e-9:
                    yield i + row, item, shared


def item_blocks(items: DataFrame, key: str, text: str, k: int, contained: float) -> Iterator[Items]:
    """Items in blocks of at most about ``BLOCK_BYTES`` of text, one at a time on the driver."""
    block: list[Row] = []
    size = 0
    for row in items.select(F.col(key).alias("item"), F.coalesce(text, F.lit("")).alias("text")).toLocalIterator():
        block.append(row)
        size += len(row.text) + 64
        if size >= BLOCK_BYTES:
            yield Items(block, k, contained)
            block, size = [], 0
    if block:
        yield Items(block, k, contained)


def find_contained(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text",
    k: int = SHINGLE, contained: float = CONTAINED,
) -> DataFrame:
    """(key, item_key, shared, item_shingles, containment) of every item whose shingles a document holds in that share.

    Words are lower-cased (A-Z) and split at white space; a text of fewer than ``k`` words is one shingle, and matches only such
    a text. Null, empty or blank texts contain nothing and are contained nowhere. Repeated rows on either side each
    count; null ids are kept; an empty table gives no rows. Documents are read once per block of items, without a
    shuffle; no other column is read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = rows.schema["key"].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"key {kinds[0]}, item {kinds[1]}, shared long, item_shingles long, containment double"
    found = None
    for block in item_blocks(items, item_key, text, k, contained):
        part = cut_lineage(rows.mapInArrow(_finder(docs.sparkSession, block), schema))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnsRenamed({"key": key, "item": item_key})


def _finder(spark: SparkSession, block: Items):
    sent = spark.sparkContext.broadcast(block)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        names = ["key", "item", "shared", "item_shingles", "containment"]
        for batch in batches:
            hits = list(items.contained_in(batch.column(1)))
            if hits:
                row, item, shared = (list(x) for x in zip(*hits, strict=True))
                size = [len(items.sets[i]) for i in item]
                columns = [
                    batch.column(0).take(pa.array(row)), pa.array([items.ids[i] for i in item]), pa.array(shared), pa.array(size),
                    pa.array([s / n for s, n in zip(shared, size, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return find


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", k: int = SHINGLE, contained: float = CONTAINED) -> DataFrame:
    """The rows of ``docs``, all columns kept, that contain no item; see ``find_contained``."""
    at = docs.columns.index(text)
    for block in item_blocks(items, "item_id", "text", k, contained):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, _, _ in sent.value.contained_in(batch.column(at)):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


SHINGLES_SQL = r"""
SELECT {id} AS id, CASE WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END AS s
FROM (SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM {table}) WHERE len(w) > 0
"""

ORACLE = f"""
WITH items AS (
  SELECT DISTINCT id, unnest(s) AS s FROM ({SHINGLES_SQL.format(id="item_id", table="benchmark")})
), sized AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM items
), texts AS (
  SELECT DISTINCT id, unnest(s) AS s FROM ({SHINGLES_SQL.format(id="doc_id", table="documents")})
)
SELECT texts.id AS doc_id, sized.id AS item_id, count(*) AS shared, n AS item_shingles, count(*) / n AS containment
FROM texts JOIN sized ON texts.s = sized.s GROUP BY texts.id, sized.id, n HAVING count(*) >= 0.8 * n
"""


@query("op3_decontaminate", ORACLE)
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
