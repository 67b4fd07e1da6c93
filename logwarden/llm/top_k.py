"""Exact top-k by inner product with no-random-access aggregation.

Every component is a sorted list. A segment of vectors is read from the good end of each list (by the sign of the
query's component) to growing depths. What has been read, and the last value read of each list, bound every
score from below and above; a query stops when the vectors whose upper bound reaches its k-th lower bound are few,
and only their scores are resolved. Bounds of all queries and vectors of a segment are matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .registry import query, table

K = 10
QUERY_BYTES = 32 << 20  # of queries broadcast at a time
SEGMENT = 4096
DEPTHS = (1 / 8, 1 / 4, 1 / 2, 1)
EXACT = 2.0**53


def quantized(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(key, v array<bigint>): floor(scale * x) of vectors without null or non-finite components."""
    x = F.transform(vector, lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(whole)
    return kept.select(F.col(key).cast("long").alias("key"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


class Best:
    """The k best (score, id) so far of each query."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.score = [np.zeros(0, np.int64) for _ in range(queries)]
        self.ids = [np.zeros(0, np.int64) for _ in range(queries)]

    def floor(self, q: int) -> float:
        return float(self.score[q][-1]) if len(self.score[q]) == self.k else -np.inf

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate((self.score[q], score)), np.concatenate((self.ids[q], ids))
        order = np.lexsort((ids, -score))[: self.k]
        self.score[q], self.ids[q] = score[order], ids[order]


def search_segment(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, best: Best) -> None:
    """Read the lists of one segment for all queries."""
    n, dims = x.shape
    top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(dims, 1)
    if not dims or top >= EXACT / 4:  # bounds would round: score all, in 64-bit integers
        for i in range(len(q)):
            own = ids != q_ids[i]
            best.add(i, (x @ q[i])[own], ids[own])
        return
    xf, up, down = x.astype(np.float64), np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    ranked = np.sort(xf, axis=0)
    low, high = ranked[0], ranked[-1]
    open_ = np.arange(len(q))
    for depth in DEPTHS:
        t = max(1, min(n, round(depth * n)))
        tops, bottoms = ranked[n - t], ranked[t - 1]  # the last value read from either end of each list
        u, d = up[open_], down[open_]
        upper = np.maximum(xf, tops) @ u.T + np.minimum(xf, bottoms) @ d.T
        lower = np.where(xf >= tops, xf, low) @ u.T + np.where(xf <= bottoms, xf, high) @ d.T
        left = []
        for c, i in enumerate(open_):
            own = ids == q_ids[i]
            k = best.k + int(own.sum())
            bound = best.floor(i)
            if n >= k:
                reached = np.where(own, -np.inf, lower[:, c])
                bound = max(bound, float(np.partition(reached, n - best.k)[n - best.k]))
            may = np.flatnonzero((upper[:, c] >= bound) & ~own)
            if t < n and len(may) > max(8 * best.k, n // 16):
                left.append(i)
            elif len(may):
                best.add(i, x[may] @ q[i], ids[may])
        open_ = np.array(left, np.int64)
        if not len(open_):
            return


def search_block(candidates: DataFrame, ids: np.ndarray, vectors: list[np.ndarray], k: int) -> DataFrame:
    """(query_id, vec_id, score): each task's k best for a block of queries."""
    block = candidates.sparkSession.sparkContext.broadcast((ids, vectors))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_vectors = block.value
        size = np.array([len(v) for v in q_vectors])
        groups = {int(d): np.flatnonzero(size == d) for d in np.unique(size)}
        best = {d: Best(len(g), k) for d, g in groups.items()}
        matrix = {d: np.stack([q_vectors[i] for i in g]) for d, g in groups.items()}
        for batch in batches:
            keys = batch.column(0).to_numpy()
            lists = batch.column(1)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            lengths = np.diff(at)
            for d in np.unique(lengths):
                if int(d) not in groups:
                    continue
                rows = np.flatnonzero(lengths == d)
                for i in range(0, len(rows), SEGMENT):
                    part = rows[i : i + SEGMENT]
                    x = flat[at[part][:, None] + np.arange(d)]
                    search_segment(x, keys[part], matrix[int(d)], q_ids[groups[int(d)]], best[int(d)])
        for d, g in groups.items():
            for j, i in enumerate(g):
                found = best[d]
                if len(found.ids[j]):
                    own = np.full(len(found.ids[j]), q_ids[i])
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(found.ids[j]), pa.array(found.score[j])], ["query_id", "vec_id", "score"])

    return candidates.mapInArrow(search, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best ``vectors`` (key, v) of each key of ``queries`` (key, v).

    Equal query rows count once; different vectors under one key share its k places, however queries fall into blocks.
    A query's own key is no candidate; vectors meet queries of equal dimension only. Repeated candidate rows count
    each; ties go to the smaller key. Fewer candidates than k give fewer rows, empty tables none. Scores are 64-bit
    integers: components whose products leave that range wrap. Queries are broadcast in blocks of at most
    ``QUERY_BYTES``, each block's result is written out before the next one starts.
    """
    found: list[DataFrame] = []
    ids: list[int] = []
    block: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal ids, block, size
        if ids:
            found.append(cut_lineage(best_per_query(search_block(vectors, np.array(ids, np.int64), block, k), k)))
        ids, block, size = [], [], 0

    for row in queries.dropDuplicates().toLocalIterator():
        ids.append(row.key)
        block.append(np.array(row.v, np.int64))
        size += 8 * len(row.v) + 64
        if size >= QUERY_BYTES:
            flush()
    flush()
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return best_per_query(out, k) if len(found) > 1 else out  # a key may be in several blocks


def best_per_query(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, v.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.v) = len(v.v)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op10_top_k", ORACLE)
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("key") % 100 == 0))
