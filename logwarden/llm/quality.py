"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is described by character, word-shape and hashed word
shares, encoded by one learned layer, and weighed by gated attention, softmax(w (tanh(V h) * sigmoid(U h))); the weighted
encoding is scored. Only documents carry labels. The model is fitted on the driver from a bounded sample of labelled
documents; scores read whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays
from .registry import query, table

PASSAGE = 64  # words
SAMPLE = 4000  # labelled documents that the model is fitted on, at most
BAG = 48  # passages of one document used in fitting, at most, evenly spread
SHAPES, WORDS = 288, 128
HIDDEN, GATE = 32, 16
EPOCHS, RATE, DECAY = 40, 3e-3, 1e-4

# 0 lower, 1 upper, 2 digit, 3 other ASCII, 4 beyond ASCII, 5 control
_CLASS = np.full(256, 3, np.uint8)
_CLASS[:32] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 4
PLAIN = 6 + 4
CLIP = 4.0  # standard deviations
WIDTH = PLAIN + SHAPES + WORDS


def passages(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bag of each passage counted from it, features) of slices; a text without words has one empty passage."""
    for i, j, data, offsets in arrays.slices(column):
        starts, ends, rows = arrays.words(data, offsets)
        hashes = arrays.hash_words(data, starts, ends)
        per = np.bincount(rows, minlength=j - i)
        first = np.cumsum(per) - per
        count = np.maximum(1, -(-per // PASSAGE))
        base = np.cumsum(count) - count
        place = base[rows] + (np.arange(len(rows)) - first[rows]) // PASSAGE
        bags = np.repeat(np.arange(j - i), count)
        yield i, bags, _features(data, starts, ends, hashes, place, len(bags))


def _features(data, starts, ends, hashes, place, n: int) -> np.ndarray:
    out = np.zeros((n, WIDTH), np.float32)
    if not len(starts):
        return out
    kind = _CLASS[data]
    words = np.bincount(place, minlength=n).astype(np.float32)
    scale = 1 / np.maximum(words, 1)
    size = ends - starts
    chars = np.bincount(place, size, n).astype(np.float32)
    for c in range(6):
        before = np.concatenate(([0], np.cumsum(kind == c)))
        out[:, c] = np.bincount(place, before[ends] - before[starts], n) / np.maximum(chars, 1)
    out[:, 6] = np.log1p(chars * scale)
    pair = np.sort((place.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.concatenate(([True], pair[1:] != pair[:-1]))
    out[:, 7] = np.bincount((pair[new] >> np.uint64(40)).astype(np.int64), minlength=n) * scale
    out[:, 8] = words / PASSAGE
    again = np.zeros(len(place))
    again[1:] = (hashes[1:] == hashes[:-1]) & (place[1:] == place[:-1])
    out[:, 9] = np.bincount(place, again, n) * scale
    shape = (kind[starts].astype(np.int64) * 6 + kind[ends - 1]) * 8 + np.minimum(size, 8) - 1
    out[:, PLAIN : PLAIN + SHAPES] = np.bincount(place * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES) * scale[:, None]
    bucket = (hashes >> np.uint64(57)).astype(np.int64)
    out[:, PLAIN + SHAPES :] = np.bincount(place * WORDS + bucket, minlength=n * WORDS).reshape(n, WORDS) * scale[:, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(x: np.ndarray, bags: np.ndarray, n: int) -> np.ndarray:
    """Sums over the rows of each bag; every bag has a row, and rows are ordered by bag."""
    return np.add.reduceat(x, np.searchsorted(bags, np.arange(n)), axis=0)


def _softmax(logit: np.ndarray, bags: np.ndarray, n: int) -> np.ndarray:
    top = np.maximum.reduceat(logit, np.searchsorted(bags, np.arange(n)))
    e = np.exp(logit - top[bags])
    return e / _sums(e, bags, n)[bags]


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.spread, -CLIP, CLIP)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings of passages and their attention logits."""
        w = self.weights
        h = np.tanh(self.standard(x) @ w["E"] + w["e"])
        return h, (np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])) @ w["w"]

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for first, bags, x in passages(column):
            n = int(bags[-1]) + 1
            parts = [self.encode(x[i : i + 8192]) for i in range(0, len(x), 8192)]
            h, logit = (np.concatenate(p) for p in zip(*parts, strict=True))
            z = _sums(h * _softmax(logit, bags, n)[:, None], bags, n)
            out[first : first + n] = _sigmoid(z @ self.weights["c"] + self.weights["b"][0])
        return out


def fit_bags(x: np.ndarray, bags: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Fit on passages ordered by bag; with labels of one class or none the scores are that class's share."""
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0, dtype=np.float64).astype(np.float32) if len(x) else np.zeros(WIDTH, np.float32)
    deviation = x.std(axis=0, dtype=np.float64).astype(np.float32) if len(x) else np.zeros(WIDTH, np.float32)
    spread = 1 / np.maximum(deviation, 1e-2)

    def made(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    w = {
        "E": made(WIDTH, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": made(HIDDEN, GATE), "U": made(HIDDEN, GATE),
        "w": made(GATE), "c": made(HIDDEN), "b": np.zeros(1, np.float32),
    }
    if len(np.unique(y)) < 2:
        w["c"][:] = 0
        w["b"][:] = 0 if not len(y) else 4 * (2 * float(y[0]) - 1)
        return Model(mean, spread, w)
    x = Model(mean, spread, w).standard(x)
    starts = np.searchsorted(bags, np.arange(len(y) + 1))
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v2 = {k: np.zeros_like(v) for k, v in w.items()}
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            chosen = np.sort(order[at : at + 64])
            rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in chosen])
            own = np.repeat(np.arange(len(chosen)), starts[chosen + 1] - starts[chosen])
            grads = _gradients(w, x[rows], own, y[chosen], balance[chosen])
            step += 1
            for k, g in grads.items():
                g = g + DECAY * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                w[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(mean, spread, w)


def _gradients(w, x, bags, y, weight) -> dict[str, np.ndarray]:
    n = len(y)
    h = np.tanh(x @ w["E"] + w["e"])
    t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    a = _softmax((t * s) @ w["w"], bags, n)
    z = _sums(h * a[:, None], bags, n)
    d = ((_sigmoid(z @ w["c"] + w["b"]) - y) * weight / n).astype(np.float32)
    dz = d[:, None] * w["c"]
    da = (h * dz[bags]).sum(axis=1)
    dl = a * (da - _sums(a * da, bags, n)[bags])
    dg = dl[:, None] * w["w"]
    dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
    dh = (a[:, None] * dz[bags] + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
    return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ dl, "c": z.T @ d, "b": d.sum(keepdims=True)}


def held_out(key: str) -> Column:
    """Rows whose labels are never used in fitting; a null key counts as held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sample_labels(labels: DataFrame, key: str, label: str, sample: int) -> DataFrame:
    """(key, y): at most ``sample`` documents with a label outside the held-out part, by the order of a hash.

    A document labelled more than once has the label that most of its rows have, 1 if they tie.
    """
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out(key)).groupBy(F.col(key).alias("key"))
    voted = usable.agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    return voted.orderBy(F.xxhash64("key"), "key").limit(sample)


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE
) -> Model:
    """A model of the labelled rows of ``docs``. Of a key's rows one is used, that of the smallest text hash."""
    chosen = F.broadcast(sample_labels(labels, key, label, sample))  # at most ``sample`` rows of two numbers
    copies = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, "key")
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "y")).alias("first")  # one row a key, chosen before the shuffle too
    rows = copies.groupBy("key").agg(first).select("key", "first.text", "first.y")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, bags, x in passages(batch.column(1)):
                at = np.searchsorted(bags, np.arange(int(bags[-1]) + 2))
                for i in range(len(at) - 1):
                    n = at[i + 1] - at[i]
                    part = x[at[i] + (np.arange(min(n, BAG)) * n) // min(n, BAG)]
                    row = batch.slice(first + i, 1)
                    data = pa.array([part.astype("<f2").tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([row.column(0), row.column(2), data], ["key", "y", "x"])

    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(describe, f"key {kind}, y int, x binary").collect()  # one row a chosen key: bounded by sample and BAG
    found.sort(key=lambda r: (repr(r.key), bytes(r.x)))
    parts = [np.frombuffer(r.x, "<f2").reshape(-1, WIDTH).astype(np.float32) for r in found]
    bags = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    x = np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.float32)
    return fit_bags(x, bags, np.array([r.y for r in found], np.float32))


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row of ``docs``: null text counts as empty, repeated rows and null keys are rows like any
    other, an empty table gives none; no other column is read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(batch.column(1)))], ["key", "score"])

    return rows.mapInArrow(score, f"key {rows.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns kept, that score at least ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.score(batch.column(at)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


@query("op6_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
