"""Lines to per-block template counts, splits and label checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net import settled
from ..functions.text import block_ids, line_content
from ..session import cut_lineage
from .ordering import carry_last, running_sums


def with_blocks(lines: DataFrame, line: str = "value") -> DataFrame:
    """Add ``content`` and the ordered distinct block ids of each line."""
    return settled(settled(lines, "content", line_content(F.col(line))), "blocks", block_ids(F.col("content")))


def block_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row per line and block it names; lines without a block are skipped."""
    return with_blocks(lines, line).select("*", F.explode("blocks").alias("block_id")).drop("blocks")


def block_counts(matched: DataFrame) -> DataFrame:
    """(block_id, template_id, n) with map-side partial counts, so a busy block shuffles few rows."""
    return matched.where("template_id is not null").groupBy("block_id", "template_id").agg(
        F.count("*").alias("n")
    )


def vocabulary(counts: DataFrame) -> DataFrame:
    """(template_id, column): dense model columns in template order. One row per template."""
    w = Window.orderBy("template_id")
    return counts.select("template_id").distinct().withColumn(
        "column", (F.row_number().over(w) - 1).cast("int")
    )


def to_vectors(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(block_id, entries, features): sparse map, and ML vector with one place per vocabulary column.

    ``counts`` should be written already: its vocabulary's size, one number, is read first.
    """
    width = vocab.count()
    cells = F.array_sort(F.collect_list(F.struct("column", F.col("n").cast("double").alias("n"))))
    entries = counts.join(vocab, "template_id").groupBy("block_id").agg(cells.alias("cells"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), F.greatest(n, F.lit(0)))
    # the filled places in order, each after the gap before it
    gap = lambda c, i: c.column - F.when(i == 0, 0).otherwise(F.get(F.col("cells"), i - 1)["column"] + 1)
    filled = F.flatten(F.transform("cells", lambda c, i: F.concat(zeros(gap(c, i)), F.array(c.n))))
    dense = F.concat(filled, zeros(F.lit(width) - F.element_at("cells", -1)["column"] - 1))
    return entries.select("block_id", F.map_from_entries("cells").alias("entries"), array_to_vector(dense).alias("features"))


def labelled(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    return vectors.join(labels, "block_id")


def matrix_stats(lines: DataFrame, matrix: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: lines, lines with a block, blocks, anomalous blocks, rate, templates."""
    a = lines.agg(F.count("*").alias("lines_read"), F.count(F.when(F.size("blocks") > 0, 1)).alias("lines_with_block_id"))
    b = matrix.agg(
        F.count("*").alias("blocks"),
        F.coalesce(F.sum("label"), F.lit(0)).alias("anomalous_blocks"),
        F.round(F.coalesce(F.avg("label"), F.lit(0.0)), 5).alias("anomaly_rate"),
    )
    c = vocab.agg(F.count("*").alias("templates"))
    joined = a.withColumns({"__b": b.select(F.struct("*")).scalar(), "templates": c.scalar()})
    return joined.select("*", "__b.*").drop("__b")


def stratified_split(labels: DataFrame, seed: int = 42, key: str = "block_id", label: str = "label") -> DataFrame:
    """Add ``side``: half of every class is "train", chosen by a seeded hash of the key.

    The order inside a class is that of the hash; it is ranked bucket by bucket, so one huge class is
    not sorted in one task. The same seed and keys always give the same split.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)
    rows = labels.withColumn("__h", digest).withColumn(
        "__slot", F.conv(F.substring("__h", 1, 5), 16, 10).cast("long")
    )
    ranked = running_sums(
        rows, "__slot", {"__rank": F.lit(1).cast("long")}, by=(label,), ties=("__h", key), width=256
    )
    sizes = labels.groupBy(label).agg(F.count("*").alias("__size"))
    joined = ranked.join(sizes.withColumnRenamed(label, "__label"), F.col(label).eqNullSafe(F.col("__label")))
    side = F.when(F.col("__rank") <= F.floor(F.col("__size") / 2), "train").otherwise("test")
    return joined.withColumn("side", side).select(*labels.columns, "side")


def block_spans(lines: DataFrame, position: str = "position") -> DataFrame:
    """(block_id, first_line, last_line, lines)."""
    return lines.groupBy("block_id").agg(
        F.min(position).alias("first_line"), F.max(position).alias("last_line"), F.count("*").alias("lines")
    )


def time_disjoint_split(spans: DataFrame, total_lines: DataFrame) -> DataFrame:
    """Add ``side``: blocks ended by the midpoint line, blocks begun after it, or "excluded".

    ``total_lines`` is one row with ``lines_read``.
    """
    cutoff = total_lines.select(F.floor(F.col("lines_read") / 2)).scalar()
    joined = spans.withColumn("cutoff", cutoff)
    side = (
        F.when(F.col("last_line") <= F.col("cutoff"), "train")
        .when(F.col("first_line") > F.col("cutoff"), "test")
        .otherwise("excluded")
    )
    return joined.withColumn("side", side)


def line_roles(lines: DataFrame, split: DataFrame, line_key: str = "position") -> DataFrame:
    """(line, role, mixed): "train" lines may be mined, "held_out" lines are matched only.

    ``lines`` has one row per (line, block); ``split`` (block_id, side) covers labelled blocks.
    """
    sides = lines.join(split.select("block_id", "side"), "block_id")
    grouped = sides.groupBy(line_key).agg(
        F.bool_or(F.col("side") == "test").alias("has_test"),
        F.bool_or(F.col("side") == "train").alias("has_train"),
    )
    role = F.when(F.col("has_test"), "held_out").when(F.col("has_train"), "train")
    return grouped.select(
        line_key, role.alias("role"), (F.col("has_test") & F.col("has_train")).alias("mixed")
    ).where("role is not null")


def holdout_coverage(roles: DataFrame) -> DataFrame:
    """One row of line counts; ``roles`` also carries ``matched``."""
    held = F.col("role") == "held_out"
    return roles.agg(
        F.count(F.when(F.col("role") == "train", 1)).alias("train_lines"),
        F.count(F.when(held, 1)).alias("held_out_lines"),
        F.count(F.when(held & F.col("matched"), 1)).alias("held_out_matched_lines"),
        F.count(F.when(held & ~F.col("matched"), 1)).alias("held_out_unmatched_lines"),
        F.count(F.when(F.col("mixed"), 1)).alias("mixed_split_lines"),
    )


def check_trainable(split: DataFrame, label: str = "label") -> DataFrame:
    """One row: may a model be fitted, and if not, why."""
    train = F.col("side") == "train"
    counts = split.agg(
        F.count("*").alias("rows"),
        F.countDistinct(label).alias("classes"),
        F.count(F.when(train, 1)).alias("train_rows"),
        F.countDistinct(F.when(train, F.col(label))).alias("train_classes"),
        F.count(F.when(F.col("side") == "test", 1)).alias("test_rows"),
    )
    reason = (
        F.when(F.col("rows") == 0, "no labelled blocks")
        .when(F.col("classes") < 2, "only one class")
        .when(F.col("train_classes") < 2, "train half lacks a class")
        .when(F.col("test_rows") == 0, "no test rows")
        .otherwise("ok")
    )
    return counts.withColumn("reason", reason).withColumn("trainable", F.col("reason") == "ok")


def vector_key(entries: Column) -> Column:
    """Canonical text of a sparse count vector."""
    kept = F.filter(F.map_entries(entries), lambda e: e["value"] != 0)
    return F.array_join(
        F.transform(F.array_sort(kept), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("long").cast("string"))),
        ",",
    )


def vector_overlap(df: DataFrame, vec: str = "vec", side: str = "side", y: str = "label") -> DataFrame:
    """Exact vectors that occur on both sides of a split, by label of the test rows."""
    test = F.col(side) == "test"
    grouped = df.groupBy(vec).agg(
        F.count(F.when(F.col(side) == "train", 1)).alias("tr"),
        F.count(F.when(test, 1)).alias("te"),
        F.count(F.when(test & (F.col(y) == 1), 1)).alias("te_pos"),
        F.count(F.when(test & (F.col(y) == 0), 1)).alias("te_neg"),
    )
    seen = F.col("tr") > 0

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(seen, F.col(name))), F.lit(0))

    return grouped.agg(
        F.count("*").alias("distinct_vectors"),
        F.count(F.when(seen, 1)).alias("train_distinct_vectors"),
        F.count(F.when(F.col("te") > 0, 1)).alias("test_distinct_vectors"),
        total("te").alias("test_rows_seen_in_train"),
        total("te_pos").alias("test_positive_seen_in_train"),
        total("te_neg").alias("test_negative_seen_in_train"),
    )


def table_digest(df: DataFrame, cols: list[str], buckets: int = 4096) -> DataFrame:
    """One row: order-independent identity of the rows' contents.

    Row digests are counted, each distinct (digest, count) is hashed and the hashes are summed as
    60-bit numbers inside buckets; only bucket sums meet in one row.
    """
    cells = [F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("{}")) for c in cols]
    # digests are shuffled as bytes, half as long as their hex form
    rows = df.select(F.unhex(F.sha2(F.concat_ws("\x1f", *cells), 256)).alias("h"))
    counted = rows.groupBy("h").agg(F.count("*").alias("n")).select(
        F.sha2(F.concat(F.lower(F.hex("h")), F.lit("*"), F.col("n").cast("string")), 256).alias("g"), "n"
    )
    number = F.conv(F.substring("g", 4, 15), 16, 10).cast("decimal(38,0)")
    summed = counted.groupBy(F.conv(F.substring("g", 1, 3), 16, 10).cast("int").alias("b")).agg(
        F.sum(number).alias("s"), F.sum("n").alias("rows")
    )
    parts = F.array_sort(F.collect_list(F.struct("b", "s")))
    text = F.array_join(
        F.transform(parts, lambda p: F.concat(p["b"].cast("string"), F.lit(":"), p["s"].cast("string"))), "|"
    )
    return summed.agg(F.sum("rows").alias("rows"), F.sha2(F.concat(F.sum("rows").cast("string"), F.lit("|"), text), 256).alias("digest"))


# --- live scoring ---------------------------------------------------------------------------------
BASIS = "partial block"  # what a live score rests on; it is not the published score of whole blocks
WEIGHT_UNITS = 10**9  # weights are summed as whole billionths, so the order of addition does not matter


def model_weights(vocab: DataFrame, coefficients: list[float]) -> DataFrame:
    """(column, weight) of a fitted linear model; its size must be the vocabulary's."""
    if vocab.count() != len(coefficients):
        raise ValueError(f"the model has {len(coefficients)} columns, the vocabulary has another number")
    rows = [(i, float(w)) for i, w in enumerate(coefficients)]
    return vocab.sparkSession.createDataFrame(rows, "column int, weight double")


def running_counts(
    touches: DataFrame, position: str = "position", place: str = "place", key: str = "block_id", width: int = 1 << 20
) -> DataFrame:
    """``touches`` of ``recency.tracked`` with ``lines``, the touches of the key since it was last taken up."""
    return running_sums(touches, position, {"lines": F.lit(1).cast("long")}, by=(key, "episode"), ties=(place,), width=width)


def idle_episodes(
    touches: DataFrame, idle_ms: int, ms: str = "ms", position: str = "position", key: str = "block_id", width: int = 1 << 20
) -> DataFrame:
    """Add ``episode``: how often the key had paused for more than ``idle_ms`` before this touch."""
    paused = F.coalesce(F.col(ms) - F.col("__last") > idle_ms, F.lit(False)).cast("long")
    last = carry_last(touches, position, {"__last": F.col(ms)}, by=(key,), width=width)
    return running_sums(last, position, {"episode": paused}, by=(key,), width=width).drop("__last")


def probability(margin: Column) -> Column:
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)), 4)


def partial_block_scores(
    lines: DataFrame, intercept: float, weights: DataFrame, position: str = "position", bucket: int = 1 << 20,
    by: tuple[str, ...] = ("block_id",),
) -> DataFrame:
    """Per (line, block) in arrival order: ``lines`` of the block so far and the probability of the partial block.

    ``lines`` needs block_id, position and ``column`` (null for a line without a known template); ``weights`` has one
    row (column, weight) per model column. A linear score of counts is the running sum of the lines' weights. With
    ``by`` of block_id and ``episode`` (``recency.tracked``) a block that was evicted starts anew.
    """
    units = F.round(F.col("weight") * WEIGHT_UNITS).cast("long")
    weighed = lines.join(weights.select("column", units.alias("__units")), "column", "left")
    sums = {"lines": F.lit(1).cast("long"), "__sum": F.coalesce("__units", F.lit(0).cast("long"))}
    summed = running_sums(weighed, position, sums, by=by, width=bucket)
    margin = F.lit(float(intercept)) + F.col("__sum") / F.lit(float(WEIGHT_UNITS))
    return summed.withColumn("probability", probability(margin)).drop("__units", "__sum")


def with_model_column(matched: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``column``, and the two ways it can be missing: ``unmatched`` and ``out_of_vocabulary``."""
    joined = matched.join(vocab, "template_id", "left")
    return joined.withColumns(
        {
            "unmatched": F.col("template_id").isNull(),
            "out_of_vocabulary": F.col("template_id").isNotNull() & F.col("column").isNull(),
        }
    )


def scorer_drift(lines: DataFrame, tracked: int) -> DataFrame:
    """One row of drift counters from line rows (blocks, unmatched, out_of_vocabulary)."""
    has = F.size("blocks") > 0
    base = lines.agg(
        F.count("*").alias("lines_seen"),
        F.count(F.when(has & F.col("unmatched"), 1)).alias("unmatched_lines"),
        F.count(F.when(has & F.col("out_of_vocabulary"), 1)).alias("out_of_vocabulary_lines"),
    )
    blocks = lines.select(F.explode("blocks").alias("b")).distinct().agg(F.count("*").alias("distinct_blocks"))
    joined = base.withColumn("distinct_blocks", blocks.scalar())
    return joined.withColumns(
        {
            "blocks_tracked": F.least(F.col("distinct_blocks"), F.lit(tracked)),
            "blocks_beyond_limit": F.greatest(F.col("distinct_blocks") - tracked, F.lit(0)),
        }
    ).drop("distinct_blocks")


def block_recency_topk(lines: DataFrame, k: int, position: str = "position") -> DataFrame:
    """The ``k`` most recently touched blocks; the bound is the operator's purpose."""
    last = lines.groupBy("block_id").agg(F.max(position).alias("last_line"))
    return last.orderBy(F.desc("last_line"), "block_id").limit(k)


def probability_spread(verdicts: DataFrame, last_n: int, seq: list[Column]) -> DataFrame:
    """min / median / max over the last ``last_n`` verdicts."""
    recent = verdicts.orderBy(*seq).limit(last_n)
    return recent.agg(
        F.count("*").alias("samples"),
        F.min("probability").alias("min_probability"),
        F.round(F.median("probability"), 4).alias("median_probability"),
        F.max("probability").alias("max_probability"),
    )


# --- isolation forest -----------------------------------------------------------------------------
def _path_norm(n: float) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, depth: int, limit: int, rng, nodes: list) -> int:
    at = len(nodes)
    nodes.append(None)
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else []
    if depth >= limit or len(spread) == 0:
        nodes[at] = [-1, 0.0, -1, -1, depth + _path_norm(len(x))]
        return at
    f = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] <= cut
    a = _grow(x[left], depth + 1, limit, rng, nodes)
    b = _grow(x[~left], depth + 1, limit, rng, nodes)
    nodes[at] = [f, cut, a, b, 0.0]
    return at


def _build_tree(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        tree = int(pdf["tree"].iloc[0])
        x = np.stack([np.asarray(v, dtype=float) for v in pdf["features"]])
        nodes: list = []
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        _grow(x, 0, limit, np.random.default_rng([seed, tree]), nodes)
        return pd.DataFrame({"tree": [tree], "size": [len(x)], "nodes": [[[float(v) for v in n] for n in nodes]]})

    return run


def fit_isolation(df: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42, key: str = "block_id") -> DataFrame:
    """A forest (tree, size, nodes): one sub-sample of ``sample`` rows per tree, grown in parallel.

    Sampling is part of the algorithm: at every size, every tree draws the ``sample`` rows of the smallest seeded hash
    among all rows. Only rows whose hash lies under a bound, some four times the share that is drawn, are dealt out at all; the
    bound rises until every tree has its rows. Keys must be unique; the vectors are joined to the draws.
    """
    rows = df.select(F.col(key).cast("string").alias("k"), "features")
    total, share = rows.count(), 4.0
    low, span = -(1 << 63), 1 << 64
    while True:
        bound = min(low + int(span * min(1.0, share * sample / max(total, 1))), (1 << 63) - 1)
        drawn = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(seed), t, F.col("k")).alias("h")))
        dealt = rows.select("k", F.explode(F.filter(drawn, lambda x: x.h <= F.lit(bound))).alias("x")).select("k", "x.*")
        w = Window.partitionBy("tree").orderBy("h", "k")
        taken = cut_lineage(dealt.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= sample))
        if share * sample >= total or taken.count() == trees * min(sample, total):
            break
        share *= 4
    taken = taken.join(rows, "k")
    return (
        taken.select("tree", "rank", vector_to_array("features").alias("features"))
        .groupBy("tree")
        .applyInPandas(_build_tree(seed), "tree int, size int, nodes array<array<double>>")
    )


def score_isolation(df: DataFrame, forest: DataFrame, features: str = "features") -> DataFrame:
    """Add ``isolation_score`` and ``isolation_anomaly`` (score > 0.5).

    The forest is at most trees x 2 x sample nodes, a size fixed by its parameters, so it is shipped
    to the executors as a broadcast variable.
    """
    fitted = [(np.asarray(r["nodes"], dtype=float), r["size"]) for r in forest.collect()]
    shared = df.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, dtype=float) for v in vectors]) if len(vectors) else np.zeros((0, 1))
        total = np.zeros(len(x))
        for nodes, _ in shared.value:
            at = np.zeros(len(x), dtype=int)
            while True:
                inner = nodes[at, 0] >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                f = nodes[at[rows], 0].astype(int)
                go_left = x[rows, f] <= nodes[at[rows], 1]
                at[rows] = np.where(go_left, nodes[at[rows], 2], nodes[at[rows], 3]).astype(int)
            total += nodes[at, 4]
        norm = _path_norm(float(np.mean([size for _, size in shared.value])))
        return pd.Series(np.power(2.0, -total / len(shared.value) / max(norm, 1e-9)))

    return df.withColumn("isolation_score", score(vector_to_array(features))).withColumn(
        "isolation_anomaly", F.col("isolation_score") > 0.5
    )


