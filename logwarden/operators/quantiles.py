"""Exact order statistics of columns of any size: sketches narrow a bracket, the bracket's rows decide.

A mergeable sketch gives two values between which a rank must lie, up to its known error. Counting checks that it does; then
only the rows between the two count, a small share of what was there. Once a bracket holds few rows they are
sorted. No task ever holds a column's values, distinct or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ACCURACY = 10_000  # of the sketch: its rank error is rows / ACCURACY
FEW = 1 << 16  # rows that are sorted together


def order_statistics(values: DataFrame, ranks: dict[str, list[int]], few: int = FEW, accuracy: int = ACCURACY) -> dict[str, list[float]]:
    """Per name the values of 0-based ``ranks`` among its rows; ``values`` has (f, v), v a double without nulls or NaN.

    ``values`` should be written already: every pass reads it, all names and ranks at a time. Names and ranks are few.
    """
    open_ = {(f, k): (None, None, 0, None) for f, ks in ranks.items() for k in ks}  # bracket, rows below it, rows in it
    found: dict[tuple[str, int], float] = {}
    while open_:
        cuts = []
        for i, ((f, k), (low, high, below, inside)) in enumerate(open_.items()):
            here = _between(f, low, high)
            if inside is not None:
                at, error = (k - below) / inside, 2 / accuracy
                shares = [max(0.0, at - error), min(1.0, at + error)]
                cuts.append(F.percentile_approx(F.when(here, F.col("v")), shares, accuracy).alias(f"q{i}"))
        drawn = values.agg(*cuts).first() if cuts else None
        trial = {key: (b if b[3] is None else tuple(drawn[f"q{i}"])) for i, (key, b) in enumerate(open_.items())}
        counts = []
        for i, (key, (low, high, *_)) in enumerate(trial.items()):
            mine, v, here = F.col("f") == key[0], F.col("v"), _between(key[0], low, high)
            counts += [F.count_if(mine & (v < low) if low is not None else F.lit(False)).alias(f"b{i}"), F.count_if(here).alias(f"n{i}")]
            if low is not None:  # ties at the two ends, and the bracket between them
                counts += [F.count_if(here & (v == low)).alias(f"l{i}"), F.count_if(here & (v == high)).alias(f"h{i}")]
                counts += [F.min(F.when(here & (v > low), v)).alias(f"lo{i}"), F.max(F.when(here & (v < high), v)).alias(f"hi{i}")]
        counted = values.agg(*counts).first()
        small = []
        for i, (key, (low, high, *_)) in enumerate(trial.items()):
            below, inside = counted[f"b{i}"], counted[f"n{i}"]
            old = open_[key]
            if not below <= key[1] < below + inside:  # the sketch missed: keep the side on which the rank is
                low, high = (old[0], low) if key[1] < below else (high, old[1])
                open_[key] = (low, high, old[2] if key[1] < below else below, None)
                continue
            if low is not None:
                if key[1] < below + counted[f"l{i}"]:
                    found[key] = low
                    continue
                if key[1] >= below + inside - counted[f"h{i}"]:
                    found[key] = high
                    continue
                low, high, below = counted[f"lo{i}"], counted[f"hi{i}"], below + counted[f"l{i}"]
                inside -= counted[f"l{i}"] + counted[f"h{i}"]
            if inside <= few:
                small.append((key, low, high, below))
            else:
                open_[key] = (low, high, below, inside)
        if small:
            found |= _sorted(values, small)
        open_ = {key: b for key, b in open_.items() if key not in found}
    return {f: [found[f, k] for k in ks] for f, ks in ranks.items()}


def _between(f: str, low: float | None, high: float | None) -> Column:
    here = F.col("f") == f
    if low is not None:
        here = here & (F.col("v") >= low)
    return here if high is None else here & (F.col("v") <= high)


def _sorted(values: DataFrame, small: list[tuple]) -> dict[tuple[str, int], float]:
    """The ranks of brackets of few rows each, all in one pass."""
    tags = F.array_compact(F.array(*[F.when(_between(key[0], low, high), i) for i, (key, low, high, _) in enumerate(small)]))
    rows = values.select(F.explode(tags).alias("tag"), "v")
    placed = rows.withColumn("r", F.row_number().over(Window.partitionBy("tag").orderBy("v")) - 1)
    wanted = F.lit(False)
    for i, (key, _, _, below) in enumerate(small):
        wanted = wanted | ((F.col("tag") == i) & (F.col("r") == key[1] - below))
    return {small[r.tag][0]: r.v for r in placed.where(wanted).collect()}  # one row per rank


def medians(df: DataFrame, columns: dict[str, Column], few: int = FEW) -> tuple[dict[str, float | None], dict[str, int]]:
    """Exact medians (the mean of the two middle values) of the non-null values of each column, and their number."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), c.cast("double").alias("v")) for f, c in columns.items()])).alias("p")
    values = cut_lineage(df.select(pairs).select("p.f", "p.v").where("v IS NOT NULL AND NOT isnan(v)"))
    counts = {f: 0 for f in columns} | {r.f: r.n for r in values.groupBy("f").agg(F.count("*").alias("n")).collect()}
    ranks = {f: sorted({(n - 1) // 2, n // 2}) for f, n in counts.items() if n}
    found = order_statistics(values, ranks, few)
    return {f: (found[f][0] + found[f][-1]) / 2 if f in found else None for f in columns}, counts
