"""Evaluation: confusion, ranking, grouping, line labels, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import GROUPING_FLOORS
from .ordering import islands


def _ratio(num: Column, den: Column, undefined: str) -> Column:
    value = F.when(den > 0, num / den)
    return F.coalesce(value, F.lit(0.0)) if undefined == "zero" else value


def with_ratios(cells: DataFrame, undefined: str = "null", digits: int | None = 4) -> DataFrame:
    """Add precision, recall, f1 and false_positive_rate to tp/fp/fn/tn counts.

    ``undefined`` says what a ratio without a denominator is: null, or zero.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    measures = {
        "precision": _ratio(tp, tp + fp, undefined),
        "recall": _ratio(tp, tp + fn, undefined),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn, undefined),
        "false_positive_rate": _ratio(fp, fp + tn, undefined),
    }
    if digits is not None:
        measures = {n: F.round(c, digits) for n, c in measures.items()}
    return cells.withColumns(measures)


def confusion_cells(y: Column, pred: Column) -> list[Column]:
    """The four counts; null where there are rows and not one known label."""
    actual, hit = F.coalesce(y.cast("int") == 1, F.lit(False)), F.coalesce(pred.cast("int") == 1, F.lit(False))
    known = (F.count(y) > 0) | (F.count("*") == 0)
    cells = {"tp": hit & actual, "fp": hit & ~actual, "fn": ~hit & actual, "tn": ~hit & ~actual}
    return [F.when(known, F.count(F.when(test, 1))).alias(name) for name, test in cells.items()]


def confusion(
    df: DataFrame, y: str, pred: str, by: tuple[str, ...] = (), undefined: str = "null",
    digits: int | None = 4, rollup: bool = False,
) -> DataFrame:
    """Confusion counts and ratios, per ``by``; ``rollup`` adds the totals row (keys null)."""
    grouped = df.rollup(*by) if rollup else df.groupBy(*by)
    return with_ratios(grouped.agg(F.count("*").alias("rows"), *confusion_cells(F.col(y), F.col(pred))), undefined, digits)


def misses(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.where((F.col(y).cast("int") == 1) & (F.col(pred).cast("int") == 0))


def roc_auc(df: DataFrame, y: str, score: str, bins: int = 256) -> DataFrame:
    """Exact ROC-AUC by rank sums with half-counted ties; null when a class is missing.

    Rows are reduced to distinct scores. Negatives below a score are counted in two steps, inside
    equal-depth score bins and over the bins, so that many distinct scores stay distributed.
    """
    from pyspark.sql import Window

    counts = df.groupBy(F.col(score).alias("s")).agg(
        F.count(F.when(F.col(y) == 1, 1)).alias("pos"), F.count(F.when(F.col(y) == 0, 1)).alias("neg")
    )
    cuts = counts.agg(
        F.percentile_approx("s", [i / bins for i in range(1, bins)], 1000).alias("cuts")
    )
    binned = counts.withColumn("cuts", cuts.scalar()).select(
        "s", "pos", "neg", F.size(F.filter("cuts", lambda c: c <= F.col("s"))).alias("bin")
    )
    totals = binned.groupBy("bin").agg(F.sum("neg").alias("bin_neg"))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("bin", F.coalesce(F.sum("bin_neg").over(before), F.lit(0)).alias("below_bin"))
    inside = Window.partitionBy("bin").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = binned.join(offsets, "bin").withColumn(
        "below", F.col("below_bin") + F.coalesce(F.sum("neg").over(inside), F.lit(0))
    )
    # Twice the rank sum stays an integer, so the result does not depend on the order of addition.
    return ranked.agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum((F.col("pos") * (2 * F.col("below") + F.col("neg"))).cast("decimal(38,0)")).alias("twice"),
    ).select(
        "positives",
        "negatives",
        F.when(
            (F.col("positives") > 0) & (F.col("negatives") > 0),
            F.round(
                F.col("twice").cast("double")
                / (F.lit(2.0) * F.col("positives").cast("double") * F.col("negatives").cast("double")),
                4,
            ),
        ).alias("roc_auc"),
    )


def grouping_counts(df: DataFrame, pred: str, true: str) -> DataFrame:
    """(pred, true, lines, exact): pairs whose predicted group equals its true group."""
    pairs = df.groupBy(F.col(pred).alias("pred"), F.col(true).alias("true")).agg(F.count("*").alias("lines"))
    by_pred = pairs.groupBy("pred").agg(F.sum("lines").alias("pred_lines"))
    by_true = pairs.groupBy("true").agg(F.sum("lines").alias("true_lines"))
    joined = pairs.join(by_pred, "pred").join(by_true, "true")
    return joined.withColumn(
        "exact", (F.col("lines") == F.col("pred_lines")) & (F.col("lines") == F.col("true_lines"))
    )


def grouping_accuracy(df: DataFrame, pred: str, true: str) -> DataFrame:
    return grouping_counts(df, pred, true).agg(
        F.sum("lines").alias("lines"),
        F.coalesce(F.sum(F.when(F.col("exact"), F.col("lines"))), F.lit(0)).alias("correct_lines"),
        F.countDistinct("pred").alias("predicted_groups"),
        F.countDistinct("true").alias("true_groups"),
    ).withColumn("grouping_accuracy", F.round(F.col("correct_lines") / F.col("lines"), 4))


def grouping_gate(accuracy: DataFrame, floor: float, max_templates: int) -> DataFrame:
    return accuracy.withColumn(
        "passes", (F.col("grouping_accuracy") >= floor) & (F.col("predicted_groups") <= max_templates)
    )


def floors() -> dict[str, tuple[float, int]]:
    return dict(GROUPING_FLOORS)


# --- line labels ----------------------------------------------------------------------------------
def unparsed_labels(lines: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """Labels of lines that the table lacks, with the violation ``line_not_parsed``."""
    return labels.join(lines.select(*key), key, "left_anti").withColumn("violation", F.lit("line_not_parsed"))


def line_flags(lines: DataFrame, labels: DataFrame | None, alerts: DataFrame, key: list[str]) -> DataFrame:
    """Lines with ``labelled`` and ``alerted``.

    A label on a line that the table lacks is an error, raised when the result is read: it would otherwise
    vanish from the misses. Without a label table ``labelled`` is null and confusion cells are undefined.
    """
    b = alerts.select(*key).distinct().withColumn("alerted", F.lit(True))
    if labels is None:
        joined = lines.withColumn("labelled", F.lit(None).cast("boolean")).join(b, key, "left")
        return joined.withColumn("alerted", F.coalesce("alerted", F.lit(False)))
    a = labels.select(*key).distinct().withColumn("labelled", F.lit(True))
    met = lines.withColumn("__parsed", F.lit(True)).join(a, key, "full")
    place = F.concat_ws(" ", *[F.col(k).cast("string") for k in key])
    checked = F.when(F.col("__parsed").isNull(), F.raise_error(F.concat(F.lit("label on an unparsed line: "), place)).cast("boolean"))
    joined = met.withColumn("labelled", checked.otherwise(F.coalesce("labelled", F.lit(False)))).drop("__parsed").join(b, key, "left")
    return joined.withColumn("alerted", F.coalesce("alerted", F.lit(False)))


def line_confusion(flags: DataFrame, by: tuple[str, ...] = (), rollup: bool = False) -> DataFrame:
    return confusion(flags, "labelled", "alerted", by=by, rollup=rollup)


def labeled_runs(flags: DataFrame, pos: str = "line", by: tuple[str, ...] = ()) -> DataFrame:
    """Runs of consecutive labelled lines and how many alerted lines each holds."""
    runs = islands(flags.where("labelled"), pos, by=by)
    return runs.groupBy(*by, "run").agg(
        F.min(pos).alias("start_line"),
        F.max(pos).alias("end_line"),
        F.count(F.when(F.col("alerted"), 1)).alias("alert_lines"),
    ).drop("run").withColumn("hit", F.col("alert_lines") > 0)


def rule_coverage(labels: DataFrame, alerts: DataFrame, key: str = "line") -> DataFrame:
    """Per publisher rule: labelled lines and alerted lines; a rule counts once per line.

    ``labels.rules`` maps a name to rule lists.
    """
    rules = labels.select(key, F.explode(F.array_distinct(F.flatten(F.map_values("rules")))).alias("rule"))
    flagged = rules.join(alerts.select(key).distinct().withColumn("alerted", F.lit(True)), key, "left")
    return flagged.groupBy("rule").agg(
        F.count("*").alias("labeled_lines"), F.count(F.when(F.col("alerted"), 1)).alias("alerted_lines")
    )


def event_type_counts(flags: DataFrame, event: str = "event") -> DataFrame:
    return flags.groupBy(event).agg(
        F.count("*").alias("events"),
        F.count(F.when(F.col("labelled"), 1)).alias("labelled_events"),
        F.count(F.when(F.col("alerted"), 1)).alias("alert_events"),
    )


def scenario_rollup(flags: DataFrame, runs: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Per scenario and in total (scenario null): lines, labels, alerts, cells, runs, run hits."""
    cells = flags.rollup(scenario).agg(
        F.count("*").alias("parsed_lines"),
        F.count(F.when(F.col("labelled"), 1)).alias("labelled_lines"),
        F.count(F.when(F.col("alerted"), 1)).alias("alerts"),
        *confusion_cells(F.col("labelled"), F.col("alerted")),
    )
    hits = runs.rollup(scenario).agg(F.count("*").alias("runs"), F.count(F.when(F.col("hit"), 1)).alias("run_hits"))
    joined = cells.join(hits.withColumnRenamed(scenario, "__s"), F.col(scenario).eqNullSafe(F.col("__s")), "left").drop("__s")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("runs", "run_hits")})


# --- splits and digests ------------------------------------------------------------------------------
def split_leakage(df: DataFrame, identities: list[str], split: str = "split") -> DataFrame:
    """(identity, value, splits): identity values that occur in more than one split."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(i).alias("identity"), F.col(i).cast("string").alias("value")) for i in identities])
    )
    seen = df.select(pairs.alias("p"), F.col(split).alias("split")).select("p.*", "split").distinct()
    return seen.groupBy("identity", "value").agg(F.count("*").alias("splits")).where("splits > 1")


def set_digest(df: DataFrame, col: str, leaf: int = 1 << 16) -> DataFrame:
    """One row: size and SHA-256 of the compact JSON list of the sorted distinct values.

    The digest is defined over one text, so this is for reported sets (alerted addresses), whose
    distinct values fit one row; ``table_digest`` is the form for whole tables.
    """
    distinct = df.select(F.col(col).cast("string").alias("v")).where("v is not null").distinct()
    return distinct.agg(
        F.count("*").alias("size"),
        F.sha2(F.to_json(F.array_sort(F.collect_list("v"))), 256).alias("digest"),
    )


# --- latency ----------------------------------------------------------------------------------------
def stage_percentiles(df: DataFrame, by: str, value: str, seq: str, last_n: int) -> DataFrame:
    """Nearest-rank p50 and p95 over each stage's last ``last_n`` samples; p95 needs 20 of them."""
    from .ordering import top_per_key

    recent = top_per_key(df.select(by, value, seq), [by], [F.desc(seq)], last_n)
    return recent.groupBy(by).agg(
        F.count("*").alias("samples"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}`)").alias("p50"),
        F.when(
            F.count("*") >= 20, F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{value}`)")
        ).alias("p95"),
    )


def event_rate(df: DataFrame, ts: str, as_of_ms: int, seconds: int) -> DataFrame:
    """Events per second over the span the window really covers; 0 below two events."""
    recent = df.where((F.col(ts) >= as_of_ms - seconds * 1000) & (F.col(ts) <= as_of_ms))
    span = F.greatest((F.lit(as_of_ms) - F.min(ts)) / F.lit(1000.0), F.lit(1e-6))
    return recent.agg(
        F.count("*").alias("events"),
        F.when(F.count("*") < 2, F.lit(0.0)).otherwise(F.round(F.count("*") / span, 3)).alias("per_second"),
    )
