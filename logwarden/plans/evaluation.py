"""Queries: classification, ranking, grouping, line labels and leakage metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from .catalog import query
from .testdata import ALERTS_SQL, EVENTS_SQL, actor_events, alerts, sql, table

# Truth: labels.quality. Prediction and score: rules on the document's length.
JUDGED_SQL = """
j AS (SELECT d.doc_id, d.lang, d.source, l.quality AS y, l.toxic AS y2, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS pred,
      d.n_chars // 50 AS score FROM documents d JOIN labels l USING (doc_id))"""
CELLS_SQL = """count(*) FILTER (WHERE pred = 1 AND y = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND y = 0) AS fp,
  count(*) FILTER (WHERE pred = 0 AND y = 1) AS fn, count(*) FILTER (WHERE pred = 0 AND y = 0) AS tn"""
RATIOS_SQL = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 4) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 4) AS f1,
  round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 4) AS false_positive_rate"""


def judged(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").alias("y"), F.col("toxic").alias("y2"),
        F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("pred"), F.floor(F.col("n_chars") / 50).cast("long").alias("score"),
    )


@query("confusion_metrics", f"WITH {JUDGED_SQL}, c AS (SELECT count(*) AS rows, {CELLS_SQL} FROM j) SELECT rows, tp, fp, fn, tn, {RATIOS_SQL} FROM c")
def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(judged(spark, sf), "y", "pred")


@query(
    "roc_auc",
    f"""WITH {JUDGED_SQL}, r AS (SELECT y, avg(k) OVER (PARTITION BY score) AS rk FROM (SELECT y, score, row_number() OVER (ORDER BY score) AS k FROM j))
        SELECT CAST(sum(y) AS BIGINT) AS positives, count(*) - CAST(sum(y) AS BIGINT) AS negatives,
          round((sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 4) AS roc_auc FROM r""",
)
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.roc_auc(judged(spark, sf), "y", "score")


@query(
    "scenario_confusion",
    f"""WITH {JUDGED_SQL}, s AS (SELECT *, 'length' AS detector FROM j UNION ALL SELECT doc_id, lang, source, y, y2, y2 AS pred, score, 'toxic' FROM j),
        c AS (SELECT detector, source AS scenario, count(*) AS rows, {CELLS_SQL} FROM s GROUP BY GROUPING SETS ((detector, source), (detector)))
        SELECT detector, scenario, rows, tp, fp, fn, tn, {RATIOS_SQL} FROM c""",
)
def scenario_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Two detectors, per scenario and over all of them."""
    rows = judged(spark, sf).select(
        F.col("source").alias("scenario"), "y",
        F.explode(F.array(
            F.struct(F.lit("length").alias("detector"), F.col("pred").alias("pred")),
            F.struct(F.lit("toxic").alias("detector"), F.col("y2").alias("pred")),
        )).alias("d"),
    ).select("scenario", "y", "d.detector", "d.pred")
    return metrics.confusion(rows, "y", "pred", by=("detector", "scenario"), rollup=True).where("detector is not null")


@query("detector_misses", f"WITH {JUDGED_SQL} SELECT doc_id, source FROM j WHERE y = 1 AND pred = 0")
def detector_misses(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.misses(judged(spark, sf), "y", "pred").select("doc_id", "source")


GROUPS_SQL = """
g AS (SELECT source AS truth, CASE WHEN source IN ('src0', 'src1') THEN 'a' WHEN source = 'src2' THEN 'b' || lang ELSE source END AS pred FROM documents),
p AS (SELECT truth, pred, count(*) AS n FROM g GROUP BY ALL),
acc AS (
  SELECT CAST(sum(n) AS BIGINT) AS lines,
    CAST(coalesce(sum(n) FILTER (WHERE n = (SELECT sum(n) FROM p q WHERE q.pred = p.pred) AND n = (SELECT sum(n) FROM p q WHERE q.truth = p.truth)), 0) AS BIGINT) AS correct_lines,
    count(DISTINCT pred) AS predicted_groups, count(DISTINCT truth) AS true_groups FROM p
)"""


def _grouped(spark: SparkSession, sf: str) -> DataFrame:
    source = F.col("source")
    pred = F.when(source.isin("src0", "src1"), "a").when(source == "src2", F.concat(F.lit("b"), "lang")).otherwise(source)
    return table(spark, sf, "documents").select(source.alias("truth"), pred.alias("pred"))


@query("grouping_accuracy", f"WITH {GROUPS_SQL} SELECT *, round(correct_lines / lines, 4) AS grouping_accuracy FROM acc")
def grouping_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.grouping_accuracy(_grouped(spark, sf), "pred", "truth")


@query(
    "grouping_gate",
    f"""WITH {GROUPS_SQL} SELECT name, correct_lines / lines >= floor AND predicted_groups <= cap AS passes
        FROM acc, (VALUES ('HDFS', 0.98, 40), ('OpenSSH', 0.65, 60), ('loose', 0.1, 60)) AS f(name, floor, cap)""",
)
def grouping_gate(spark: SparkSession, sf: str) -> DataFrame:
    accuracy = metrics.grouping_accuracy(_grouped(spark, sf), "pred", "truth")
    gates = [
        metrics.grouping_gate(accuracy, floor, cap).select(F.lit(name).alias("name"), "passes")
        for name, (floor, cap) in {**metrics.floors(), "loose": (0.1, 60)}.items()
    ]
    return gates[0].unionByName(gates[1]).unionByName(gates[2])


# Line labels: scenario = user bucket, line = position in it; labels come in bursts of lines.
LINES_SQL = ALERTS_SQL + """,
fl AS (
  SELECT 's' || (user_id % 4) AS scenario, row_number() OVER (PARTITION BY user_id % 4 ORDER BY id) AS line, id, event FROM ev
),
f AS (SELECT *, line % 97 < 5 OR line % 53 = 0 AS labelled, id IN (SELECT event_id FROM alerts) AS alerted FROM fl)"""
LINE_RATIOS_SQL = RATIOS_SQL


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.ordering import with_ordinal

    events = actor_events(spark, sf).select(
        "id", "event", F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("scenario")
    )
    lines = with_ordinal(events, "id", "line", by=("scenario",))
    labels = lines.where((F.col("line") % 97 < 5) | (F.col("line") % 53 == 0)).select("scenario", "line")
    hits = lines.join(alerts(spark, sf).select(F.col("event_id").alias("id")), "id", "left_semi")
    return metrics.line_flags(lines, labels, hits, ["scenario", "line"])


@query(
    "line_confusion",
    sql(
        LINES_SQL + """,
c AS (SELECT scenario, count(*) AS rows, count(*) FILTER (WHERE labelled AND alerted) AS tp, count(*) FILTER (WHERE NOT labelled AND alerted) AS fp,
  count(*) FILTER (WHERE labelled AND NOT alerted) AS fn, count(*) FILTER (WHERE NOT labelled AND NOT alerted) AS tn FROM f GROUP BY ROLLUP (scenario))""",
        f"SELECT scenario, rows, tp, fp, fn, tn, {LINE_RATIOS_SQL} FROM c",
    ),
)
def line_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.line_confusion(flagged(spark, sf), by=("scenario",), rollup=True)


RUNS_SQL = LINES_SQL + """,
runs AS (
  SELECT scenario, min(line) AS start_line, max(line) AS end_line, count(*) FILTER (WHERE alerted) AS alert_lines,
    count(*) FILTER (WHERE alerted) > 0 AS hit
  FROM (SELECT *, line - row_number() OVER (PARTITION BY scenario ORDER BY line) AS grp FROM f WHERE labelled) GROUP BY scenario, grp
)"""


@query("labeled_runs", sql(RUNS_SQL, "SELECT * FROM runs"))
def labeled_runs(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.labeled_runs(flagged(spark, sf), by=("scenario",))


@query(
    "scenario_rollup",
    sql(
        RUNS_SQL,
        """SELECT a.*, coalesce(r.runs, 0) AS runs, coalesce(r.run_hits, 0) AS run_hits FROM (
             SELECT scenario, count(*) AS parsed_lines, count(*) FILTER (WHERE labelled) AS labelled_lines, count(*) FILTER (WHERE alerted) AS alerts,
               count(*) FILTER (WHERE labelled AND alerted) AS tp, count(*) FILTER (WHERE NOT labelled AND alerted) AS fp,
               count(*) FILTER (WHERE labelled AND NOT alerted) AS fn, count(*) FILTER (WHERE NOT labelled AND NOT alerted) AS tn
             FROM f GROUP BY ROLLUP (scenario)) a
           LEFT JOIN (SELECT scenario, count(*) AS runs, count(*) FILTER (WHERE hit) AS run_hits FROM runs GROUP BY ROLLUP (scenario)) r
             ON a.scenario IS NOT DISTINCT FROM r.scenario""",
    ),
)
def scenario_rollup(spark: SparkSession, sf: str) -> DataFrame:
    flags = flagged(spark, sf)
    return metrics.scenario_rollup(flags, metrics.labeled_runs(flags, by=("scenario",)))


@query(
    "event_type_counts",
    sql(
        LINES_SQL,
        """SELECT event, count(*) AS events, count(*) FILTER (WHERE labelled) AS labelled_events,
           count(*) FILTER (WHERE alerted) AS alert_events FROM f GROUP BY event""",
    ),
)
def event_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.event_type_counts(flagged(spark, sf))


@query(
    "rule_coverage",
    sql(
        ALERTS_SQL,
        """SELECT rule, count(*) AS labeled_lines, count(*) FILTER (WHERE id IN (SELECT event_id FROM alerts)) AS alerted_lines FROM (
             SELECT DISTINCT id, unnest(['r' || (user_id % 7), 'r' || (user_id % 3), 'all', 'r' || (user_id % 7)]) AS rule FROM ev) GROUP BY rule""",
    ),
)
def rule_coverage(spark: SparkSession, sf: str) -> DataFrame:
    events = actor_events(spark, sf)
    a = F.concat(F.lit("r"), (F.col("user_id") % 7).cast("string"))
    b = F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string"))
    rules = F.create_map(F.lit("x"), F.array(a, b, F.lit("all")), F.lit("y"), F.array(a))
    labels = events.select(F.col("id").alias("line"), rules.alias("rules"))
    return metrics.rule_coverage(labels, alerts(spark, sf).select(F.col("event_id").alias("line")))


@query(
    "split_leakage",
    sql(
        EVENTS_SQL,
        """SELECT identity, value, count(DISTINCT split) AS splits FROM (
             SELECT 'source' AS identity, source AS value, split FROM s UNION ALL SELECT 'ip', ip, split FROM s
             UNION ALL SELECT 'user', "user", split FROM s) GROUP BY identity, value HAVING count(DISTINCT split) > 1""",
    ).replace("\nSELECT identity", ", s AS (SELECT *, CASE WHEN user_id % 10 < 8 THEN 'train' WHEN user_id % 10 = 8 THEN 'test' ELSE 'validation' END AS split FROM ev)\nSELECT identity", 1),
)
def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    part = F.col("user_id") % 10
    split = F.when(part < 8, "train").when(part == 8, "test").otherwise("validation")
    return metrics.split_leakage(actor_events(spark, sf).withColumn("split", split), ["source", "ip", "user"])
