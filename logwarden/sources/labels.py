"""Label files: block labels (CSV) and line labels (JSON lines)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def anomaly_flag(label: Column) -> Column:
    return F.when(F.lower(F.trim(label)) == "anomaly", 1).otherwise(0)


def load_block_labels(spark: SparkSession, path: str) -> DataFrame:
    """``BlockId,Label`` CSV to (block_id, label)."""
    rows = spark.read.csv(path, header=True, schema="BlockId string, Label string")
    return rows.select(F.col("BlockId").alias("block_id"), anomaly_flag(F.col("Label")).alias("label"))


def load_structured_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth CSV with quoted multi-line content to (content, event_id)."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.select(F.col("Content").alias("content"), F.col("EventId").alias("event_id"))


def parse_line_labels(records: DataFrame, col: str = "value") -> DataFrame:
    """JSON records to (line, line_is_int, labels, labels_ok, rules, rules_ok); malformed JSON gives nulls."""
    text = F.col(col)
    is_object = text.rlike(r"^\s*\{") & F.try_parse_json(text).isNotNull()
    # The raw token tells 3 from true, "3" and 3.0, which a typed read would coerce.
    variant = F.try_parse_json(text)
    line = F.try_variant_get(variant, "$.line", "long")
    line_type = F.schema_of_variant(F.try_variant_get(variant, "$.line", "variant"))
    labels = F.try_variant_get(variant, "$.labels", "array<string>")
    labels_type = F.schema_of_variant(F.try_variant_get(variant, "$.labels", "variant"))
    rules = F.try_variant_get(variant, "$.rules", "map<string,array<string>>")
    rules_type = F.schema_of_variant(F.try_variant_get(variant, "$.rules", "variant"))
    lists = F.map_values(F.try_variant_get(variant, "$.rules", "map<string,variant>"))
    return records.select(
        text.alias("record"),
        F.coalesce(is_object, F.lit(False)).alias("is_object"),
        line.alias("line"),
        F.coalesce(line_type == "BIGINT", F.lit(False)).alias("line_is_int"),
        labels.alias("labels"),
        F.coalesce(
            (labels_type == "ARRAY<STRING>") & (F.size(labels) > 0)
            & ~F.exists(labels, lambda x: x.isNull() | (x == "")),
            F.lit(False),
        ).alias("labels_ok"),
        rules.alias("rules"),
        # Absent, or an object of lists (empty ones too) of non-empty strings.
        F.coalesce(
            F.forall(lists, lambda x: F.schema_of_variant(x).isin("ARRAY<STRING>", "ARRAY<VOID>"))
            & ~F.exists(F.flatten(F.map_values(rules)), lambda x: x.isNull() | (x == "")),
            rules_type.isNull(),
        ).alias("rules_ok"),
    )


def validate_line_labels(parsed: DataFrame, n_lines: int) -> tuple[DataFrame, DataFrame]:
    """(labels, violations): an integer line in 1..n, unique, with a non-empty list of labels and sound rules."""
    repeats = (
        parsed.where("line_is_int").groupBy("line").count().where("count > 1")
        .select("line", F.lit(True).alias("repeated"))
    )
    checked = parsed.join(repeats, "line", "left").withColumn(
        "violation",
        F.when(~F.col("is_object"), "invalid_json")
        .when(~F.col("line_is_int"), "line_not_integer")
        .when(~F.col("line").between(1, n_lines), "line_out_of_range")
        .when(F.coalesce("repeated", F.lit(False)), "line_repeated")
        .when(~F.col("labels_ok"), "labels_invalid")
        .when(~F.col("rules_ok"), "rules_invalid"),
    )
    labels = checked.where("violation is null").select("line", "labels", "rules")
    violations = checked.where("violation is not null").select("record", "line", "violation")
    return labels, violations


def load_line_labels(spark: SparkSession, path: str, n_lines: int) -> tuple[DataFrame, DataFrame]:
    return validate_line_labels(parse_line_labels(spark.read.text(path)), n_lines)
