"""Text lines with their line numbers, as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan_lines(
    spark: SparkSession,
    path: str | list[str],
    limit: int | None = None,
    stream: bool = False,
    files_per_trigger: int = 64,
) -> DataFrame:
    """Lines of text files as ``value``; batches also carry ``file_path``, ``line_no``, ``position``.

    ``line_no`` counts from 1 inside a file, ``position`` from 1 over all files in path order. A
    file may be read in many splits: the split table (one row per split) holds each split's first
    row id and line offset, so no pass brings lines together in one task.
    """
    if stream:
        return (
            spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
            .text(path)
            .select("value", F.col("_metadata.file_path").alias("file_path"))
        )
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    splits = lines.groupBy("file_path", "split_start").agg(
        F.min("row_id").alias("first_row_id"), F.count("*").alias("split_lines")
    )
    in_file = Window.partitionBy("file_path").orderBy("split_start")
    offsets = splits.withColumn(
        "line_offset", F.sum("split_lines").over(in_file) - F.col("split_lines")
    )
    files = splits.groupBy("file_path").agg(F.sum("split_lines").alias("file_lines"))
    # One row per file: small next to the lines, whatever their number.
    by_path = Window.orderBy("file_path")
    files = files.withColumn("file_offset", F.sum("file_lines").over(by_path) - F.col("file_lines"))
    offsets = offsets.join(files, "file_path").drop("split_lines", "file_lines")
    numbered = lines.join(offsets, ["file_path", "split_start"]).select(
        "value",
        "file_path",
        (F.col("row_id") - F.col("first_row_id") + F.col("line_offset") + 1).alias("line_no"),
        (
            F.col("row_id") - F.col("first_row_id") + F.col("line_offset") + F.col("file_offset") + 1
        ).alias("position"),
    )
    if limit is not None:
        numbered = numbered.orderBy("position").limit(limit)
    return numbered
