"""Corpus pipeline over ``documents``: every stage calls one operator of ``logwarden.llm``.

A stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents`` and work on whatever their
predecessor kept. ``run`` writes each stage's rows to the shared folder and reads them back as the next stage's input.
Null or empty texts pass through as described by the operators; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from logwarden.llm.store import stored
from logwarden.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, does not reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated three-line windows and repeated lines of 50 words; a document left with no text at all is a whole copy and goes."""
    cut = line_dedup.dedup_lines(docs)
    kept = cut.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of every group that links of similarity 0.8 join.

    Rows are told apart by doc_id and text: of one doc_id with several texts only those go whose group keeps another row
    (of two in one group that of the smaller text hash stays). Of rows equal in both one stays, whichever it is. Rows
    with a null doc_id all stay.
    """
    rows = jaccard_join.similar_rows(docs).where("key IS NOT NULL")
    texts = stored(rows.groupBy("key", "hash").agg(F.count("*").alias("copies"), F.min("root").alias("root")), "rows")
    best = texts.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("key", "hash")).alias("best"))
    beaten = texts.join(best, "root").where(F.struct("key", "hash") != F.col("best")).select("key", "hash")
    several = texts.where("copies > 1").select("key", "hash").join(beaten, ["key", "hash"], "left_anti")
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    own = lambda other: (F.col("doc_id") == other["key"]) & (F.col("_hash") == other["hash"])
    out = beaten.unionByName(texts.where("copies > 1").select("key", "hash")).distinct()
    kept = hashed.join(out, own(out), "left_anti").select(*docs.columns)
    several = stored(several, "several")
    if several.isEmpty():
        return kept
    again = hashed.join(several, own(several), "left_semi").dropDuplicates(["doc_id", "_hash"])
    return kept.unionByName(again.select(*docs.columns))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with the digest of their token ids."""
    return packing.digests(packing.pack(docs, packing.default_tokenizer()))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("packing", packing_stage),
]

# A fitted classifier is part of the pipeline, so SQL cannot express it; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
