"""Queries of this folder and their SQL, filled by the operator modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "packing", "pii", "decontaminate", "token_counts", "jaccard_join", "quality", "url_filter", "line_dedup",
    "chat_format", "top_k", "suffix_dedup", "prefix_trie", "repair",
)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in MODULES:
        import_module(f"{__package__}.{module}")
    return QUERIES, ORACLES
