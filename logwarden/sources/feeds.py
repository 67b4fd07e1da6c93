"""Threat feeds: parsing, size floor, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import FEED_SPECS
from ..functions.net import cidr_bounds, ip_to_long, settled

SPEC_SCHEMA = (
    "position int, feed string, kind string, max_age_hours int, min_entries int, verdict string, "
    "score_hundredths int, citation string"
)


def feed_specs(spark: SparkSession, specs=FEED_SPECS) -> DataFrame:
    """The feed dimension: one row per feed."""
    return spark.createDataFrame(list(specs), SPEC_SCHEMA)


def _feed_lines(df: DataFrame, col: str) -> DataFrame:
    text = F.regexp_replace(F.col(col), r"(?U)^\s+|\s+\z", "")
    trimmed = settled(df, col, text)
    return trimmed.where((F.col(col) != "") & ~F.col(col).startswith("#"))


def parse_exact(df: DataFrame, col: str = "value") -> DataFrame:
    """Bare IPv4 per line to ``ip_int``; comments and anything else are skipped."""
    rows = settled(_feed_lines(df, col), "ip_int", ip_to_long(F.col(col)))
    return rows.where("ip_int is not null").drop(col)


def parse_cidr(df: DataFrame, col: str = "value") -> DataFrame:
    """CIDR or bare IPv4 per line to inclusive ``lo``/``hi``; comments and anything else skipped."""
    rows = settled(_feed_lines(df, col), "bounds", cidr_bounds(F.col(col)))
    keep = [c for c in df.columns if c != col]
    return rows.where("bounds is not null").select(*keep, "bounds.lo", "bounds.hi")


FEED_PARSERS = {"exact": parse_exact, "cidr": parse_cidr}


def load_feed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return FEED_PARSERS[kind](spark.read.text(path))


def feed_floor(entry_counts: DataFrame, specs: DataFrame) -> DataFrame:
    """Entry counts against each feed's floor; a feed without entries counts as 0."""
    joined = specs.join(entry_counts, "feed", "left")
    entries = F.coalesce(F.col("entries"), F.lit(0)).cast("long")
    return joined.withColumn("entries", entries).withColumn(
        "accepted", F.col("entries") >= F.col("min_entries")
    )


def age_hours(fetched_at: Column, as_of: Column) -> Column:
    """Hours since an ISO time; null when it cannot be read."""
    stamp = F.try_to_timestamp(fetched_at)
    return (F.unix_millis(as_of) - F.unix_millis(stamp)) / F.lit(3600000.0)


def feed_status(floors: DataFrame, provenance: DataFrame, as_of: Column) -> DataFrame:
    """fresh / stale / missing per feed, computed for the moment of reading.

    ``floors`` comes from :func:`feed_floor`; ``provenance`` has (feed, fetched_at).
    """
    df = floors.join(provenance, "feed", "left").withColumn(
        "age_hours", F.when(F.col("accepted"), age_hours(F.col("fetched_at"), as_of))
    )
    state = (
        F.when(~F.col("accepted"), "missing")
        .when(F.col("age_hours").isNull(), "fresh")
        .when(F.col("age_hours") > F.col("max_age_hours"), "stale")
        .otherwise("fresh")
    )
    return df.withColumn("state", state)
