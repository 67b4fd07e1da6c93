"""Address reputation: exact and CIDR feeds behind a scope check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net import canonical_ip, ip_scope, ip_to_long, settled
from .sweep import covered

EDGE_BITS = 24


def merge_ranges(df: DataFrame, lo: str = "lo", hi: str = "hi", keys: tuple[str, ...] = ()) -> DataFrame:
    """Disjoint ranges: overlapping and adjacent ones are merged, per key.

    Ranges are cut at /8 borders and merged inside each /8; only pieces touching a border (two per
    /8 at most) meet again in one window per key.
    """
    size = 1 << EDGE_BITS
    cut = df.select(*keys, F.col(lo).alias("lo"), F.col(hi).alias("hi")).withColumn(
        "bin", F.explode(F.sequence(F.shiftright("lo", EDGE_BITS), F.shiftright("hi", EDGE_BITS)))
    )
    cut = cut.withColumn("lo", F.greatest("lo", F.col("bin") * size)).withColumn(
        "hi", F.least("hi", F.col("bin") * size + size - 1)
    )
    pieces = _merge_sorted(cut.groupBy(*keys, "bin", "lo").agg(F.max("hi").alias("hi")), [*keys, "bin"])
    touches = (F.col("lo") % size == 0) | ((F.col("hi") + 1) % size == 0)
    edges = _merge_sorted(pieces.where(touches).drop("bin"), list(keys))
    return pieces.where(~touches).drop("bin").unionByName(edges)


def _merge_sorted(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = df.withColumn(
        "starts", F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0)
    )
    grouped = starts.withColumn("part", F.sum("starts").over(w))
    return grouped.groupBy(*keys, "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("part")


def exact_hits(addresses: DataFrame, exact: DataFrame) -> DataFrame:
    """(ip_int, feed) for addresses listed in an exact feed."""
    return addresses.join(exact.select("feed", "ip_int").distinct(), "ip_int").select("ip_int", "feed")


def range_hits(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ip_int, feed) for the distinct addresses inside a range; ranges may overlap.

    Addresses and ranges are swept together, once per feed (there are as many as the feed table has rows).
    """
    feeds = ranges.agg(F.collect_set("feed").alias("feeds")).scalar()
    points = addresses.select("ip_int").distinct().select(F.explode(feeds).alias("grp"), F.col("ip_int").alias("at"), F.lit(0).cast("long").alias("seq"))
    starts = ranges.select(F.col("feed").alias("grp"), F.col("lo").alias("at"), F.lit(0).cast("long").alias("seq"), F.col("hi").alias("end"))
    return covered(points, starts, inclusive=True).select(F.col("at").alias("ip_int"), F.col("grp").alias("feed"))


def classify_addresses(addresses: DataFrame, exact: DataFrame, ranges: DataFrame, status: DataFrame) -> DataFrame:
    """Verdict of each distinct address in ``ip``.

    ``exact`` (feed, ip_int) and disjoint ``ranges`` (feed, lo, hi) hold the entries; ``status`` is
    the feed dimension with its state (see ``feed_status``). One row per feed, so joins to it are
    tiny.
    """
    scoped = addresses.select("ip").distinct()
    scoped = settled(settled(scoped, "ip_int", ip_to_long(F.col("ip"))), "scope", ip_scope(F.col("ip_int")))
    is_v6 = F.col("ip_int").isNull() & canonical_ip(F.col("ip")).isNotNull()
    scoped = scoped.withColumn("is_v6", is_v6)
    routable = scoped.where(F.col("scope.scope") == "global").select("ip_int").distinct()
    live = status.where("state != 'missing'")
    when = F.coalesce(F.nullif(F.substring_index("fetched_at", "T", 1), F.lit("")), F.lit("unknown date"))
    stale = F.when(
        (F.col("state") == "stale") & F.col("age_hours").isNotNull(),
        F.concat(F.lit(", "), F.format_string("%.1fd stale", F.col("age_hours") / 24)),
    ).otherwise("")
    cited = live.select(
        "feed", "position", "verdict", "score_hundredths",
        F.concat("citation", F.lit(" (fetched "), when, stale, F.lit(")")).alias("cite"),
    )
    listed = exact_hits(routable, exact).unionByName(range_hits(routable, ranges)).distinct()
    # At most one row per feed and address from here on.
    verdicts = (
        listed.join(cited, "feed")
        .groupBy("ip_int")
        .agg(
            F.max_by(
                F.struct("verdict", "score_hundredths"),
                F.struct("score_hundredths", (-F.col("position")).alias("p")),
            ).alias("best"),
            F.array_sort(F.collect_list(F.struct("position", "feed", "cite"))).alias("hits"),
        )
    )
    names = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "citation"))), lambda s: s["citation"]),
        ", ",
    )
    summary = live.agg((F.count("*") > 0).alias("usable"), names.alias("names"))
    df = scoped.join(verdicts, "ip_int", "left").withColumn("feeds", summary.select(F.struct("*")).scalar())
    df = df.select("*", "feeds.usable", "feeds.names")
    hit = F.col("best").isNotNull()
    scope = F.col("scope.scope")
    inner = scope.isin("internal", "non_routable")
    verdict = (
        F.when(F.col("ip_int").isNull(), "unsupported")
        .when(inner, scope)
        .when(~F.col("usable"), "unavailable")
        .when(~hit, "unlisted")
        .otherwise(F.col("best.verdict"))
    )
    noun = F.when(scope == "internal", "Internal address").otherwise("Non-routable address")
    detail = (
        F.when(F.col("is_v6"), "Reputation not checked: IPv6 — neither feed publishes IPv6 entries")
        .when(F.col("ip_int").isNull(), "Reputation not checked: unparseable address")
        .when(inner, F.concat(noun, F.lit(" — "), F.col("scope.detail")))
        .when(~F.col("usable"), "Reputation unavailable — no threat feed loaded")
        .when(~hit, F.concat(F.lit("Not listed in "), F.col("names")))
        .otherwise(
            F.concat(F.lit("Listed in "), F.array_join(F.transform("hits", lambda h: h["cite"]), " + "))
        )
    )
    counted = (scope == "global") & F.col("usable")
    return df.select(
        "ip",
        verdict.alias("rep_verdict"),
        F.when(counted & hit, F.col("best.score_hundredths")).otherwise(0).alias("rep_hundredths"),
        F.when(counted & hit, F.transform("hits", lambda h: h["feed"]))
        .otherwise(F.array().cast("array<string>"))
        .alias("rep_sources"),
        F.coalesce(counted, F.lit(False)).alias("rep_checked"),
        detail.alias("rep_detail"),
    )


def classify_ips(df: DataFrame, exact: DataFrame, ranges: DataFrame, status: DataFrame, ip: str = "ip") -> DataFrame:
    """Attach the reputation columns to every row of ``df``.

    Each distinct address is classified once; the result is joined back on the address, where AQE
    splits a hot address because the verdict side has one row per address.
    """
    verdicts = classify_addresses(df.select(F.col(ip).alias("ip")), exact, ranges, status)
    return df.join(verdicts.withColumnRenamed("ip", "__ip"), F.col(ip) == F.col("__ip"), "left").drop("__ip")
