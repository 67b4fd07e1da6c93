"""Queries: feeds, scopes, address verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import SCOPE_RANGES
from ..functions.net import ip_scope, ip_to_long, long_to_ip
from ..operators import reputation as rep
from ..sources import feeds
from .catalog import query
from .testdata import ACTOR_BASE, ACTOR_STEP, ip_sql, mix, mix_sql, table

AS_OF = "2024-01-31T00:00:00Z"
FETCHED = {"tor_exits": "2024-01-29T06:00:00Z", "firehol_level1": "2024-01-30T00:00:00Z"}

# Exact entries: every third supplier's actor address. Ranges: /8 to /28 blocks from part keys, with
# overlaps and neighbours.
EXACT_SQL = f"""
exact AS (SELECT 'tor_exits' AS feed, s_suppkey * {ACTOR_STEP} + {ACTOR_BASE} AS ip_int FROM supplier WHERE s_suppkey % 3 = 0)"""
CIDR_SQL = f"""
raw AS (
  SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN (p_partkey % 150) * {ACTOR_STEP} + {ACTOR_BASE}
      ELSE {mix_sql('p_partkey', 99)} END AS base, 16 + p_size % 17 AS bits FROM part
),
nets AS (
  SELECT 'firehol_level1' AS feed, base - base % (1::BIGINT << (32 - bits)) AS lo,
    base - base % (1::BIGINT << (32 - bits)) + (1::BIGINT << (32 - bits)) - 1 AS hi FROM raw
),
ranges AS (
  SELECT feed, min(lo) AS lo, max(hi) AS hi FROM (
    SELECT *, sum(starts) OVER (PARTITION BY feed ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS part FROM (
      SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY feed ORDER BY lo, hi
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS starts FROM nets))
  GROUP BY feed, part
)"""


def exact_feed(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "supplier").where("s_suppkey % 3 = 0")
    return entries.select(F.lit("tor_exits").alias("feed"), (F.col("s_suppkey") * ACTOR_STEP + ACTOR_BASE).alias("ip_int"))


def cidr_lines(spark: SparkSession, sf: str) -> DataFrame:
    base = F.when(F.col("p_partkey") % 5 == 0, (F.col("p_partkey") % 150) * ACTOR_STEP + ACTOR_BASE).otherwise(
        mix(F.col("p_partkey"), 99)
    )
    text = F.concat(long_to_ip(base), F.lit("/"), (F.lit(16) + F.col("p_size") % 17).cast("string"))
    return table(spark, sf, "part").select(F.lit("firehol_level1").alias("feed"), text.alias("value"))


def cidr_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return rep.merge_ranges(feeds.parse_cidr(cidr_lines(spark, sf)), keys=("feed",))


# Addresses to classify: actors and customers' spread addresses, each with many rows.
ADDRESS_SQL = f"""
addr AS (
  SELECT DISTINCT a AS ip_int, {ip_sql('a')} AS ip FROM (
    SELECT user_id * {ACTOR_STEP} + {ACTOR_BASE} AS a FROM events UNION ALL SELECT {mix_sql('c_custkey', 7)} FROM customer)
)"""


def addresses(spark: SparkSession, sf: str) -> DataFrame:
    actors = table(spark, sf, "events").select((F.col("user_id") * ACTOR_STEP + ACTOR_BASE).alias("a"))
    spread = table(spark, sf, "customer").select(mix(F.col("c_custkey"), 7).alias("a"))
    return actors.unionByName(spread).select(long_to_ip(F.col("a")).alias("ip"))


def address_ints(spark: SparkSession, sf: str) -> DataFrame:
    return addresses(spark, sf).distinct().select("ip", ip_to_long(F.col("ip")).alias("ip_int"))


def _scope_case(part: int) -> str:
    arms = []
    for network, bits, *labels in SCOPE_RANGES:
        a, b, c, d = (int(x) for x in network.split("."))
        lo = ((a * 256 + b) * 256 + c) * 256 + d
        arms.append(f"WHEN ip_int BETWEEN {lo} AND {lo + 2 ** (32 - bits) - 1} THEN '{labels[part]}'")
    return "CASE " + " ".join(arms) + f" ELSE '{('global', 'globally routable')[part]}' END"


@query("ip_scope", f"WITH {ADDRESS_SQL} SELECT ip, {_scope_case(0)} AS scope, {_scope_case(1)} AS detail FROM addr")
def ip_scope_query(spark: SparkSession, sf: str) -> DataFrame:
    scoped = address_ints(spark, sf).select("ip", ip_scope(F.col("ip_int")).alias("s"))
    return scoped.select("ip", "s.scope", "s.detail")


@query(
    "feed_parse",
    f"""WITH {CIDR_SQL}, x AS (SELECT s_suppkey * 7919 + 16777216 AS v, s_suppkey FROM supplier)
        SELECT 'cidr' AS kind, lo, hi FROM nets
        UNION ALL SELECT 'exact', v, v FROM x WHERE s_suppkey % 4 IN (0, 1)""",
)
def feed_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Comments, padding, ranges and bad addresses among the lines."""
    key = F.col("s_suppkey")
    good = long_to_ip(key * 7919 + 16777216)
    line = (
        F.when(key % 4 == 0, good).when(key % 4 == 1, F.concat(F.lit("  "), good, F.lit(" ")))
        .when(key % 4 == 2, F.concat(F.lit("# "), good)).otherwise(F.concat(good, F.lit(".1")))
    )
    exact = feeds.parse_exact(table(spark, sf, "supplier").select(line.alias("value")))
    noise = cidr_lines(spark, sf).select(F.lit("# comment").alias("value")).limit(1)
    cidr = feeds.parse_cidr(cidr_lines(spark, sf).select("value").unionByName(noise))
    return cidr.select(F.lit("cidr").alias("kind"), "lo", "hi").unionByName(
        exact.select(F.lit("exact").alias("kind"), F.col("ip_int").alias("lo"), F.col("ip_int").alias("hi"))
    )


def entry_counts(spark: SparkSession, sf: str) -> DataFrame:
    exact = exact_feed(spark, sf).groupBy("feed").agg(F.count("*").alias("entries"))
    cidr = feeds.parse_cidr(cidr_lines(spark, sf)).groupBy("feed").agg(F.count("*").alias("entries"))
    return exact.unionByName(cidr)


FLOOR_SQL = f"""{EXACT_SQL}, {CIDR_SQL},
floors AS (
  SELECT 'tor_exits' AS feed, count(*) AS entries, count(*) >= 20 AS accepted FROM exact
  UNION ALL SELECT 'firehol_level1', count(*), count(*) >= 500 FROM nets
)"""


def floors(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed feed table with the exact feed's floor lowered to the test data's size."""
    specs = feeds.feed_specs(spark).withColumn(
        "min_entries", F.when(F.col("kind") == "exact", 20).otherwise(F.col("min_entries"))
    )
    return feeds.feed_floor(entry_counts(spark, sf), specs)


@query("feed_floor", f"WITH {FLOOR_SQL} SELECT * FROM floors")
def feed_floor(spark: SparkSession, sf: str) -> DataFrame:
    return floors(spark, sf).select("feed", "entries", "accepted")


def status(spark: SparkSession, sf: str) -> DataFrame:
    provenance = spark.createDataFrame(list(FETCHED.items()), "feed string, fetched_at string")
    return feeds.feed_status(floors(spark, sf), provenance, F.to_timestamp(F.lit(AS_OF)))


@query(
    "feed_freshness",
    f"""WITH {FLOOR_SQL} SELECT feed, entries, CASE WHEN NOT accepted THEN 'missing' WHEN feed = 'tor_exits' THEN 'stale' ELSE 'fresh' END AS state,
        CASE WHEN NOT accepted THEN NULL WHEN feed = 'tor_exits' THEN 42.0::DOUBLE ELSE 24.0::DOUBLE END AS age_hours FROM floors""",
)
def feed_freshness(spark: SparkSession, sf: str) -> DataFrame:
    return status(spark, sf).select("feed", "entries", "state", "age_hours")


@query("cidr_merge", f"WITH {CIDR_SQL} SELECT feed, lo, hi FROM ranges")
def cidr_merge(spark: SparkSession, sf: str) -> DataFrame:
    return cidr_ranges(spark, sf).select("feed", "lo", "hi")


@query(
    "feed_exact_join",
    f"WITH {ADDRESS_SQL}, {EXACT_SQL} SELECT a.ip_int, e.feed FROM addr a JOIN (SELECT DISTINCT * FROM exact) e ON e.ip_int = a.ip_int",
)
def feed_exact_join(spark: SparkSession, sf: str) -> DataFrame:
    return rep.exact_hits(address_ints(spark, sf).select("ip_int"), exact_feed(spark, sf))


@query(
    "cidr_range_join",
    f"WITH {ADDRESS_SQL}, {CIDR_SQL} SELECT a.ip_int, r.feed FROM addr a JOIN ranges r ON a.ip_int BETWEEN r.lo AND r.hi",
)
def cidr_range_join(spark: SparkSession, sf: str) -> DataFrame:
    return rep.range_hits(address_ints(spark, sf).select("ip_int"), cidr_ranges(spark, sf))


# Half of the addresses lie in one /16, with the others' ranges and some of its own.
DENSE_BASE = 45 * (1 << 24)
DENSE_SQL = ADDRESS_SQL + f""",
dense AS (SELECT DISTINCT CASE WHEN ip_int % 2 = 0 THEN {DENSE_BASE} + ip_int * 37 % 65536 ELSE ip_int END AS ip_int FROM addr),
own AS (SELECT 'dense' AS feed, {DENSE_BASE} + p_partkey * 8 % 65536 AS lo, {DENSE_BASE} + p_partkey * 8 % 65536 + p_size AS hi FROM part)"""


@query(
    "cidr_dense_range_join",
    f"""WITH {DENSE_SQL}, {CIDR_SQL} SELECT DISTINCT a.ip_int, r.feed FROM dense a
        JOIN (SELECT feed, lo, hi FROM ranges UNION ALL SELECT * FROM own) r ON a.ip_int BETWEEN r.lo AND r.hi""",
)
def cidr_dense_range_join(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the addresses in one /16, whose ranges overlap each other."""
    ip = F.col("ip_int")
    dense = address_ints(spark, sf).select(F.when(ip % 2 == 0, ip * 37 % 65536 + DENSE_BASE).otherwise(ip).alias("ip_int"))
    lo = F.col("p_partkey") * 8 % 65536 + DENSE_BASE
    own = table(spark, sf, "part").select(F.lit("dense").alias("feed"), lo.alias("lo"), (lo + F.col("p_size")).alias("hi"))
    return rep.range_hits(dense, cidr_ranges(spark, sf).select("feed", "lo", "hi").unionByName(own))


@query(
    "reputation_verdict",
    f"""WITH {ADDRESS_SQL}, {FLOOR_SQL},
        h AS (SELECT ip, ip_int, {_scope_case(0)} AS scope, {_scope_case(1)} AS sdetail,
            (SELECT accepted FROM floors WHERE feed = 'tor_exits') AND ip_int IN (SELECT ip_int FROM exact) AS tor,
            (SELECT accepted FROM floors WHERE feed = 'firehol_level1')
              AND EXISTS (SELECT 1 FROM ranges r WHERE addr.ip_int BETWEEN r.lo AND r.hi) AS fire FROM addr)
        SELECT ip, CASE WHEN scope <> 'global' THEN scope WHEN tor THEN 'tor_exit' WHEN fire THEN 'blocklisted' ELSE 'unlisted' END AS rep_verdict,
          CAST(CASE WHEN scope = 'global' AND (tor OR fire) THEN 40 ELSE 0 END AS INTEGER) AS rep_hundredths,
          CASE WHEN scope <> 'global' THEN '' ELSE concat_ws(',', CASE WHEN tor THEN 'tor_exits' END, CASE WHEN fire THEN 'firehol_level1' END) END AS rep_sources,
          scope = 'global' AS rep_checked,
          CASE WHEN scope <> 'global' THEN CASE scope WHEN 'internal' THEN 'Internal address' ELSE 'Non-routable address' END || ' — ' || sdetail
            WHEN NOT tor AND NOT fire THEN 'Not listed in ' || (SELECT string_agg(CASE feed WHEN 'tor_exits' THEN 'Tor Project bulk exit list' ELSE 'FireHOL level1' END, ', ' ORDER BY feed DESC) FROM floors WHERE accepted)
            ELSE 'Listed in ' || concat_ws(' + ', CASE WHEN tor THEN 'Tor Project bulk exit list (fetched 2024-01-29, 1.8d stale)' END,
              CASE WHEN fire THEN 'FireHOL level1 (fetched 2024-01-30)' END) END AS rep_detail
        FROM h""",
)
def reputation_verdict(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = rep.classify_addresses(
        addresses(spark, sf), exact_feed(spark, sf), cidr_ranges(spark, sf), status(spark, sf)
    )
    return verdicts.withColumn("rep_sources", F.array_join("rep_sources", ","))


@query(
    "classify_events",
    f"""WITH {FLOOR_SQL} SELECT event_id AS id, CASE WHEN (SELECT accepted FROM floors WHERE feed = 'tor_exits')
          AND ip_int IN (SELECT ip_int FROM exact) THEN 'tor_exit'
        WHEN (SELECT accepted FROM floors WHERE feed = 'firehol_level1')
          AND EXISTS (SELECT 1 FROM ranges r WHERE e.ip_int BETWEEN r.lo AND r.hi) THEN 'blocklisted' ELSE 'unlisted' END AS rep_verdict
        FROM (SELECT event_id, user_id * {ACTOR_STEP} + {ACTOR_BASE} AS ip_int FROM events) e""",
)
def classify_events(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), long_to_ip(F.col("user_id") * ACTOR_STEP + ACTOR_BASE).alias("ip")
    )
    return rep.classify_ips(
        events, exact_feed(spark, sf), cidr_ranges(spark, sf), status(spark, sf)
    ).select("id", "rep_verdict")
