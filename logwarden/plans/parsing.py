"""Queries: log lines rendered from table columns, parsed back and compared with those columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.templates import distinct_masked
from ..sources import labels, parsers
from ..sources.lines import scan_lines
from ..session import shared_folder
from .catalog import query
from .testdata import actor_events, epoch_ms, ip_sql, table

DOLLAR = "$"


def scratch_path(spark: SparkSession) -> str:
    """A new folder name below the shared checkpoint folder; where a cluster names none, an error."""
    return shared_folder(spark, "lines")


# --- HDFS -----------------------------------------------------------------------------------------
LINE_LEVELS = ("INFO", "WARN", "ERROR", "FATAL", "DEBUG", "trace")


def hdfs_lines(spark: SparkSession, sf: str) -> DataFrame:
    """HDFS-style lines of ``lineitem``, with the columns a parse must give back."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("timestamp").alias("ts")
    )
    level = F.get(F.array(*[F.lit(x) for x in LINE_LEVELS]), (F.col("l_partkey") % 6).cast("int"))
    octet = F.col("l_suppkey") % 250
    address = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit(" src: /10.251."), octet.cast("string"), F.lit(".7:50010"))).when(
        F.col("l_partkey") % 3 == 1, F.concat(F.lit(" v010.1.2.3 at 300.1.1.1 via 10.250.1."), octet.cast("string"))
    ).otherwise("")
    content = F.concat(F.lit("Received block blk_-"), F.col("l_orderkey").cast("string"), F.lit(" part"), address)
    header = F.concat(
        F.date_format("ts", "yyMMdd"), F.lit(" "),
        F.lpad((F.col("l_orderkey") % 24).cast("string"), 2, "0"), F.lpad((F.col("l_partkey") % 70).cast("string"), 2, "0"), F.lit("09 "),
        F.col("l_suppkey").cast("string"), F.lit(" "), level, F.lit(" dfs.DataNode" + DOLLAR + "PacketResponder: "),
    )
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit("not a line "), content)).otherwise(F.concat(header, content)).alias("value"),
    )


HDFS_SQL = """
src AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    'Received block blk_-' || l_orderkey || ' part' || CASE l_partkey % 3
      WHEN 0 THEN ' src: /10.251.' || (l_suppkey % 250) || '.7:50010'
      WHEN 1 THEN ' v010.1.2.3 at 300.1.1.1 via 10.250.1.' || (l_suppkey % 250) ELSE '' END AS content,
    epoch_us(date_trunc('day', l_shipdate)) // 1000 + (l_orderkey % 24) * 3600000 + (l_partkey % 70) * 60000 + 9000 AS ts_ms,
    l_linenumber <> 7 AND l_partkey % 70 < 60 AS parses
  FROM lineitem
)"""


@query(
    "parse_hdfs",
    f"""WITH {HDFS_SQL}
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ts_ms, 'dfs.DataNode' AS source,
          CASE l_partkey % 6 WHEN 0 THEN 'log_info' WHEN 1 THEN 'log_warning' WHEN 2 THEN 'log_error'
            WHEN 3 THEN 'log_critical' ELSE 'log_debug' END AS event,
          CASE l_partkey % 3 WHEN 0 THEN '10.251.' || (l_suppkey % 250) || '.7'
            WHEN 1 THEN '10.250.1.' || (l_suppkey % 250) ELSE '10.0.0.0' END AS ip,
          content AS message, 'hdfs' AS log_format, 'replay:hdfs' AS origin FROM src WHERE parses""",
)
def parse_hdfs(spark: SparkSession, sf: str) -> DataFrame:
    events, _ = parsers.parse_lines(hdfs_lines(spark, sf), "hdfs")
    return events.drop("user", "transport_peer_ip")


@query(
    "hdfs_rejects",
    f"""WITH {HDFS_SQL} SELECT count(*) AS lines, count(*) FILTER (WHERE parses) AS parsed,
        count(*) FILTER (WHERE NOT parses) AS rejected FROM src""",
)
def hdfs_rejects(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parsers.parse_hdfs(hdfs_lines(spark, sf)).select(F.col("parsed").isNotNull().alias("ok"))
    return parsed.agg(
        F.count("*").alias("lines"), F.count(F.when(F.col("ok"), 1)).alias("parsed"),
        F.count(F.when(~F.col("ok"), 1)).alias("rejected"),
    )


# --- syslog-style lines of the event table -----------------------------------------------------------
def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = actor_events(spark, sf).select("id", "ip", "ts_ms", "event", "user_id", "user")
    ts = F.timestamp_millis("ts_ms")
    return e.withColumns(
        {
            "stamp": F.concat(F.date_format(ts, "MMM "), F.lpad(F.dayofmonth(ts).cast("string"), 2, " "), F.date_format(ts, " HH:mm:ss")),
            "second_ms": F.floor(F.col("ts_ms") / 1000) * 1000,
        }
    )


EVENT_LINES_SQL = f"""
ev AS (
  SELECT event_id AS id, epoch_us(ts) // 1000 AS ts_ms, (epoch_us(ts) // 1000000) * 1000 AS second_ms, user_id,
    event_type, {ip_sql("user_id * 4099 + 754974721")} AS ip, 'user' || user_id AS "user" FROM events
)"""


def _sshd_body(e: DataFrame) -> Column:
    kind = F.col("user_id") % 9
    port = (F.col("id") % 65535 + 1).cast("string")
    return (
        F.when(kind == 0, F.concat(F.lit("Failed password for "), "user", F.lit(" from "), "ip", F.lit(" port "), port, F.lit(" ssh2")))
        .when(kind == 1, F.concat(F.lit("Failed password for invalid user "), "user", F.lit(" from "), "ip", F.lit(" port "), port))
        .when(kind == 2, F.concat(F.lit("Invalid user "), "user", F.lit(" from "), "ip"))
        .when(kind == 3, F.concat(F.lit("Accepted publickey for "), "user", F.lit(" from "), "ip", F.lit(" port "), port, F.lit(" ssh2")))
        .when(kind == 4, F.concat(F.lit("Failed password for "), "user", F.lit(" from "), "ip", F.lit(" port 0 ssh2")))
        .when(kind == 5, F.concat(F.lit("Failed password for "), "user", F.lit(" from 999.1.2.3 port 22 ssh2")))
        .when(kind == 6, F.concat(F.lit("Invalid user "), "user", F.lit(" from "), "ip", F.lit(" port 22")))
        .when(kind == 7, F.concat(F.lit("Invalid user "), "user", F.lit(" from ::ffff:"), "ip"))
        .otherwise(F.concat(F.lit("reverse mapping - POSSIBLE BREAK-IN ATTEMPT! "), "ip"))
    )


SSHD_SQL = """
body AS (
  SELECT *, user_id % 9 AS k, CASE user_id % 9
      WHEN 0 THEN 'Failed password for ' || "user" || ' from ' || ip || ' port ' || (id % 65535 + 1) || ' ssh2'
      WHEN 1 THEN 'Failed password for invalid user ' || "user" || ' from ' || ip || ' port ' || (id % 65535 + 1)
      WHEN 2 THEN 'Invalid user ' || "user" || ' from ' || ip
      WHEN 3 THEN 'Accepted publickey for ' || "user" || ' from ' || ip || ' port ' || (id % 65535 + 1) || ' ssh2'
      WHEN 4 THEN 'Failed password for ' || "user" || ' from ' || ip || ' port 0 ssh2'
      WHEN 5 THEN 'Failed password for ' || "user" || ' from 999.1.2.3 port 22 ssh2'
      WHEN 6 THEN 'Invalid user ' || "user" || ' from ' || ip || ' port 22'
      WHEN 7 THEN 'Invalid user ' || "user" || ' from ::ffff:' || ip
      ELSE 'reverse mapping - POSSIBLE BREAK-IN ATTEMPT! ' || ip END AS msg,
    CASE WHEN user_id % 9 IN (0, 1) THEN 'failed_login' WHEN user_id % 9 IN (2, 7) THEN 'auth_invalid_user'
      WHEN user_id % 9 = 3 THEN 'login_success' END AS auth
  FROM ev
)"""


@query(
    "parse_openssh",
    f"""WITH {EVENT_LINES_SQL}, {SSHD_SQL}
        SELECT id, second_ms AS ts_ms, 'bastion4' AS source,
          coalesce(auth, CASE WHEN k = 8 THEN 'log_warning' ELSE 'log_info' END) AS event,
          CASE WHEN auth IS NULL THEN '127.0.0.1' ELSE ip END AS ip,
          CASE WHEN auth IS NULL THEN 'unknown' ELSE "user" END AS "user", msg AS message FROM body""",
)
def parse_openssh(spark: SparkSession, sf: str) -> DataFrame:
    e = event_lines(spark, sf)
    lines = e.select("id", F.concat("stamp", F.lit(" bastion4 sshd[713]: "), _sshd_body(e)).alias("value"))
    events, _ = parsers.parse_lines(lines, "openssh", year=2024)
    return events.select("id", "ts_ms", "source", "event", "ip", "user", "message")


@query(
    "sshd_auth",
    f"""WITH {EVENT_LINES_SQL}, {SSHD_SQL}
        SELECT id, CASE WHEN id % 4 <> 0 THEN auth END AS event, CASE WHEN id % 4 <> 0 AND auth IS NOT NULL THEN ip END AS ip,
          CASE WHEN id % 4 <> 0 AND auth IS NOT NULL THEN "user" END AS "user" FROM body""",
)
def sshd_auth(spark: SparkSession, sf: str) -> DataFrame:
    e = event_lines(spark, sf)
    tag = F.when(F.col("id") % 4 == 0, "cron").when(F.col("id") % 4 == 1, "sshd").otherwise("sshd[77]")
    lines = e.select("id", tag.alias("tag"), _sshd_body(e).alias("body"))
    found = parsers.with_sshd_auth(lines, F.col("tag"), F.col("body"))
    return found.select("id", "auth.event", "auth.ip", "auth.user")


FILE_SQL = f"""{EVENT_LINES_SQL}, k AS (
  SELECT *, user_id % 8 AS k, (ts_ms // 86400000) AS d FROM ev
)"""


@query(
    "parse_syslog_file",
    f"""WITH {FILE_SQL}
        SELECT id, CASE WHEN k IN (6, 7) THEN 1700000000000 ELSE second_ms END AS ts_ms,
          CASE WHEN k = 7 THEN 'system.log' ELSE 'harbor9' END AS source,
          CASE k WHEN 0 THEN 'privilege_escalation' WHEN 1 THEN 'log_info' WHEN 2 THEN 'log_error' WHEN 3 THEN 'log_warning'
            ELSE 'log_info' END AS event,
          CASE WHEN k IN (4, 5) THEN '010.' || (id % 250) || '.1.9'
            WHEN k = 6 THEN '010.' || (id % 250) || '.1.99' ELSE '127.0.0.1' END AS ip,
          CASE k WHEN 0 THEN 'www-data' ELSE 'unknown' END AS "user",
          CASE k WHEN 0 THEN 'su[886]: Successful su for ' || "user" || ' by www-data'
            WHEN 1 THEN 'su: Successful su for nginx by nginx' WHEN 2 THEN 'app: Connection REFUSED by peer'
            WHEN 3 THEN 'app: unable to reach ' || "user" WHEN 7 THEN '-- marker ' || id || ' --'
            ELSE 'app[9]: closed by 010.' || (id % 250) || '.1.9' || CASE k WHEN 6 THEN '9.9.9.9x' ELSE '' END END AS message
        FROM k""",
)
def parse_syslog_file(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("user_id") % 8
    address = F.concat(F.lit("010."), (F.col("id") % 250).cast("string"), F.lit(".1.9"))
    body = (
        F.when(kind == 0, F.concat(F.lit("su[886]: Successful su for "), "user", F.lit(" by www-data")))
        .when(kind == 1, F.lit("su: Successful su for nginx by nginx"))
        .when(kind == 2, F.lit("app: Connection REFUSED by peer"))
        .when(kind == 3, F.concat(F.lit("app: unable to reach "), "user"))
        .when(kind == 6, F.concat(F.lit("app[9]: closed by "), address, F.lit("9.9.9.9x")))
        .otherwise(F.concat(F.lit("app[9]: closed by "), address))
    )
    stamp = F.when(kind == 6, F.lit("Feb 31 10:00:00")).otherwise(F.col("stamp"))
    line = F.when(kind == 7, F.concat(F.lit("-- marker "), F.col("id").cast("string"), F.lit(" --"))).otherwise(
        F.concat(stamp, F.lit(" harbor9 "), body)
    )
    e = event_lines(spark, sf).select("id", line.alias("value"))
    # Blank lines are the only ones that give no event.
    blanks = e.select("id", F.lit("  ").alias("value"))
    parsed = parsers.parse_syslog_file(e.unionByName(blanks), F.lit(2024), _received(), F.lit("system.log"))
    events, _ = parsers.split_parsed(parsed)
    return events.select("id", "ts_ms", "source", "event", "ip", "user", "message")


def _received() -> Column:
    return F.lit(1_700_000_000_000)


def _syslog(lines: DataFrame, formats: tuple[str, ...] = parsers.SYSLOG_FORMATS, trusted=("127.0.0.1",)) -> DataFrame:
    parsed = parsers.parse_syslog(
        lines, "value", F.col("peer"), F.lit(2024), _received(), trusted, formats
    )
    return parsers.split_parsed(parsed)[0]


def _rfc5424_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = event_lines(spark, sf)
    body = _sshd_body(e)
    return e.select(
        "id",
        F.concat(
            F.lit("<"), (F.col("id") % 192).cast("string"), F.lit(">1 "),
            F.when(F.col("id") % 5 == 0, "yesterday").otherwise(F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")),
            F.lit(" "), F.when(F.col("id") % 3 == 0, "-").otherwise("gate"), F.lit(" "),
            F.when(F.col("id") % 7 == 0, "-").otherwise("sshd"), F.lit(" - ID47 "),
            F.when(F.col("id") % 2 == 0, F.concat(F.lit("- "), body)).otherwise(F.concat(F.lit('[ex@1 a="b"] '), body)),
        ).alias("value"),
        F.when(F.col("user_id") % 2 == 0, "127.0.0.1").otherwise("192.0.2.10").alias("peer"),
    )


FACILITY_SQL = """list_extract(['kern','user','mail','daemon','auth','syslog','lpr','news','uucp','cron','authpriv',
  'ftp','ntp','audit','alert','clock','local0','local1','local2','local3','local4','local5','local6','local7'], (id % 192) // 8 + 1)"""
SEVERITY_SQL = """list_extract(['log_emergency','log_alert','log_critical','log_error','log_warning','log_notice',
  'log_info','log_debug'], (id % 192) % 8 + 1)"""
RFC5424_SQL = f"""{EVENT_LINES_SQL}, {SSHD_SQL}, p AS (
  SELECT *, CASE WHEN user_id % 2 = 0 THEN '127.0.0.1' ELSE '192.0.2.10' END AS peer,
    CASE WHEN id % 7 = 0 THEN {FACILITY_SQL} ELSE 'sshd' END AS app,
    id % 2 = 0 AND id % 7 <> 0 AND user_id % 2 = 0 AND auth IS NOT NULL AS named FROM body
)"""
RFC5424_SELECT = f"""SELECT id, CASE WHEN id % 5 = 0 THEN 1700000000000 ELSE ts_ms END AS ts_ms,
  CASE WHEN id % 3 = 0 THEN peer ELSE 'gate' END AS source,
  CASE WHEN named THEN auth ELSE {SEVERITY_SQL} END AS event,
  CASE WHEN named THEN ip ELSE peer END AS ip, CASE WHEN named THEN "user" ELSE 'unknown' END AS "user",
  app || ': ' || CASE WHEN id % 2 = 0 THEN '- ' ELSE '[ex@1 a="b"] ' END || msg AS message,
  'rfc5424' AS log_format, peer AS transport_peer_ip FROM p"""


@query("parse_rfc5424", f"WITH {RFC5424_SQL} {RFC5424_SELECT}")
def parse_rfc5424(spark: SparkSession, sf: str) -> DataFrame:
    return _syslog(_rfc5424_lines(spark, sf), ("rfc5424",)).drop("origin", "peer")


def _rfc3164_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = event_lines(spark, sf)
    tag = F.when(F.col("id") % 3 == 0, "sshd[99]: ").when(F.col("id") % 3 == 1, "sshd: ").otherwise("no tag here ")
    return e.select(
        "id",
        F.concat(F.lit("<"), (F.col("id") % 192).cast("string"), F.lit(">"), "stamp", F.lit(" box "), tag, _sshd_body(e)).alias("value"),
        F.when(F.col("user_id") % 2 == 0, "127.0.0.1").otherwise("192.0.2.10").alias("peer"),
    )


RFC3164_SELECT = f"""SELECT id, second_ms AS ts_ms, 'box' AS source,
  CASE WHEN named THEN auth ELSE {SEVERITY_SQL} END AS event,
  CASE WHEN named THEN ip ELSE peer END AS ip, CASE WHEN named THEN "user" ELSE 'unknown' END AS "user",
  CASE id % 3 WHEN 0 THEN 'sshd[99]: ' WHEN 1 THEN 'sshd: ' ELSE 'no tag here ' END || msg AS message,
  'rfc3164' AS log_format, peer AS transport_peer_ip
  FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN '127.0.0.1' ELSE '192.0.2.10' END AS peer,
    id % 3 <> 2 AND user_id % 2 = 0 AND auth IS NOT NULL AS named FROM body)"""


@query("parse_rfc3164", f"WITH {EVENT_LINES_SQL}, {SSHD_SQL} {RFC3164_SELECT}")
def parse_rfc3164(spark: SparkSession, sf: str) -> DataFrame:
    return _syslog(_rfc3164_lines(spark, sf), ("rfc3164",)).drop("origin", "peer")


@query(
    "parse_syslog_mixed",
    f"""WITH {RFC5424_SQL} SELECT 'a' AS part, * FROM ({RFC5424_SELECT})
        UNION ALL SELECT 'b', * FROM ({RFC3164_SELECT})
        UNION ALL SELECT 'c', id, 1700000000000, '192.0.2.10', 'log_info', '192.0.2.10', 'unknown', msg, 'raw', '192.0.2.10' FROM body""",
)
def parse_syslog_mixed(spark: SparkSession, sf: str) -> DataFrame:
    e = event_lines(spark, sf)
    raw = e.select(F.lit("c").alias("part"), "id", F.concat(F.lit("  "), _sshd_body(e), F.lit("\n")).alias("value"), F.lit("192.0.2.10").alias("peer"))
    lines = (
        _rfc5424_lines(spark, sf).select(F.lit("a").alias("part"), "id", "value", "peer")
        .unionByName(_rfc3164_lines(spark, sf).select(F.lit("b").alias("part"), "id", "value", "peer"))
        .unionByName(raw)
    )
    return _syslog(lines).drop("origin", "peer")


@query(
    "peer_attribution",
    f"""WITH {EVENT_LINES_SQL}, {SSHD_SQL} SELECT peer, named, count(*) AS n FROM (
          SELECT CASE WHEN user_id % 3 = 0 THEN '127.0.0.1' WHEN user_id % 3 = 1 THEN '127.0.0.2' ELSE '192.0.2.10' END AS peer,
            user_id % 3 = 0 AND auth IS NOT NULL AS named FROM body) GROUP BY ALL""",
)
def peer_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Listed but not loopback, and loopback but not listed, are both refused."""
    e = event_lines(spark, sf)
    peer = F.when(F.col("user_id") % 3 == 0, "127.0.0.1").when(F.col("user_id") % 3 == 1, "127.0.0.2").otherwise("192.0.2.10")
    line = F.concat(F.lit("<34>"), "stamp", F.lit(" box sshd[9]: "), _sshd_body(e))
    lines = e.select(line.alias("value"), peer.alias("peer"))
    parsed = _syslog(lines, trusted=("127.0.0.1", "192.0.2.10"))
    return parsed.select("peer", (F.col("event") != "log_critical").alias("named")).groupBy("peer", "named").agg(F.count("*").alias("n"))


@query(
    "pri_decode",
    f"""SELECT event_id AS id, CASE WHEN event_id % 300 < 192 THEN {FACILITY_SQL.replace('id % 192', 'event_id % 300')}
          ELSE 'facility' || ((event_id % 300) // 8) END AS facility, CAST((event_id % 300) % 8 AS INTEGER) AS severity,
          {SEVERITY_SQL.replace('id % 192', 'event_id % 300')} AS event FROM events""",
)
def pri_decode(spark: SparkSession, sf: str) -> DataFrame:
    pri = (F.col("event_id") % 300).cast("int")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), text.pri_facility(pri).alias("facility"),
        text.pri_severity(pri).alias("severity"), text.severity_event(text.pri_severity(pri)).alias("event"),
    )


# --- text functions over documents and pages ----------------------------------------------------------
@query(
    "keyword_level",
    """SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'error|failed|failure|denied|refused|panic|fatal') THEN 'log_error'
         WHEN regexp_matches(lower(text), 'warn|warning|unable to|timeout|retry') THEN 'log_warning' ELSE 'log_info' END AS level
       FROM documents""",
)
def keyword_level(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.keyword_level(F.col("text")).alias("level"))


OCTETS_SQL = """list_filter(regexp_extract_all(text, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b'),
  lambda c: list_bool_and(list_transform(string_split(c, '.'), lambda p: CAST(p AS INTEGER) <= 255 AND (NOT %s OR p = '0' OR p[1] <> '0'))))"""


@query(
    "first_ipv4",
    f"""SELECT doc_id, list_extract({OCTETS_SQL % 'true'}, 1) AS strict_ip,
          list_extract({OCTETS_SQL % 'false'}, 1) AS loose_ip FROM documents""",
)
def first_ipv4(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", text.first_ipv4(F.col("text")).alias("strict_ip"), text.first_ipv4(F.col("text"), strict=False).alias("loose_ip")
    )


@query(
    "service_account_su",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_nationkey % 4 <> 3 AND c_custkey % 5 <> 0
         THEN list_extract(['www-data', 'apache', 'nginx'], c_nationkey % 4 + 1) END AS actor FROM customer""",
)
def service_account_su(spark: SparkSession, sf: str) -> DataFrame:
    actor = F.get(F.array(*[F.lit(x) for x in ("www-data", "apache", "nginx", "root")]), (F.col("c_nationkey") % 4).cast("int"))
    target = F.when(F.col("c_custkey") % 5 == 0, actor).otherwise("jhall")
    tag = F.when(F.col("c_custkey") % 2 == 0, "su").otherwise("app")
    return table(spark, sf, "customer").select(
        "c_custkey", text.service_account_su(tag, F.concat(F.lit("Successful su for "), target, F.lit(" by "), actor)).alias("actor")
    )


MASK_SQL = "url"
for _pattern, _name in (
    (r"blk_-?\d+", "<BLK>"), (r"(\d+\.){3}\d+(:\d+)?", "<IP>"), (r"/[-\w./]+", "<PATH>"),
    (r"0x[0-9a-fA-F]+", "<HEX>"), (r"\b\d+\b", "<NUM>"),
):
    MASK_SQL = f"regexp_replace({MASK_SQL}, '{_pattern}', '{_name}', 'g')"


@query(
    "mask_lines",
    f"""SELECT page_id AS id, {MASK_SQL} AS masked FROM pages
        UNION ALL SELECT id, {MASK_SQL.replace('url', 'content')} FROM
          (SELECT -1 - l_orderkey * 100 - l_linenumber AS id, content FROM (WITH {HDFS_SQL} SELECT * FROM src))""",
)
def mask_lines(spark: SparkSession, sf: str) -> DataFrame:
    urls = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("content"))
    lines = hdfs_lines(spark, sf).select(
        (-1 - F.col("l_orderkey") * 100 - F.col("l_linenumber")).alias("id"), text.line_content(F.col("value")).alias("content")
    )
    content = F.regexp_replace("content", "^not a line ", "")
    return urls.unionByName(lines).select("id", text.mask(content).alias("masked"))


@query(
    "masked_distinct",
    f"""WITH {HDFS_SQL} SELECT masked, count(*) AS lines, min(l_orderkey * 10 + l_linenumber) AS first_pos FROM
        (SELECT *, {MASK_SQL.replace('url', 'content')} AS masked FROM src) GROUP BY masked""",
)
def masked_distinct(spark: SparkSession, sf: str) -> DataFrame:
    lines = hdfs_lines(spark, sf).select(
        F.regexp_replace(text.line_content(F.col("value")), "^not a line ", "").alias("content"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"),
    )
    return distinct_masked(lines).select("masked", "lines", "first_pos")


# --- line scan and labels -----------------------------------------------------------------------------
@query(
    "scan_lines",
    """SELECT row_number() OVER (ORDER BY o_orderkey) AS position, 'order ' || o_orderkey || ' ' || o_orderpriority AS value
       FROM orders""",
)
def scan_lines_query(spark: SparkSession, sf: str) -> DataFrame:
    """Text written in key order and read back: the position must be the key's rank."""
    path = scratch_path(spark)
    rendered = table(spark, sf, "orders").orderBy("o_orderkey").select(
        F.concat_ws(" ", F.lit("order"), F.col("o_orderkey").cast("string"), "o_orderpriority").alias("value")
    )
    rendered.write.text(path)
    return scan_lines(spark, path).select("position", "value")


@query(
    "load_labels",
    """SELECT 'blk_' || o_orderkey AS block_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders""",
)
def load_labels(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark)
    status = F.when(F.col("o_orderstatus") == "F", " Anomaly ").otherwise("Normal")
    table(spark, sf, "orders").select(
        F.concat(F.lit("blk_"), F.col("o_orderkey").cast("string")).alias("BlockId"), status.alias("Label")
    ).write.csv(path, header=True)
    return labels.load_block_labels(spark, path)


@query(
    "validate_labels",
    """WITH r AS (SELECT event_id + 1 AS n, user_id % 10 AS k, CASE WHEN user_id % 10 = 4 THEN 10 ELSE event_id + 1 END AS line FROM events),
       c AS (SELECT line, count(*) AS c FROM r WHERE k NOT IN (0, 1, 2) GROUP BY line)
       SELECT violation, count(*) AS n FROM (
         SELECT CASE WHEN k = 0 THEN 'invalid_json' WHEN k IN (1, 2) THEN 'line_not_integer'
           WHEN r.line > 9000 THEN 'line_out_of_range' WHEN c.c > 1 THEN 'line_repeated'
           WHEN k IN (5, 6) THEN 'labels_invalid' WHEN n % 4 = 1 THEN 'rules_invalid' ELSE 'valid' END AS violation FROM r LEFT JOIN c USING (line)) GROUP BY violation""",
)
def validate_labels(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("user_id") % 10
    number = (F.col("event_id") + 1).cast("string")
    line = F.when(kind == 1, "true").when(kind == 2, F.concat(F.lit('"'), number, F.lit('"'))).when(kind == 4, "10").otherwise(number)
    tags = F.when(kind == 5, "[]").when(kind == 6, '["a",""]').otherwise('["scan"]')
    bad_rules = F.array(*[F.lit(x) for x in ('{"p":"r1"}', "[1]", '{"p":["r1",""]}', '{"p":["a"],"q":[1]}', "null", '{"p":[null]}')])
    good_rules = F.array(*[F.lit(x) for x in (',"rules":{"p":["r1","r2"]}', ',"rules":{"p":[]}', ',"rules":{}', "")])
    pick = F.floor(F.col("event_id") / 4)
    rules = F.when((F.col("event_id") + 1) % 4 == 1, F.concat(F.lit(',"rules":'), F.get(bad_rules, (pick % 6).cast("int")))).otherwise(
        F.get(good_rules, (pick % 4).cast("int"))
    )
    record = F.when(kind == 0, F.lit("{broken")).otherwise(
        F.concat(F.lit('{"line":'), line, F.lit(',"labels":'), tags, rules, F.lit("}"))
    )
    records = table(spark, sf, "events").select(record.alias("value"))
    good, bad = labels.validate_line_labels(labels.parse_line_labels(records), 9000)
    return (
        bad.select("violation").unionByName(good.select(F.lit("valid").alias("violation")))
        .groupBy("violation").agg(F.count("*").alias("n"))
    )
