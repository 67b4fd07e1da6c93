"""Log lines to raw events.

Every parser adds a struct column ``parsed`` (null when the line does not parse). A pattern runs once
per line: its groups are written out one per text line and split again, in a projection of their own,
so that later expressions read array items and generated code stays small.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    HDFS_LINE,
    OPENSSH_CORPUS_YEAR,
    OPENSSH_LINE,
    RFC3164_LINE,
    RFC5424_LINE,
    SSHD_ACCEPTED,
    SSHD_FAILED,
    SSHD_INVALID,
    SSHD_TAG,
    SUCCESSFUL_SU,
    SYSLOG_FILE_LINE,
    SYSLOG_TAG,
)
from ..functions.net import canonical_ip, loopback_among, settled
from ..functions.text import (
    clock_timestamp,
    first_ipv4,
    keyword_level,
    level_event,
    month_number,
    pri_facility,
    pri_severity,
    service_actor,
    severity_event,
    stripped,
)

RAW_FIELDS = (
    "ts_ms", "source", "event", "ip", "user", "message", "log_format", "origin",
    "transport_peer_ip",
)
SYSLOG_FORMATS = ("rfc5424", "rfc3164", "raw")


def by_alphabet(text: Column, pattern: str, use: Callable[[str], Column]) -> Column:
    """``use`` of the pattern. Text in ASCII only has no use for Unicode classes, which are slow to tell: there they are left out."""
    flags = re.match(r"\(\?([a-z]*)U\)", pattern)
    if not flags:
        return use(pattern)
    plain = (f"(?{flags[1]})" if flags[1] else "") + pattern[flags.end():]
    return F.when(F.octet_length(text) == F.char_length(text), use(plain)).otherwise(use(pattern))


def with_groups(
    df: DataFrame, out: str, text: Column, pattern: str, count: int, only: Column | None = None
) -> DataFrame:
    """Add ``out``: the pattern's groups as an array, null where the text does not match.

    No group but the last can hold a line feed (all are built from non-space classes, or the text is
    a single line), so it separates them. A match always changes the text, since it consumes white
    space or brackets between the groups.
    """
    written = by_alphabet(text, pattern, lambda p: F.regexp_replace(text, p, "\n".join(f"${i}" for i in range(1, count + 1))))
    if only is not None:
        written = F.when(only, written)
    staged = df.withColumn("__written", written)
    groups = F.when(F.col("__written") != text, F.split("__written", "\n", count))
    # The JVM compiles short methods only: a stage for each pattern keeps them so.
    return settled(staged, out, groups).drop("__written")


def _item(groups: str, i: int) -> Column:
    return F.get(groups, F.lit(i))


def _raw(**values: Column | str | None) -> Column:
    fields = []
    for name in RAW_FIELDS:
        value = values.get(name)
        column = value if isinstance(value, Column) else F.lit(value)
        fields.append(column.cast("long" if name == "ts_ms" else "string").alias(name))
    return F.struct(*fields)


def with_sshd_auth(
    df: DataFrame, tag: Column, message: Column, out: str = "auth", ipv6: bool = True
) -> DataFrame:
    """Add ``out``: struct(event, ip, user) of a complete sshd authentication message, else null."""
    staged = df.withColumn("__s_m", F.when(tag.rlike(SSHD_TAG), message))
    m = F.col("__s_m")
    staged = with_groups(staged, "__s_f", m, SSHD_FAILED, 3, m.startswith("Failed"))
    staged = with_groups(staged, "__s_i", m, SSHD_INVALID, 2, m.startswith("Invalid"))
    staged = with_groups(staged, "__s_a", m, SSHD_ACCEPTED, 3, m.startswith("Accepted"))
    port = F.coalesce(_item("__s_f", 2), _item("__s_a", 2)).try_cast("int")
    staged = staged.withColumns(
        {
            "__s_event": F.when(F.col("__s_f").isNotNull(), "failed_login")
            .when(F.col("__s_i").isNotNull(), "auth_invalid_user")
            .when(F.col("__s_a").isNotNull(), "login_success"),
            "__s_g": F.coalesce("__s_f", "__s_i", "__s_a"),
            "__s_port_ok": F.col("__s_i").isNotNull() | port.between(1, 65535),
        }
    )
    staged = staged.withColumn("__s_ip", canonical_ip(_item("__s_g", 1), ipv6))
    auth = F.when(
        F.col("__s_event").isNotNull() & F.col("__s_port_ok") & F.col("__s_ip").isNotNull(),
        F.struct(F.col("__s_event").alias("event"), F.col("__s_ip").alias("ip"), _item("__s_g", 0).alias("user")),
    )
    return settled(staged, out, auth).drop("__s_m", "__s_f", "__s_i", "__s_a", "__s_event", "__s_g", "__s_port_ok", "__s_ip")


def parse_hdfs(df: DataFrame, col: str = "value") -> DataFrame:
    staged = with_groups(df, "__g", F.col(col), HDFS_LINE, 6)
    date, clock, level, component, content = (_item("__g", i) for i in (0, 1, 3, 4, 5))
    yy = F.substring(date, 1, 2).try_cast("int")
    # Two-digit years: 69-99 are 19xx, 00-68 are 20xx.
    year = F.when(yy >= 69, yy + 1900).otherwise(yy + 2000).cast("string")
    stamp = F.try_to_timestamp(F.concat(year, F.substring(date, 3, 4), clock), F.lit("yyyyMMddHHmmss"))
    staged = staged.withColumn("__ms", F.unix_millis(stamp))
    event = _raw(
        ts_ms=F.col("__ms"),
        source=F.substring_index(F.trim(component), "$", 1),
        event=level_event(level),
        ip=F.coalesce(first_ipv4(content), F.lit("10.0.0.0")),
        user="unknown",
        message=content,
        log_format="hdfs",
        origin="replay:hdfs",
    )
    return settled(staged, "parsed", F.when(F.col("__ms").isNotNull(), event)).drop("__g", "__ms")


def parse_openssh(
    df: DataFrame, col: str = "value", year: int = OPENSSH_CORPUS_YEAR, ipv6: bool = True
) -> DataFrame:
    staged = with_groups(df, "__g", F.col(col), OPENSSH_LINE, 6)
    month, day, clock, host, tag, content = (_item("__g", i) for i in range(6))
    stamp = clock_timestamp(F.lit(year), month_number(month), day, clock)
    staged = staged.withColumn("__ms", F.unix_millis(stamp))
    staged = with_sshd_auth(staged, tag, content, "__auth", ipv6)
    generic = F.when(F.lower(content).contains("break-in attempt"), "log_warning").otherwise("log_info")
    event = _raw(
        ts_ms=F.col("__ms"),
        source=host,
        event=F.coalesce("__auth.event", generic),
        ip=F.coalesce("__auth.ip", F.lit("127.0.0.1")),
        user=F.coalesce("__auth.user", F.lit("unknown")),
        message=content,
        log_format="rfc3164",
        origin="replay:openssh",
    )
    return settled(staged, "parsed", F.when(F.col("__ms").isNotNull(), event)).drop("__g", "__ms", "__auth")


def parse_syslog_file(
    df: DataFrame, default_year: Column, received_ms: Column, file_name: Column, col: str = "value"
) -> DataFrame:
    """Lines of a BSD syslog file. Only a blank line gives no event: one that does not match the
    format keeps its whole text, with the file as its source."""
    line = F.col(col)
    staged = with_groups(df, "__g", line, SYSLOG_FILE_LINE, 7)
    month, day, clock, host, tag, pid, msg = (_item("__g", i) for i in range(7))
    stamp = clock_timestamp(default_year, month_number(month), day, clock)
    framed = F.when(pid != "", F.concat(tag, F.lit("["), pid, F.lit("]: "), msg)).otherwise(
        F.concat(tag, F.lit(": "), msg)
    )
    staged = staged.withColumns({"__ms": F.unix_millis(stamp), "__message": F.coalesce(framed, line)})
    staged = with_groups(staged, "__su", msg, SUCCESSFUL_SU, 2, tag == "su")
    staged = staged.withColumn("__actor", service_actor(_item("__su", 0), _item("__su", 1)))
    message, actor = F.col("__message"), F.col("__actor")
    event = _raw(
        ts_ms=F.coalesce("__ms", received_ms),
        source=F.coalesce(host, file_name),
        event=F.when(actor.isNotNull(), "privilege_escalation").otherwise(keyword_level(message)),
        ip=F.coalesce(first_ipv4(message, strict=False), F.lit("127.0.0.1")),
        user=F.coalesce(actor, F.lit("unknown")),
        message=message,
        log_format="syslog",
        origin="file",
    )
    return settled(staged, "parsed", F.when(line.rlike(r"(?U)\S"), event)).drop(
        "__g", "__ms", "__message", "__su", "__actor"
    )


def parse_syslog(
    df: DataFrame,
    payload: str,
    peer: Column,
    default_year: Column,
    received_ms: Column,
    trusted_peers: tuple[str, ...] = (),
    formats: tuple[str, ...] = SYSLOG_FORMATS,
    ipv6: bool = True,
) -> DataFrame:
    """Syslog payloads: RFC 5424, else RFC 3164, else kept whole as ``raw``.

    The sshd actor of a message is taken over only from a listed loopback peer, and from RFC 5424 only
    when the structured data is "-". The peer itself is always kept.
    """
    staged = df.withColumn("__text", stripped(F.col(payload))).withColumn("__peer", peer)
    text = F.col("__text")
    new = F.lit("rfc5424" in formats)
    staged = with_groups(staged, "__n", text, RFC5424_LINE, 8, new & text.startswith("<"))
    old = F.lit("rfc3164" in formats) & F.col("__n").isNull()
    staged = with_groups(staged, "__o", text, RFC3164_LINE, 6, old & text.startswith("<"))
    rest3164 = _item("__o", 5)
    staged = with_groups(staged, "__t", rest3164, SYSLOG_TAG, 3)

    is_new, is_old = F.col("__n").isNotNull(), F.col("__o").isNotNull()
    pri = F.coalesce(_item("__n", 0), _item("__o", 0)).try_cast("int")
    iso = _item("__n", 2)
    month, day, clock = (_item("__o", i) for i in (1, 2, 3))
    app = F.when(_item("__n", 4) == "-", pri_facility(pri)).otherwise(_item("__n", 4))
    rest = _item("__n", 7)
    tag, pid, msg = (_item("__t", i) for i in range(3))
    framed = F.when(pid != "", F.concat(tag, F.lit("["), pid, F.lit("]: "), msg)).otherwise(
        F.concat(tag, F.lit(": "), msg)
    )
    host = F.when(_item("__n", 3) == "-", F.col("__peer")).otherwise(_item("__n", 3))
    plain = F.when(rest.startswith("- "), F.substring(rest, F.lit(3), F.length(rest)))
    stamp = F.coalesce(
        F.when(iso.rlike(r"^\d{4}-?\d{2}-?\d{2}"), F.try_to_timestamp(iso)),
        clock_timestamp(default_year, month_number(month), day, clock),
    )
    staged = settled(staged, "__ms", F.coalesce(F.unix_millis(stamp), received_ms))
    staged = staged.withColumns(
        {
            "__app": app,
            "__event": F.coalesce(severity_event(pri_severity(pri)), F.lit("log_info")),
            "__source": F.coalesce(host, _item("__o", 4), F.col("__peer")),
        }
    ).withColumns(
        {
            "__message": F.when(is_new & (rest != ""), F.concat("__app", F.lit(": "), rest))
            .when(is_new, F.col("__app"))
            .when(is_old, F.coalesce(framed, rest3164))
            .otherwise(text),
            "__tag": F.when(is_new, F.col("__app")).otherwise(tag),
            "__body": F.when(is_new, plain).otherwise(msg),
        }
    )
    if trusted_peers:
        trusted = F.col("__peer").isin(*loopback_among(trusted_peers))
        staged = with_sshd_auth(staged, F.when(trusted, F.col("__tag")), F.col("__body"), "__auth", ipv6)
    else:
        staged = staged.withColumn("__auth", F.lit(None).cast("struct<event:string,ip:string,user:string>"))
    form = F.when(is_new, "rfc5424").when(is_old, "rfc3164").when(F.lit("raw" in formats), "raw")
    event = _raw(
        ts_ms=F.col("__ms"),
        source=F.col("__source"),
        event=F.coalesce("__auth.event", "__event"),
        ip=F.coalesce("__auth.ip", "__peer"),
        user=F.coalesce("__auth.user", F.lit("unknown")),
        message=F.col("__message"),
        log_format=form,
        origin="syslog",
        transport_peer_ip=F.col("__peer"),
    )
    return settled(staged, "parsed", F.when(form.isNotNull(), event)).drop(
        "__text", "__peer", "__n", "__o", "__t", "__ms", "__app", "__event", "__source", "__message",
        "__tag", "__body", "__auth",
    )


LineParser = Callable[[DataFrame], DataFrame]
LINE_PARSERS: dict[str, LineParser] = {"hdfs": parse_hdfs, "openssh": parse_openssh}


def register_parser(name: str, parser: LineParser) -> None:
    """Add a line parser: from a table with ``value`` to one with the struct column ``parsed``."""
    LINE_PARSERS[name] = parser


def split_parsed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects); columns of the line table other than ``value`` are kept with the events."""
    keep = [c for c in df.columns if c not in ("value", "parsed")]
    events = df.where("parsed is not null").select(*keep, "parsed.*")
    return events, df.where("parsed is null").drop("parsed")


def parse_lines(df: DataFrame, parser: str | LineParser, **options) -> tuple[DataFrame, DataFrame]:
    run = LINE_PARSERS[parser] if isinstance(parser, str) else parser
    return split_parsed(partial(run, **options)(df))


def multi_source(*events: DataFrame) -> DataFrame:
    """All sources in one table, each with its own origin."""
    merged = events[0]
    for other in events[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged
