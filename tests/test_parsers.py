import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from logwarden.fixed_values import RFC5424_LINE
from logwarden.functions import net, text
from logwarden.sources import labels, lines, parsers

RECEIVED = 1_790_000_000_000


def one(spark, run, value, **extra):
    df = spark.createDataFrame([(value, *extra.values())], ["value", *extra])
    return run(df).select("parsed").first()["parsed"]


def year_of(ms):
    return dt.datetime.fromtimestamp(ms / 1000, dt.UTC).year


def test_hdfs_lines(spark):
    line = "081109 203615 148 %s dfs.DataNode$X: Received block blk_123 of size 67108864"
    row = one(spark, parsers.parse_hdfs, line % "INFO")
    assert (year_of(row.ts_ms), row.event, row.ip, row.source) == (2008, "log_info", "10.0.0.0", "dfs.DataNode")
    assert row.message.startswith("Received block blk_123")
    assert one(spark, parsers.parse_hdfs, line % "WARN").event == "log_warning"
    assert one(spark, parsers.parse_hdfs, line % "odd").event == "log_info"
    assert one(spark, parsers.parse_hdfs, "this is not an HDFS line") is None
    assert one(spark, parsers.parse_hdfs, "081399 203615 1 INFO a: b") is None


@pytest.mark.parametrize(
    "body, event, ip, user",
    [
        ("Invalid user printer7 from 198.18.4.21", "auth_invalid_user", "198.18.4.21", "printer7"),
        ("Accepted password for mara from 198.51.100.77 port 40022", "login_success", "198.51.100.77", "mara"),
        ("Accepted password for mara from 198.51.100.77 port 1", "login_success", "198.51.100.77", "mara"),
        ("Accepted password for mara from 198.51.100.77 port 65535", "login_success", "198.51.100.77", "mara"),
        ("Accepted password for mara from 198.51.100.77 port 70000", "log_info", "127.0.0.1", "unknown"),
        ("Failed password for mara from 198.51.100 port 5022 ssh2", "log_info", "127.0.0.1", "unknown"),
        ("Failed password for mara from 198.51.100.077 port 5022 ssh2", "log_info", "127.0.0.1", "unknown"),
        ("Failed password for mara from 198.51.100.7 port 00 ssh2", "log_info", "127.0.0.1", "unknown"),
        ("Failed password for mara from 198.51.100.7 port 5022 ssh2 again", "log_info", "127.0.0.1", "unknown"),
        ("Failed password for invalid user q from 2001:DB8:0:0::7 port 5022", "failed_login", "2001:db8::7", "q"),
        ("Invalid user q from fe80::7%en1", "log_info", "127.0.0.1", "unknown"),
        ("Invalid user q from ::FFFF:198.51.100.7", "auth_invalid_user", "198.51.100.7", "q"),
        ("address of q maps elsewhere, possible Break-In Attempt", "log_warning", "127.0.0.1", "unknown"),
    ],
)
def test_openssh_lines(spark, body, event, ip, user):
    row = one(spark, parsers.parse_openssh, f"Dec 10 06:55:46 bastion4 sshd[713]: {body}")
    assert (row.source, row.event, row.ip, row.user, year_of(row.ts_ms)) == ("bastion4", event, ip, user, 2016)


def syslog(spark, payload, peer, trusted=()):
    return one(
        spark, lambda df: parsers.parse_syslog(df, "value", F.col("peer"), F.lit(2026), F.lit(RECEIVED), trusted), payload, peer=peer
    )


def test_syslog_payloads(spark):
    row = syslog(spark, "<34>Oct 11 22:14:15 mymachine su[1234]: 'su root' failed for lonvick", "192.0.2.10")
    assert (row.log_format, row.event, row.source, row.ip) == ("rfc3164", "log_critical", "mymachine", "192.0.2.10")
    assert row.message == "su[1234]: 'su root' failed for lonvick"
    row = syslog(
        spark,
        '<165>1 2003-10-11T22:14:15.003Z mymachine.example.com evntslog - ID47 [exampleSDID@32473 iut="3"] hello',
        "192.0.2.10",
    )
    assert (row.log_format, row.event, year_of(row.ts_ms), row.ts_ms % 1000) == ("rfc5424", "log_notice", 2003, 3)
    row = syslog(spark, "  just text\nmore  ", "192.0.2.10")
    assert (row.log_format, row.event, row.message) == ("raw", "log_info", "just text\nmore")
    assert row.ts_ms == 1_790_000_000_000


def test_peer_attribution(spark):
    line = "<34>Oct 11 22:14:15 gate2 sshd[31]: Failed password for noor from 198.51.100.9 port 5022 ssh2"
    row = syslog(spark, line, "127.0.0.1", ("127.0.0.1",))
    assert (row.event, row.ip, row.transport_peer_ip) == ("failed_login", "198.51.100.9", "127.0.0.1")
    for peer, trusted in (("127.0.0.1", ()), ("192.0.2.10", ("192.0.2.10",)), ("127.0.0.2", ("127.0.0.1",))):
        row = syslog(spark, line, peer, trusted)
        assert (row.event, row.ip) == ("log_critical", peer)


def test_syslog_file_lines(spark):
    def run(value):
        return one(spark, lambda df: parsers.parse_syslog_file(df, F.lit(2026), F.lit(RECEIVED), F.lit("system.log")), value)

    row = run("Aug  4 21:09:20 harbor9 sshd[62]: Session of 10.4.4.4 ended")
    assert (row.source, row.ip, row.origin) == ("harbor9", "10.4.4.4", "file")
    assert run("Aug  4 21:09:20 harbor9 mailer: delivery failed").event == "log_error"
    assert run("Aug  4 21:09:20 harbor9 mailer: queue empty").event == "log_info"
    row = run("Jan 24 04:37:40 depot1 su[886]: Successful su for noor by www-data")
    assert (row.event, row.user, row.ip) == ("privilege_escalation", "www-data", "127.0.0.1")
    for other in (
        "su[4]: Successful su for www-data by www-data", "su[4]: Successful su for noor by mara",
        "cron[4]: Successful su for noor by www-data", "su[4]: Successful su for noor by www-data again",
    ):
        assert run(f"Jan 24 04:37:40 h {other}").event != "privilege_escalation"
    assert run("   ") is None
    row = run("no header here")
    assert (row.source, row.ts_ms) == ("system.log", 1_790_000_000_000)
    assert run("Feb 30 04:37:40 h app: x").ts_ms == 1_790_000_000_000


def test_a_registered_parser_is_used_by_name(spark):
    parsers.register_parser("shout", lambda df: df.withColumn("parsed", F.when(F.col("value") != "", F.struct(F.upper("value").alias("message")))))
    try:
        events, rejects = parsers.parse_lines(spark.createDataFrame([("quiet",), ("",)], ["value"]), "shout")
        assert [r.message for r in events.collect()] == ["QUIET"] and rejects.count() == 1
    finally:
        del parsers.LINE_PARSERS["shout"]


def test_structured_truth(spark, tmp_path):
    (tmp_path / "truth.csv").write_text('LineId,Content,EventId\n1,"one ""quoted"" word",E1\n2,"two\nlines",E2\n')
    got = labels.load_structured_truth(spark, str(tmp_path / "truth.csv")).collect()
    assert [(r.content, r.event_id) for r in got] == [('one "quoted" word', "E1"), ("two\nlines", "E2")]


def test_first_ipv4_variants(spark):
    df = spark.createDataFrame([("v 999.1.1.1 then 01.2.3.4 then 10.0.0.1",), ("none",)], ["t"])
    rows = df.select(text.first_ipv4(F.col("t")).alias("a"), text.first_ipv4(F.col("t"), strict=False).alias("b")).collect()
    assert [tuple(r) for r in rows] == [("10.0.0.1", "01.2.3.4"), (None, None)]


def test_fill_template(spark):
    df = spark.createDataFrame([("{ip} by {user}", "1.2.3.4", "{ip}"), ("{nope} {ip}", "1.2.3.4", "u")], "t string, ip string, user string")
    got = [r[0] for r in df.select(text.fill_template(F.col("t"), {"ip": F.col("ip"), "user": F.col("user")})).collect()]
    assert got == ["1.2.3.4 by {ip}", "{nope} {ip}"]


def test_scan_lines_over_splits(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"f{f}.log").write_text("".join(f"{f}-{i}\n" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = lines.scan_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 12_000
    assert [r.position for r in lines.scan_lines(spark, str(tmp_path), limit=5).orderBy("position").collect()] == [1, 2, 3, 4, 5]
    for r in rows:
        f, i = (int(x) for x in r.value.split("-"))
        assert (r.line_no, r.position) == (i + 1, f * 4000 + i + 1)


def test_line_label_validation(spark):
    records = [
        '{"line": 1, "labels": ["a"]}', '{"line": true, "labels": ["a"]}', '{"line": 2, "labels": []}',
        '{"line": 99, "labels": ["a"]}', '{"line": 3, "labels": ["a"]}', '{"line": 3, "labels": ["b"]}', "nope",
        '{"line": 4.0, "labels": ["a"]}',
    ]
    parsed = labels.parse_line_labels(spark.createDataFrame([(r,) for r in records], ["value"]))
    good, bad = labels.validate_line_labels(parsed, 10)
    assert [r.line for r in good.collect()] == [1]
    assert sorted(r.violation for r in bad.collect()) == [
        "invalid_json", "labels_invalid", "line_not_integer", "line_not_integer", "line_out_of_range",
        "line_repeated", "line_repeated",
    ]


def test_ipv6_literals_in_the_jvm(spark):
    import ipaddress

    from logwarden.functions import net

    texts = [
        "::1", "::", "2001:DB8::0001", "2001:db8:0:0:1:0:0:1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", "1:0:0:4:0:0:0:8", "0:0:0:0:0:0:0:0",
        "::ffff:192.0.2.7", "::ffff:c000:207", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:1.2.3.4", "fe80::1%eth0", "1:2:3", "1::2::3", "12345::", ":::", "1:2:3:4:5:6:7:8:9",
        "1:2:3:4:5:6:7:8::", "g::", ":1", "1:", "::1.2.3.256", "::01.2.3.4", "", "abc", "1.2.3.4", "::1\n", "0:1:0:1:0:1:0:1", "1:2:3:4:5:6:0:0",
    ]

    def want(text):
        try:
            address = ipaddress.IPv6Address(text)
        except ValueError:
            return None
        return None if address.scope_id else str(address.ipv4_mapped or address)

    rows = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", net.canonical_ipv6(F.col("ip")).alias("got")).collect()
    assert {r.ip: r.got for r in rows} == {t: want(t) for t in texts}


@pytest.mark.parametrize("name", ["hdfs", "openssh", "syslog", "syslog_file"])
def test_source_filters_pass_the_parsers(spark, tmp_path, name):
    lines = spark.range(20).select((F.col("id") % 4).alias("day"), F.concat(F.lit("line "), "id").alias("value"))
    lines.write.partitionBy("day").parquet(str(tmp_path / "lines"))
    df, year, ms = spark.read.parquet(str(tmp_path / "lines")), F.lit(2024), F.lit(0).cast("long")
    parse = {
        "hdfs": parsers.parse_hdfs, "openssh": parsers.parse_openssh,
        "syslog": lambda d: parsers.parse_syslog(d, "value", F.lit("127.0.0.1"), year, ms, ("127.0.0.1",)),
        "syslog_file": lambda d: parsers.parse_syslog_file(d, year, ms, F.lit("f")),
    }[name]
    events, _ = parsers.split_parsed(parse(df))
    plan = events.where("day = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "EvalPython" not in plan


def test_syslog_is_parsed_by_methods_short_enough_to_be_compiled(spark, capsys):
    """The JVM interprets methods of more than 8,000 bytes for good."""
    contract.queries()["parse_syslog_mixed"](spark, "/root/testdata/sf0.001").explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("space", [" ", " ", " ", "\x85", "\t", "\x1c"])
@pytest.mark.parametrize("letter", ["a", "é", "\U0001d7d9"])
def test_groups_of_ascii_and_other_lines_are_those_of_the_whole_pattern(spark, space, letter):
    """Lines in ASCII are read without Unicode classes; both must agree with the pattern as it stands."""
    lines = [f"<34>1{space}2026-01-01T00:00:00Z gate{space}app{letter} - -{space} - {letter} b", f"{space} {letter} \n", f"{letter}{space}", f"{space}{space}", "", None]
    pattern, out = RFC5424_LINE, "\n".join(f"${i}" for i in range(1, 9))
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    df = df.select("value", F.regexp_replace("value", r"(?U)^\s+|\s+\z", "").alias("want"), text.stripped(F.col("value")).alias("got"))
    df = parsers.with_groups(df, "groups", F.col("value"), pattern, 8).withColumn("whole", F.regexp_replace("value", pattern, out))
    for r in df.collect():
        assert r.got == r.want
        assert r.groups == (r.whole.split("\n", 7) if r.value is not None and r.whole != r.value else None)


def test_calendar_parts_that_name_no_time(spark):
    cases = [
        (2024, 2, "29", "10:00:00", True), (2023, 2, "29", "10:00:00", False), (2024, 4, "31", "10:00:00", False), (2024, 1, "1", "24:00:00", False),
        (2024, 1, "1", "23:59:60", False), (2024, 1, "00", "10:00:00", False), (2024, 1, "1", "١٠:00:00", False), (2024, None, "1", "10:00:00", False),
        (0, 1, "1", "10:00:00", True), (10000, 1, "1", "10:00:00", False), (987, 12, "31", "00:00:00", True),
    ]
    df = spark.createDataFrame(cases, "y int, m int, d string, t string, real boolean")
    old = F.format_string("%04d-%02d-%02d %s", "y", "m", F.col("d").cast("int"), "t")
    old = F.when(F.col("m").isNotNull(), F.try_to_timestamp(old, F.lit("yyyy-MM-dd HH:mm:ss")))
    new = text.clock_timestamp(F.col("y"), F.col("m"), F.col("d"), F.col("t"))
    got = df.select("real", F.unix_micros(new).alias("got"), F.unix_micros(old).alias("old")).collect()
    assert [(r.got is not None) == r.real and r.got == r.old for r in got] == [True] * len(cases)


def test_loopback_among_fixed_addresses(spark):
    peers = ("127.0.0.1", "127.255.0.9", "127.0.0.01", "128.0.0.1", "127.0.0.1\n", "::1", "0:0:0:0:0:0:0:1", "x127.0.0.1", "127.0.0.256", "")
    df = spark.createDataFrame([(p,) for p in peers], "ip string")
    assert net.loopback_among(peers) == tuple(r.ip for r in df.where(net.is_loopback(F.col("ip"))).collect())
