import random

import pytest
from pyspark.sql import functions as F

from logwarden.operators import loop, loop_paths, response, rules


def random_events(seed, n=600, actors=4, span_ms=400_000, hot=True):
    rnd = random.Random(seed)
    kinds = ["failed_login", "normal_traffic", "suspicious_ip", "brute_force", "port_scan"]
    rows = []
    for i in range(n):
        # Half of the rows belong to one address; many share a millisecond.
        actor = 0 if hot and rnd.random() < 0.5 else rnd.randrange(actors)
        ms = rnd.randrange(0, span_ms, 500)
        rows.append((i, f"9.9.9.{actor}", ms, rnd.choices(kinds, [5, 6, 2, 1, 1])[0], rnd.choice([0, 0, 0, 40])))
    return rows


SCHEMA = "id long, ip string, ingested_ts_ms long, event string, rep_hundredths int"


@pytest.mark.parametrize("slice_windows", [1, 3, 50])
def test_window_counts_with_ties(spark, slice_windows):
    rows = random_events(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = rules.rule_windows(df, slice_windows=slice_windows)
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    for r in got.collect():
        before = [x for x in order if x[1] == r.ip and (x[2], x[0]) <= (r.ingested_ts_ms, r.id)]
        assert r.failed_attempts_count == sum(x[3] == "failed_login" and x[2] > r.ingested_ts_ms - 60_000 for x in before)
        assert r.request_frequency == sum(x[2] > r.ingested_ts_ms - 30_000 for x in before)
    assert got.count() == len(rows)


def test_dropped_rows_leave_windows(spark):
    df = spark.createDataFrame(
        [(1, "a", 0, "failed_login", True), (2, "a", 10, "failed_login", False)],
        "id long, ip string, ingested_ts_ms long, event string, dropped boolean",
    )
    assert {r.id: r.request_frequency for r in rules.rule_windows(df).collect()}[2] == 1


def test_score_tiers(spark):
    df = spark.createDataFrame(
        [(1, "a", "failed_login", 5, 8), (2, "a", "brute_force", 2, 16), (3, "a", "auth_invalid_user", 0, 0)],
        "id long, ip string, event string, failed_attempts_count long, request_frequency long",
    )
    rows = {r.id: r for r in rules.score_rules(df, rules={}).collect()}
    assert (rows[1].score_hundredths, rows[1].is_anomaly) == (40, False)
    assert (rows[2].anomaly_score, rows[2].is_anomaly) == (0.65, True)
    assert rows[2].explanation == "High-risk event: brute force + 16 events from a in 30s"
    assert rows[3].reasons == ["No rule matched"]


@pytest.mark.parametrize("chunk", [1, 2, 64])
def test_cooldown_is_greedy(spark, chunk):
    rows = random_events(2, n=500, span_ms=1_500_000)
    df = spark.createDataFrame(rows, SCHEMA)
    got = rules.apply_cooldown(df, keys=("ip", "event"), chunk_cooldowns=chunk)
    last, want = {}, set()
    for i, ip, ms, event, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if (ip, event) not in last or ms - last[ip, event] >= 60_000:
            last[ip, event] = ms
            want.add(i)
    assert {r.id for r in got.collect()} == want


def test_registered_rules_are_arguments(spark):
    df = spark.createDataFrame([(1, "10.0.0.1", "log_info", 0, 0), (2, "10.0.0.2", "log_info", 0, 0)], "id int, ip string, event string, failed_attempts_count int, request_frequency int")
    extra = rules.register_rule({}, "Second host", F.col("ip") == "10.0.0.2", 45)
    got = {r.id: (r.score_hundredths, r.reasons, r.is_anomaly) for r in rules.score_rules(df, rules=extra).collect()}
    assert got == {1: (0, ["No rule matched"], False), 2: (45, ["Second host"], True)}
    assert {r.score_hundredths for r in rules.score_rules(df).collect()} == {0}


def test_cooldown_resets(spark):
    df = spark.createDataFrame([(1, "a", 0, "x", 0), (2, "a", 1000, "x", 0), (3, "a", 3000, "x", 0)], SCHEMA)
    resets = spark.createDataFrame([("a", 2000)], "ip string, ingested_ts_ms long")
    got = rules.apply_cooldown(df, keys=("ip", "event"), resets=resets)
    assert {r.id for r in got.collect()} == {1, 3}


def sequential(rows, ttls, unblocks=(), params=loop.DEFAULT_PARAMS):
    """The loop event by event, with plain lists."""
    weights = {"brute_force": 45, "port_scan": 35, "suspicious_ip": 35}
    kept, last, until, out = {}, {}, {}, {}
    stream = [(ms, i, "event", ip, e, rep) for i, ip, ms, e, rep in rows]
    stream += [(ms, i, "unblock", ip, None, 0) for ip, ms, i in unblocks]
    for ms, i, kind, ip, event, rep in sorted(stream):
        if kind == "unblock":
            if ip in until:
                del until[ip]
                last = {k: v for k, v in last.items() if k[0] != ip}
            continue
        if until.get(ip, -1) > ms:
            out[i] = (True, False, 0, 0, 0)
            continue
        seen = kept.setdefault(ip, [])
        seen.append((ms, event))
        failed = sum(e == "failed_login" and t > ms - params["failed_seconds"] * 1000 for t, e in seen)
        freq = sum(t > ms - params["frequency_seconds"] * 1000 for t, _ in seen)
        score = rep + weights.get(event, 0)
        score += 40 if failed >= 5 else 20 if failed >= 3 else 0
        score += 20 if freq > 15 else 10 if freq > 8 else 0
        score = min(100, score)
        alert = score >= 45 and not (
            (ip, event) in last and last[ip, event] > ms - params["cooldown_seconds"] * 1000
        )
        if alert:
            last[ip, event] = ms
            ttl = ttls.get(event)
            if ttl:
                until[ip] = max(until.get(ip, 0), ms + ttl * 1000)
        out[i] = (False, alert, failed, freq, score)
    return out


def short_policy(spark):
    block = [("block_ip", True, 45, "r", None)]
    return response.policy_table(
        spark,
        [("b", "brute_force", "P1", block), ("s", "suspicious_ip", "P1", [("block_ip", True, 20, "r", None)]),
         ("d", "*", "P3", [("notify", False, None, None, "x")])],
    )


@pytest.mark.parametrize("seed, wave_rows, span_ms", [(3, 10**6, 400_000), (4, 40, 3_000_000), (5, 15, 20_000_000)])
def test_loop_matches_sequential_replay(spark, seed, wave_rows, span_ms):
    rows = random_events(seed, span_ms=span_ms)
    unblocks = [("9.9.9.0", span_ms // 3, -1), ("9.9.9.1", span_ms // 2, 10**6)]
    df = spark.createDataFrame(rows, SCHEMA)
    lifted = spark.createDataFrame(unblocks, "ip string, ingested_ts_ms long, id long")
    got = loop.closed_loop(df, short_policy(spark), unblocks=lifted, wave_rows=wave_rows)
    want = sequential(rows, {"brute_force": 45, "suspicious_ip": 20}, unblocks)
    result = {
        r.id: (r.dropped, r.alerted, r.failed_attempts_count, r.request_frequency, r.score_hundredths)
        for r in got.collect()
    }
    assert result == want


@pytest.mark.parametrize("seed, chunk_rows, span_ms", [(13, 1 << 16, 700_000), (14, 5, 3_000_000), (15, 40, 9_000_000)])
def test_loop_paths_match_sequential_replay(spark, monkeypatch, seed, chunk_rows, span_ms):
    rows = [(i, ip if i % 2 else "9.9.9.0", ms, e, rep) for i, ip, ms, e, rep in random_events(seed, n=900, span_ms=span_ms)]
    ttls = {"brute_force": 90, "suspicious_ip": 60}
    steps = {e: [("block_ip", True, ttl, "r", None)] for e, ttl in ttls.items()}
    policy = response.policy_table(spark, [("b", e, "P1", s) for e, s in steps.items()] + [("d", "*", "P3", [("notify", False, None, None, "x")])])
    monkeypatch.setattr(loop_paths.closed_loop_by_paths, "__defaults__", (chunk_rows,))
    got = loop.closed_loop(spark.createDataFrame(rows, SCHEMA).repartition(3), policy)
    result = {r.id: (r.dropped, r.alerted, r.failed_attempts_count, r.request_frequency, r.score_hundredths) for r in got.collect()}
    assert result == sequential(rows, ttls)
    assert any(r[0] for r in result.values()) and any(r[1] for r in result.values())


def test_eleven_brute_force_events(spark):
    rows = [(i, "203.0.113.5", i, "brute_force", 0) for i in range(11)] + [(99, "198.51.100.1", 50, "normal_traffic", 0)]
    got = loop.closed_loop(spark.createDataFrame(rows, SCHEMA), response.policy_table(spark)).cache()
    assert got.where("alerted").count() == 1
    assert got.where("dropped").count() == 10
    assert not got.where("id = 99").first().dropped
    hits = response.block_hits(got, loop.block_intervals(got)).first()
    assert (hits.hits, hits.last_hit_ms) == (10, 10)


def test_harmless_hot_address_is_not_folded(spark):
    rows = [(i, "127.0.0.1", i * 10_000, "log_info", 0) for i in range(300)]
    got = loop.closed_loop(spark.createDataFrame(rows, SCHEMA), response.policy_table(spark))
    assert got.where("alerted or dropped").count() == 0
    assert got.agg(F.max("request_frequency")).first()[0] == 3


def test_reblock_keeps_longer_expiry(spark):
    facts = spark.createDataFrame(
        [("a", 1, 0, 7200, "long", 1), ("a", 2, 1000, 900, "short", 2), ("b", 3, 0, 0, "bad", 3)],
        "ip string, seq long, created_ms long, ttl_seconds long, reason string, alert_id long",
    )
    row, = response.build_blocklist(facts).collect()
    assert (row.ip, row.reason, row.alert_id, row.created_ms, row.expires_ms) == ("a", "short", 2, 0, 7_200_000)


def test_status_lattice(spark):
    steps = [
        (1, "block_ip", True, "executed"), (1, "incident_report", True, "failed"),
        (2, "block_ip", True, "executed"), (2, "webhook", False, "failed"),
        (3, "notify", False, "executed"), (4, "webhook", False, "skipped"),
        (5, "block_ip", True, "skipped"), (5, "notify", False, "executed"),
    ]
    df = spark.createDataFrame(steps, "execution_id long, action string, required boolean, status string")
    got = {r.execution_id: r.status for r in response.response_status(df).collect()}
    assert got == {1: "action_failed", 2: "contained", 3: "open", 4: "open", 5: "mitigated"}


def test_review_refuses_invalid_edges(spark):
    rows = [(1, 1, "closed"), (1, 2, "investigating"), (1, 3, "closed"), (1, 4, "closed"), (1, 5, "investigating"), (2, 6, "new")]
    steps = response.review_steps(spark.createDataFrame(rows, "alert_id long, id long, target string"), width=2)
    assert {r.id: r.accepted for r in steps.collect()} == {1: False, 2: True, 3: True, 4: False, 5: True, 6: False}
    state = {r.alert_id: r.review_status for r in response.review_state(steps).collect()}
    assert state == {1: "investigating", 2: "new"}


def test_local_escalation_cites_only_its_trigger(spark):
    events = spark.createDataFrame(
        [(1, "127.0.0.1", "log_info", "file"), (2, "127.0.0.1", "privilege_escalation", "file")]
        + [(i, "8.8.8.8", "log_info", "syslog") for i in range(3, 40)],
        "id long, ip string, event string, origin string",
    )
    alerts = spark.createDataFrame([(10, 2), (11, 30)], "alert_id long, event_id long")
    ledger = events.where("id <> 30").select(F.col("id").alias("event_id"), (F.col("id") + 100).alias("block_id"))
    got = {r.alert_id: r for r in response.incident_evidence(alerts, events, ledger).collect()}
    assert (got[10].event_ids, got[10].evidence_scope, got[10].range_text) == ([2], "triggering_local_event", "102")
    assert got[11].event_ids == list(range(11, 31)) and len(got[11].heights) == 19


def test_hot_address_is_spread_over_time(spark, monkeypatch):
    """Buckets of the numbering and the searches are no wider than the longest effect, so that an address's rows meet in none."""
    from logwarden.operators import loop
    from logwarden.plans.detection import HOT_WINDOW_S, LOOP_PARAMS, test_policy

    seen = {}
    monkeypatch.setattr(loop, "closed_loop_by_paths", lambda rows, columns, params, width_ms: seen.update(width=width_ms) or rows)
    events = spark.createDataFrame([("45.0.0.1", "failed_login", 1, 1)], "ip string, event string, ingested_ts_ms long, id long")
    loop.closed_loop(events, test_policy(spark), params=LOOP_PARAMS | {"failed_seconds": HOT_WINDOW_S, "frequency_seconds": HOT_WINDOW_S})
    assert 0 < seen["width"] <= 3 * 24 * 3600 * 1000
