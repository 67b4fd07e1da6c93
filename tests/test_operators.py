import ipaddress
import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from logwarden.functions.net import cidr_bounds, ip_scope, ip_to_long, long_to_ip
from logwarden.operators import blocks, metrics, models, ordering, profile, reputation, templates
from logwarden.sources import feeds
from logwarden.streaming import sinks


def test_running_sums_and_carry(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice("ab"), rnd.choice([None, rnd.randrange(9)])) for i in rnd.sample(range(5000), 300)]
    df = spark.createDataFrame(rows, "pos long, k string, v long")
    got = ordering.running_sums(df, "pos", {"s": F.coalesce("v", F.lit(0))}, by=("k",), width=100)
    got = ordering.carry_last(got, "pos", {"prev": F.col("v")}, by=("k",), width=100)
    for r in got.collect():
        before = sorted(x for x in rows if x[1] == r.k and x[0] < r.pos)
        known = [x[2] for x in before if x[2] is not None]
        assert r.s == sum(known) + (r.v or 0)
        assert r.prev == (known[-1] if known else None)
    plain = ordering.with_ordinal(df, "pos", width=50).orderBy("pos").collect()
    assert [r.ordinal for r in plain] == list(range(1, 301))


def test_keyset_page(spark):
    df = spark.range(10).withColumnRenamed("id", "n")
    page, info = ordering.keyset_page(df, "n", 8, 3)
    assert [r.n for r in page.collect()] == [5, 6, 7]
    assert tuple(info.first()) == (True, 5)
    page, info = ordering.keyset_page(df, "n", 2, 3)
    assert [r.n for r in page.collect()] == [0, 1] and tuple(info.first()) == (False, None)


def test_addresses(spark):
    texts = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "255.255.255.255", "a", "::1", ""]
    got = spark.createDataFrame([(t,) for t in texts], ["t"]).select("t", ip_to_long(F.col("t")).alias("v")).collect()
    for r in got:
        try:
            want = int(ipaddress.IPv4Address(r.t))
        except ValueError:
            want = None
        assert r.v == want
    assert spark.range(1).select(long_to_ip(F.lit(3232235777))).first()[0] == "192.168.1.1"


def test_cidr_bounds(spark):
    texts = ["10.1.2.3/8", "1.2.3.4", "1.2.3.4/32", "0.0.0.0/0", "1.2.3.4/33", "1.2.3.0/255.255.255.0", "1.2.3.0/0.0.0.255",
             "x/8", "1.2.3.4/", "::/8"]
    for r in spark.createDataFrame([(t,) for t in texts], ["t"]).select("t", cidr_bounds(F.col("t")).alias("b")).collect():
        try:
            net = ipaddress.IPv4Network(r.t, strict=False)
            want = (int(net.network_address), int(net.broadcast_address))
        except ValueError:
            want = None
        assert (tuple(r.b) if r.b else None) == want, r.t


def test_merge_ranges(spark):
    rnd = random.Random(3)
    nets = [ipaddress.IPv4Network((rnd.choice([rnd.getrandbits(32), rnd.getrandbits(10) << 22]), rnd.randrange(4, 33)), strict=False) for _ in range(200)]
    df = spark.createDataFrame([("f", int(n.network_address), int(n.broadcast_address)) for n in nets], "feed string, lo long, hi long")
    want = []
    for n in sorted(ipaddress.collapse_addresses(nets)):
        lo, hi = int(n.network_address), int(n.broadcast_address)
        if want and want[-1][1] + 1 == lo:
            want[-1][1] = hi
        else:
            want.append([lo, hi])
    got = reputation.merge_ranges(df, keys=("feed",)).orderBy("lo").collect()
    assert [[r.lo, r.hi] for r in got] == want


def classify(spark, ips, fetched):
    specs = feeds.feed_specs(spark).withColumn("min_entries", F.lit(1))
    exact = spark.createDataFrame([("tor_exits", int(ipaddress.IPv4Address("8.8.8.8")))], "feed string, ip_int long")
    ranges = spark.createDataFrame([("firehol_level1", 0x08080000, 0x0808FFFF), ("firehol_level1", 0x0A000000, 0x0AFFFFFF)], "feed string, lo long, hi long")
    counts = spark.createDataFrame([(f, 5) for f in fetched], "feed string, entries long")
    floors = feeds.feed_floor(counts, specs)
    provenance = spark.createDataFrame(list(fetched.items()), "feed string, fetched_at string")
    status = feeds.feed_status(floors, provenance, F.to_timestamp(F.lit("2026-01-03T00:00:00Z")))
    df = spark.createDataFrame([(i,) for i in ips], ["ip"])
    return {r.ip: r for r in reputation.classify_ips(df, exact, ranges, status).collect()}


def test_verdicts(spark):
    both = {"tor_exits": "2026-01-01T00:00:00Z", "firehol_level1": "2026-01-02T00:00:00Z"}
    got = classify(spark, ["8.8.8.8", "8.8.4.4", "10.0.0.1", "9.9.9.9", "2001:db8::1", "nope", "100.64.1.1"], both)
    assert {k: v.rep_verdict for k, v in got.items()} == {
        "8.8.8.8": "tor_exit", "8.8.4.4": "blocklisted", "10.0.0.1": "internal", "9.9.9.9": "unlisted",
        "2001:db8::1": "unsupported", "nope": "unsupported", "100.64.1.1": "non_routable",
    }
    assert got["8.8.8.8"].rep_sources == ["tor_exits", "firehol_level1"] and got["8.8.8.8"].rep_hundredths == 40
    assert got["8.8.8.8"].rep_detail == (
        "Listed in Tor Project bulk exit list (fetched 2026-01-01, 2.0d stale) + FireHOL level1 (fetched 2026-01-02)"
    )
    assert "IPv6" in got["2001:db8::1"].rep_detail and "unparseable" in got["nope"].rep_detail
    assert not got["10.0.0.1"].rep_checked and got["9.9.9.9"].rep_checked
    none = classify(spark, ["9.9.9.9", "10.0.0.1"], {"other": "2026-01-01T00:00:00Z"})
    assert none["9.9.9.9"].rep_verdict == "unavailable" and none["10.0.0.1"].rep_verdict == "internal"


def test_scope_first_match(spark):
    got = spark.createDataFrame([("172.31.255.255",), ("172.32.0.0",), ("198.19.0.1",)], ["ip"]).select(
        ip_scope(ip_to_long(F.col("ip"))).alias("s")
    )
    assert [r.s.scope for r in got.collect()] == ["internal", "global", "non_routable"]


def test_labeled_runs(spark):
    lines = spark.range(1, 11).withColumnRenamed("id", "line")
    flags = metrics.line_flags(
        lines, lines.where("line in (2,3,5,6)"), lines.where("line in (3,9)"), ["line"]
    )
    got = sorted((r.start_line, r.end_line, r.alert_lines) for r in metrics.labeled_runs(flags).collect())
    assert got == [(2, 3, 1), (5, 6, 0)]
    cells = metrics.line_confusion(flags).first()
    assert (cells.tp, cells.fp, cells.fn, cells.tn) == (1, 1, 3, 5)


def test_a_batch_is_recorded_before_the_response(spark, tmp_path):
    seen = []

    def respond(batch, epoch):
        written = spark.read.parquet(f"{tmp_path}/rows/batch_id={epoch}")
        seen.append((epoch, batch.count(), written.count()))

    for i in range(3):  # stopped and started again between files
        spark.range(i * 10, i * 10 + 4).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        sinks.record_batches(source, f"{tmp_path}/rows", f"{tmp_path}/cp", respond).trigger(availableNow=True).start().awaitTermination()
    assert seen == [(0, 4, 4), (1, 4, 4), (2, 4, 4)]
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/rows").collect()) == [i * 10 + j for i in range(3) for j in range(4)]


def test_labels_fail_loudly(spark):
    lines, stray = spark.range(1, 4).withColumnRenamed("id", "line"), spark.createDataFrame([(2,), (9,)], "line long")
    assert [(r.line, r.violation) for r in metrics.unparsed_labels(lines, stray, ["line"]).collect()] == [(9, "line_not_parsed")]
    with pytest.raises(Exception, match="unparsed line: 9"):
        metrics.line_confusion(metrics.line_flags(lines, stray, stray.limit(0), ["line"])).collect()
    cells = metrics.line_confusion(metrics.line_flags(lines, None, stray.where("line = 2"), ["line"])).first()
    assert (cells.rows, cells.tp, cells.fp, cells.fn, cells.tn, cells.recall) == (3, None, None, None, None, None)


def test_isolation_ranks_planted_outliers_first(spark):
    rnd = random.Random(3)
    rows = [(f"b{i}", [rnd.gauss(5, 1), rnd.gauss(3, 1), float(rnd.randrange(2))]) for i in range(600)]
    rows += [(f"odd{i}", [40.0 + i, -30.0 - i, 9.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "block_id string, v array<double>").select("block_id", array_to_vector("v").alias("features"))
    forest = blocks.fit_isolation(df)
    assert forest.count() == 100 and {r.size for r in forest.select("size").collect()} == {256}
    scored = blocks.score_isolation(df, forest).orderBy(F.desc("isolation_score")).limit(6)
    assert {r.block_id for r in scored.collect()} == {f"odd{i}" for i in range(6)}


def test_partial_scores_end_at_the_fitted_model(spark):
    rnd = random.Random(9)
    lines = [(f"b{b}", b * 100 + j, f"t{rnd.randrange(20)}" if b % 3 else f"t{rnd.randrange(3)}") for b in range(60) for j in range(rnd.randrange(5, 30))]
    matched = spark.createDataFrame(lines, "block_id string, position long, template_id string")
    counts = blocks.block_counts(matched)
    vocab = blocks.vocabulary(counts)
    vectors = blocks.to_vectors(counts, vocab).withColumn("label", (F.substring("block_id", 2, 3).cast("int") % 3 == 0).cast("int"))
    assert vectors.first().features.size == vocab.count() == 20
    model = models.fit_logistic(vectors)
    weights = blocks.model_weights(vocab, list(model.coefficients))
    live = blocks.partial_block_scores(matched.join(vocab, "template_id"), model.intercept, weights)
    last = live.groupBy("block_id").agg(F.max_by("probability", "position").alias("p"))
    whole = models.predict(model, vectors).select("block_id", "score")
    assert last.join(whole, "block_id").where("abs(p - score) > 1e-3").count() == 0
    with pytest.raises(ValueError):
        blocks.model_weights(vocab, [0.0])


def test_a_tree_grows_as_deep_as_its_rule(spark):
    rows = [(float(i), i // 3 % 2) for i in range(75)]
    df = spark.createDataFrame(rows, "x double, label int").select(array_to_vector(F.array("x")).alias("features"), "label")
    assert models.predict(models.fit_tree(df), df).where("predicted <> label").count() == 0


def test_undefined_ratios(spark):
    df = spark.createDataFrame([(0, 0)], "y int, p int")
    assert metrics.confusion(df, "y", "p").first().precision is None
    assert metrics.confusion(df, "y", "p", undefined="zero").first().precision == 0.0
    assert metrics.roc_auc(df.select("y", F.lit(0.5).alias("s")), "y", "s").first().roc_auc is None


def test_roc_auc(spark):
    rnd = random.Random(5)
    rows = [(rnd.randrange(2), rnd.randrange(40) / 7) for _ in range(500)]
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = metrics.roc_auc(spark.createDataFrame(rows, "y int, s double"), "y", "s", bins=8).first().roc_auc
    assert got == pytest.approx(want, abs=1e-4)


def test_vector_overlap(spark):
    rows = [("a", "train", 0), ("a", "train", 1), ("b", "train", 0), ("a", "test", 1), ("b", "test", 0), ("c", "test", 1), ("c", "test", 0)]
    got = blocks.vector_overlap(spark.createDataFrame(rows, "vec string, side string, label int")).first()
    assert tuple(got) == (3, 2, 3, 2, 1, 1)


def test_stratified_split_is_frozen_and_even(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("block_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    split = blocks.stratified_split(df)
    counts = {(r.label, r.side): r["count"] for r in split.groupBy("label", "side").count().collect()}
    assert counts == {(0, "train"): 450, (0, "test"): 450, (1, "train"): 50, (1, "test"): 50}
    again = blocks.stratified_split(df.repartition(7))
    assert split.exceptAll(again).count() == 0


LOG = [
    "Receiving block blk_1 src 10.0.0.1:50010", "Receiving block blk_2 src 10.0.0.2:50010",
    "job alpha finished well today", "job beta finished well today", "job gamma failed never again",
    "Verification succeeded for blk_3", "eth0 link up", "eth1 link up",
]


def drain(lines, similarity=0.4):
    """Templates of lines that share a leaf, one line after the other."""
    found = []
    for line in dict.fromkeys(lines):
        words = line.split()
        ranks = [(sum(a == b and a != "<*>" for a, b in zip(t, words)) / len(words), t.count("<*>"), -i) for i, t in enumerate(found)]
        best = max(ranks, default=(0, 0, 0))
        if not ranks or best[0] < similarity:
            found.append(words)
        else:
            found[-best[2]] = [a if a == b else "<*>" for a, b in zip(found[-best[2]], words)]
    return {" ".join(t) for t in found}


@pytest.mark.parametrize("parts", [1, 5])
def test_mining_follows_the_order_of_lines(spark, parts):
    words = ["red", "blue", "green", "gold", "grey", "pink", "teal"]
    lines = [f"unit {words[i % 7]} {words[i % 5]} {words[i // 3 % 7]} {words[i * i % 7]} done" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(lines)), "position long, content string").repartition(parts)
    assert {" ".join(r.tokens) for r in templates.mine_templates(df).collect()} == drain(lines)
    finer = templates.mine_templates(df, prefix=2).collect()
    assert {" ".join(r.tokens) for r in finer} == {t for w in words for t in drain([x for x in lines if x.split()[1] == w])}


def test_mining_in_parts(spark):
    rnd = random.Random(12)
    kinds = ["open file {} for user {} now", "close file {} of user {} again", "{} joined room {} late", "lost link to {} after {} tries"]
    lines = [rnd.choice(kinds).format(f"n{rnd.randrange(300)}x", f"m{rnd.randrange(300)}x") for _ in range(900)]
    want = {k.format("<*>", "<*>") for k in kinds}
    results = set()
    for parts, digits in ((1, 2), (7, 2), (3, 3), (2, 0)):
        df = spark.createDataFrame(list(enumerate(lines)), "position long, content string").repartition(parts)
        mined = templates.mine_templates(df, digits=digits)
        results.add(tuple(sorted((r.template_id, " ".join(r.tokens), r.first_pos, r.lines) for r in mined.collect())))
    assert len(results) == 1
    (only,) = results
    assert {r[1] for r in only} == want and sum(r[3] for r in only) == 900
    matched = templates.match_templates(df.unionByName(spark.createDataFrame([(900, "nothing like it"), (901, "")], df.schema)), mined)
    ids = {r[1]: r[0] for r in only}
    for r in matched.collect():
        shape = next((t for t in want if all(a in (b, "<*>") for a, b in zip(t.split(), r.content.split(), strict=False)) and len(t.split()) == len(r.content.split())), None)
        assert r.template_id == ids.get(shape), r.content


def test_template_mining(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LOG)], "position long, content string")
    mined = templates.mine_templates(df).orderBy("template_id").collect()
    texts = [" ".join(r.tokens) for r in mined]
    assert "Receiving block <BLK> src <IP>" in texts
    assert "job <*> finished well today" in texts
    assert "<*> link up" in texts
    assert sum(r.lines for r in mined) == len(LOG)
    matched = templates.match_templates(
        spark.createDataFrame([("job delta finished well today",), ("never seen",), ("Verification succeeded for blk_9",)], ["content"]),
        templates.mine_templates(df),
    )
    got = {r.content: r.template_id for r in matched.collect()}
    assert got["never seen"] is None and got["job delta finished well today"] and got["Verification succeeded for blk_9"]


def test_profile(spark):
    base = spark.createDataFrame([(0, float(f), 0.0) for f in (1, 2, 2, 3, 3, 4, 5)], "failed_attempts_count int, request_frequency double, ip_reputation_score double")
    fitted = profile.fit_profile(base)
    row = fitted.first()
    assert (row.center_request_frequency, row.scale_ip_reputation_score, row.normal_windows) == (3.0, 0.05, 7)
    probe = spark.createDataFrame(
        [(0, 3.0, 0.0), (0, 20.0, 0.0), (0, float("nan"), 0.0), (0, 3.0, 1.5)],
        "failed_attempts_count int, request_frequency double, ip_reputation_score double",
    )
    got = profile.score_profile(probe, fitted).collect()
    assert [(r.shadow_status, r.shadow_anomaly) for r in got] == [
        ("scored", False), ("scored", True), ("unavailable", None), ("unavailable", None)
    ]
    assert got[1].shadow_top_feature == "request_frequency"
    assert profile.score_profile(probe, None).first().shadow_reason == "profile_missing"


def test_stream_sinks(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i * 1000 + j, "ab"[j % 2]) for j in range(5)], "ingested_ts_ms long, event string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema("ingested_ts_ms long, event string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        sinks.count_batches(source, str(tmp_path / "counts"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r.name: r.value for r in sinks.lifetime_totals(spark, str(tmp_path / "counts")).collect()}
    assert got == {"a": 9, "b": 6}
    sinks.write_events(spark.createDataFrame([(0, "x")], "ingested_ts_ms long, event string"), str(tmp_path / "ev"))
    assert spark.read.parquet(str(tmp_path / "ev")).first().event == "x"
    buckets = sinks.rate_by_bucket(source, seconds=1)
    buckets.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {r.start_ms: r.events for r in spark.table("rates").collect()} == {0: 5, 1000: 5, 2000: 5}
