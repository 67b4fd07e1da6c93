import random

import pytest

from logwarden.operators import response, sweep


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 3), (3, 16)])
def test_points_meet_the_furthest_end(spark, seed, parts):
    rng = random.Random(seed)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    groups = ["hot"] * 6 + ["a", "b", "c", None]
    points = [(rng.choice(groups), rng.randrange(300), rng.randrange(4)) for _ in range(700)] + [("hot", 77, 1)] * 200
    starts = [(rng.choice(groups), rng.randrange(300), rng.randrange(4), rng.randrange(400)) for _ in range(60)]
    p = spark.createDataFrame(points, "grp string, at long, seq long").repartition(4)
    s = spark.createDataFrame(starts, "grp string, at long, seq long, end long")
    want = [(g, a, q, max((e for h, b, r, e in starts if h == g and (b, r) <= (a, q)), default=None)) for g, a, q in points if g]
    try:
        got = [tuple(r) for r in sweep.reach_of(p, s).collect()]
        inside = sweep.covered(p, s, inclusive=True).count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert inside == sum(e is not None and e >= a for _, a, _, e in want)
    assert sweep.reach_of(p.limit(0), s).count() == 0


def test_blocks_begin_after_their_alert(spark):
    events = spark.createDataFrame([(1, "a", 10), (2, "a", 10), (3, "a", 10), (4, "a", 19), (5, "a", 20), (6, "b", 15), (7, None, 15)], "id long, ip string, ingested_ts_ms long")
    blocks = spark.createDataFrame([("a", 2, 10, 20), ("a", 1, 12, 13), ("b", 9, 16, 16)], "ip string, alert_id long, start_ms long, expires_ms long")
    assert {r.id for r in response.mark_blocked(events, blocks).where("blocked").collect()} == {3, 4}
    hit = response.block_hits(events, blocks).collect()
    assert [tuple(r) for r in hit] == [("a", 2, 19)]
