import random
from collections import OrderedDict

import pytest

from logwarden.operators import blocks, recency


def replay(lines, limit):
    """The table itself: [(position, block, evicted before, lines since)] and the number of evictions."""
    table, gone, seen, evictions = OrderedDict(), set(), [], 0
    for position, names in lines:
        for place, b in enumerate(names):
            back = b in gone
            gone.discard(b)
            table[b] = table.pop(b, 0) + 1
            seen.append((position, place, b, back, table[b]))
        while len(table) > limit:
            b, _ = table.popitem(last=False)
            gone.add(b)
            evictions += 1
    return seen, evictions, len(table)


def log(rng, n, blocks_of):
    return [(i * 3 + 1, rng.sample(range(max(1, i // 9), max(5, i // 9 + blocks_of)), rng.choice([1, 1, 1, 2, 4])) + ([0] if i % 7 == 0 else [])) for i in range(n)]


@pytest.mark.parametrize(("limit", "n", "blocks_of"), [(1, 60, 5), (3, 300, 6), (12, 1500, 40), (400, 300, 6)])
def test_evictions_equal_a_replay(spark, limit, n, blocks_of):
    lines = log(random.Random(limit), n, blocks_of)
    want, evictions, left = replay(lines, limit)
    rows = [(p, i, b, "x") for p, names in lines for i, b in enumerate(names)]
    touches = spark.createDataFrame(rows, "position long, place int, block_id long, t string").drop("t").repartition(5)
    got = blocks.running_counts(recency.tracked(touches, limit, width=64), width=64)
    assert sorted((r.position, r.place, r.block_id, r.evicted, r.lines) for r in got.collect()) == sorted(want)
    counts = recency.eviction_counts(recency.reuse(touches, limit), limit).first()
    assert (counts.evicted, counts.blocks_tracked) == (evictions, left)


def test_no_touches(spark):
    empty = spark.createDataFrame([], "position long, place int, block_id long")
    assert recency.tracked(empty, 3).count() == 0
    assert recency.eviction_counts(recency.reuse(empty, 3), 3).first().evicted == 0


def shuffled_rows(spark, run):
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    stages = lambda: store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    seen = {stages().apply(i).stageId() for i in range(stages().size())}
    run()
    now = stages()
    return sum(now.apply(i).shuffleWriteRecords() for i in range(now.size()) if now.apply(i).stageId() not in seen)


def test_touches_are_shuffled_a_few_times(spark):
    """Each touch goes to its bucket and to its key, its bucket's latest keys besides."""
    touches = spark.range(20000).selectExpr("id AS position", "0 AS place", "CASE WHEN id % 3 = 0 THEN id % 97 ELSE 100 + id DIV 20 END AS block_id")
    rows = shuffled_rows(spark, lambda: recency.tracked(touches, 12).write.format("noop").mode("overwrite").save())
    assert rows < 4 * 20000
    assert "Join" not in recency.tracked(touches, 12)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("limit", [0, 2, 5])
def test_buckets_with_fewer_keys_than_the_table_hand_on_older_ones(spark, limit):
    """A few busy keys for long stretches: what the table holds was touched many buckets ago."""
    lines = [(i, [i // 400 % 4] if i % 399 else [9, 8, None]) for i in range(4000)]
    want, evictions, _ = replay(lines, limit)
    rows = [(p, i, b) for p, names in lines for i, b in enumerate(names)]
    touches = spark.createDataFrame(rows, "position long, place int, block_id long").repartition(5)
    got = blocks.running_counts(recency.tracked(touches, limit, width=64), width=64)
    order = lambda r: r[:2]
    assert sorted(((r.position, r.place, r.block_id, r.evicted, r.lines) for r in got.collect()), key=order) == sorted(want, key=order)
