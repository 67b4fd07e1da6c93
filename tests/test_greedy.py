import random

import pytest

from logwarden.operators import greedy


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 16])
def test_paths_equal_a_walk(spark, chunk):
    rng = random.Random(chunk)
    rows, want = [], set()
    for grp, n in ((5, 700), (-3, 1), (8, 40), (2**60, 90)):
        ids = sorted(rng.sample(range(1, n * 3 + 2), n))
        nxt = {a: rng.choice(ids[k + 1 : k + 6] or [None]) if rng.random() < 0.995 else None for k, a in enumerate(ids)}
        rows += [(grp, a, b) for a, b in nxt.items()]
        at = ids[0]
        while at is not None:
            want.add((grp, at))
            at = nxt[at]
    rng.shuffle(rows)
    nodes = spark.createDataFrame(rows, "grp long, i long, next long").repartition(5)
    assert {tuple(r) for r in greedy.path(nodes, chunk).collect()} == want
    named = nodes.selectExpr("'g' || grp AS grp", "i", "next")
    assert {tuple(r) for r in greedy.path(named, chunk).collect()} == {(f"g{g}", i) for g, i in want}


def test_next_at_least(spark):
    rng = random.Random(1)
    points = [(rng.randrange(3), i, rng.randrange(400)) for i in range(200)]
    queries = [(rng.randrange(4), i, rng.randrange(420)) for i in range(150)]
    p, q = (spark.createDataFrame(x, "grp long, i long, key long") for x in (points, queries))
    got = {(r.grp, r.i): r.next for r in greedy.next_at_least(p, q, width=32).collect()}
    assert got == {(g, i): min((b for a, b, k in points if a == g and k >= key), default=None) for g, i, key in queries}
    assert greedy.path(p.limit(0).selectExpr("grp", "i", "key AS next")).count() == 0
