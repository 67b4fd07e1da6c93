"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        saved[p] = own + sum(saved[x] for x in children[p])
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(ends[p])) for p, m in members.items()
    )


def rows_of(nodes):
    return sorted((r.m, r.d, r.parent, r.n_convs, r.n_children, r.n_leaves, r.saved, r.ends) for r in nodes.collect())


def table_of(spark, paths):
    rows = [(c, d + 1, r, t) for c, p in paths.items() for d, (r, t) in enumerate(p)]
    df = spark.createDataFrame(rows, "c long, d long, role string, text string")
    return df.select("c", "d", F.unhex(F.md5(F.concat("role", F.lit("\x00"), "text"))).alias("same"), F.length("text").cast("long").alias("size"))


def shapes():
    rng = random.Random(8)
    turn = lambda i: ("user" if i % 2 else "assistant", f"té{i}" * (i % 4))
    bushy = {c: tuple(turn(rng.randrange(3)) for _ in range(rng.randrange(6))) for c in range(-5, 60)}
    chain = {7: tuple(turn(i) for i in range(90)), 3: tuple(turn(i) for i in range(40)), 8: (), 9: ()}
    comb = {c: tuple(turn(i) for i in range(c)) + (("user", f"x{c}"),) for c in range(1, 25)}
    return [bushy, chain, comb, {1: ()}]


@pytest.mark.parametrize("fit", [1, 5, 4096])
@pytest.mark.parametrize("shape", range(4))
def test_trie_matches_brute_force(spark, fit, shape):
    if fit == 1 and shape < 1:
        pytest.skip("one small bound on the deep shapes is enough")
    paths = shapes()[shape]
    ids = spark.createDataFrame([(c,) for c in paths], "c long")
    assert rows_of(prefix_trie.trie(table_of(spark, paths), ids, fit)) == brute(paths)


def test_conversations_with_nulls_ties_and_repeats(spark):
    rng = random.Random(3)
    talks = {c: [(t, rng.choice(["user", None, "a"]), rng.choice(["x", None, "yé"])) for t in range(rng.randrange(1, 9))] for c in [0, 1, 2, 50, 99, 107, 205, 300, 301]}
    talks[2] = [(None, "user", "first"), (0, "a", "b"), (0, "a", "b"), (1, "a", "b")]
    rows = [(c, t, r, x) for c, turns in talks.items() for t, r, x in turns] + [(None, 0, "user", "no id")]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("c", F.lit("clash")).withColumn("m", F.lit(1)).repartition(5)
    own = {c: [(r or "", x or "") for _, r, x in sorted(v, key=lambda y: (y[0] is not None, y[0] or 0))] for c, v in talks.items()}
    paths = {}
    for c in talks:
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    placed = prefix_trie.ordered_turns(turns)
    ids = placed.select("c").distinct()
    assert rows_of(prefix_trie.trie(prefix_trie.rebuilt(placed, ids), ids)) == brute(paths)
    none = prefix_trie.ordered_turns(turns.limit(0))
    assert rows_of(prefix_trie.trie(prefix_trie.rebuilt(none, none.select("c")), none.select("c"))) == []


def test_decomposition_sums_subtrees():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 700):
        parent = np.array([-1 if i == 0 or rng.random() < 0.02 else int(rng.integers(max(0, i - 5), i)) for i in range(n)])
        leaf, saved = rng.integers(0, 2, n), rng.integers(0, 100, n)
        below, want = np.ones(n, np.int64), np.stack((leaf, saved), 1)
        for i in range(n - 1, 0, -1):
            if parent[i] >= 0:
                below[parent[i]] += below[i]
                want[parent[i]] += want[i]
        zero = lambda: np.zeros(n, np.int64)
        leaves, total = prefix_trie.decompose(parent.copy(), below, leaf, saved, zero(), zero())
        assert (np.stack((leaves, total), 1) == want).all()
