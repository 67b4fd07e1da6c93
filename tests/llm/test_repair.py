"""Structure repair against a search over whole edit strings."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from logwarden.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def brute(rows):
    """(cost, audit, repaired) of (role, text) rows: the least of all (cost, letters), tried letter by letter."""
    found = faults(rows)

    def goes(state, x):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, x))

    @cache
    def best(i, state, inserts):
        options = []
        if inserts < 3:
            x = "a" if state == "u" else "u"
            cost, letters, made = best(i, x, inserts + 1)
            options.append((cost + 3, "I" + letters, ((x, ""), *made)))
        if i == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            (role, text), fault = rows[i], found[i]
            cost, letters, made = best(i + 1, state, 0)
            options.append((cost + 4, "D" + letters, made))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                for x in "ua":
                    if goes(state, x):
                        cost, letters, made = best(i + 1, x, 0)
                        options.append((cost + 3 + extra, "R" + letters, ((x, text), *made)))
                if goes(state, role[:1]):
                    cost, letters, made = best(i + 1, role[:1], 0)
                    options.append((cost + extra, "K" + letters, ((role, text), *made)))
        return min(options, default=(10**9, "", ()), key=lambda o: o[:2])

    cost, letters, made = best(0, "", 0)
    names = {"u": "user", "a": "assistant"}
    text = "\n".join(f"{names.get(r, r)}:{t}" for r, t in made)
    return cost, letters, hashlib.sha256(text.encode()).hexdigest()


def talk(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "s", "", " "]
    texts = ["Hi.", "Oh!", "so", "  ", "", "What?\n\t", "é。", "end", "ok."]
    return [(rng.choice(roles), rng.choice(texts) + (str(i) + rng.choice(".!x") if rng.random() < 0.7 else "")) for i in range(n)]


@pytest.mark.parametrize("block", [None, 1, 4])
def test_edits_match_brute_force(spark, block):
    rng = random.Random(4)
    talks = {c: talk(rng, rng.randrange(1, 9)) for c in range(60)} | {900: talk(rng, 150), None: talk(rng, 5)}
    rows = [(c, t if t % 5 else None if c == 3 else t, r, x) for c, turns in talks.items() for t, (r, x) in enumerate(turns)]
    rng.shuffle(rows)
    ids = [*rows, (5000, 1, "user", "dropped.")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"blk": F.lit(1), "pos": F.lit("x"), "key": F.lit(None)}).repartition(7)
    got = {r.conv_id: r for r in repair.summary(*repair.plan(docs, block=block), spark.createDataFrame(ids, SCHEMA)).collect()}
    assert set(got) == {*talks, 5000}
    for c, turns in talks.items():
        if c == 3:
            nulls = [t for t in range(len(turns)) if t % 5 == 0]
            continue  # rows without a turn are ordered by role and digest: below
        found = faults(turns)
        assert [getattr(got[c], f) for f in ("blank", "duplicate", "truncated")] == [found.count(f) for f in ("blank", "duplicate", "truncated")], c
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:])]
        assert got[c].illegal == sum(p not in ("su", "ua", "au") for p in pairs), c
        assert (got[c].cost, got[c].audit, got[c].repaired_sha256) == brute(turns), c
        assert got[c].gaps == 0
    assert nulls and got[3].gaps >= 0
    empty = got[5000]
    assert (empty.cost, empty.audit, empty.repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


def test_ties_repeats_and_nulls(spark):
    same = [(1, 2, "user", "a."), (1, 2, "user", "a."), (1, 2, "user", "a."), (1, 7, "assistant", "b."), (2, None, None, None), (3, None, "user", "q.")]
    got = {r.conv_id: r for r in repair.summary(*repair.plan(spark.createDataFrame(same, SCHEMA)), spark.createDataFrame(same, SCHEMA)).collect()}
    assert (got[1].audit, got[1].duplicate, got[1].gaps, got[1].illegal, got[1].cost) == ("KDDK", 2, 4, 2, 8)
    assert (got[2].audit, got[2].blank, got[2].gaps) == ("D", 1, 0)
    assert (got[3].audit, got[3].cost) == ("KI", 3)
    none = spark.createDataFrame([], SCHEMA)
    assert repair.summary(*repair.plan(none), none).count() == 0


def test_damage_follows_the_hash(spark):
    rows = [(c, t, "assistant", f"Yes. No! {t}?") for c in range(12) for t in range(9)] + [(1, None, None, None)]
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            want += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    got = [tuple(r) for r in repair.damaged(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
