"""Brute-force counterparts and awkward rows shared by the tests."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, k: int = 5) -> set[tuple[str, ...]]:
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def groups_of(docs: list[tuple[int, str | None]]) -> dict[int, int]:
    """Smallest reachable doc_id by links of Jaccard similarity 0.8, over all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed: int = 3) -> list[tuple[int, str | None]]:
    """Copies, near copies around a base, a chain of edits, unrelated texts and odd ones."""
    rng = random.Random(seed)
    docs: list[tuple[int, str | None]] = []
    base = prose(rng, 120)
    for i in range(25):  # near the base, not always near each other
        copy = base[:]
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10_000)}"
        docs.append((100 + i, " ".join(copy)))
    chain = prose(rng, 150)
    for i in range(8):
        docs.append((200 + i, " ".join(chain)))
        chain = chain[:]
        chain[rng.randrange(len(chain))] = f"c{i}"
    same = " ".join(prose(rng, 60))
    docs += [(300 + i, same if i % 2 else same.upper().replace(" ", "\t\n ")) for i in range(6)]
    tail = " ".join(prose(rng, 30))
    docs += [(400 + i, " ".join(prose(rng, 80)) + " " + tail) for i in range(20)]
    docs += [(500, None), (501, ""), (502, " \n\t "), (503, "one"), (504, "ONE"), (505, "a b c d"), (506, "a b c d e"), (507, "x " * 5000)]
    return docs
