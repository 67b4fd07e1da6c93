"""Suffix dedup against a brute-force search for repeated byte strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from logwarden.llm import suffix_dedup


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def awkward(seed, length):
    rng = random.Random(seed)
    letters = "abcdé ñ日\n"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    base = [text(rng.randrange(3 * length, 12 * length)) for _ in range(6)]
    out = [None, "", "a", "x" * length, "x" * (5 * length), "ab" * (4 * length), "x" * (length - 1), base[0], base[0], base[1] + base[1]]
    for _ in range(25):
        b = rng.choice(base)
        i = rng.randrange(len(b))
        out.append(text(rng.randrange(length)) + b[i : i + rng.randrange(length - 3, 4 * length)] + text(rng.randrange(length)))
    for _ in range(8):  # near copies
        b = list(base[2])
        for _ in range(3):
            b[rng.randrange(len(b))] = rng.choice(letters)
        out.append("".join(b))
    return out


@pytest.mark.parametrize(("length", "gram", "spans", "seed"), [(40, 8, (16, 4, 1), 1), (24, 3, (1,), 2), (60, 20, (32, 8, 1), 3)])
def test_repeated_bytes_match_brute_force(spark, length, gram, spans, seed):
    texts = awkward(seed, length)
    rows = [(i if i % 7 else None, t, "src", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string, at long").repartition(5)
    found = suffix_dedup.digests(suffix_dedup.repeated_bytes(docs, length=length, gram=gram, spans=spans))
    got = sorted(tuple(r) for r in found.drop("doc_id").collect())
    assert got == sorted(brute(texts, length))
    assert sum(1 for r in found.collect() if r.doc_id is None) == sum(1 for r in rows if r[0] is None)


def test_long_texts_cross_segments_and_empty_tables(spark):
    rng = np.random.default_rng(5)
    data, offsets = rng.integers(97, 123, 5000).astype(np.uint8), np.array([0, 40, 40, 1700, 1750, 5000])
    spread = lambda x: [(int(r), int(f) + i, int(p) + i, int(g)) for r, f, c, p, g in zip(*x) for i in range(int(c))]
    whole = spread(suffix_dedup.anchors(data, offsets, 100, 16))
    assert len(whole) == 1561 + 3151 and spread(suffix_dedup.anchors(data, offsets, 100, 16, segment=700)) == whole
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.digests(suffix_dedup.repeated_bytes(empty)).count() == 0
    with pytest.raises(ValueError, match="spans"):
        suffix_dedup.repeated_starts(empty, spans=(512, 1))


def test_planted_passages_show_in_n_removed_and_never_in_n_bytes(spark):
    rng = random.Random(7)
    prose = lambda n, size: " ".join("".join(rng.choice("abcdeéñ") for _ in range(size)) for _ in range(n))
    texts, passages = [], []
    for i in range(40):  # a passage of over 50 words in two documents: of 400 bytes or more, or fewer
        passage = prose(60, 7) if i % 2 else prose(51, 5)
        assert (len(passage.encode()) >= 400) == bool(i % 2)
        for _ in range(2):
            texts.append(f"{prose(40, 6)} {passage} {prose(40, 6)}")
            passages.append(len(passage.encode()) if i % 2 else 0)
    texts += [prose(140, 6) for _ in range(40)]
    passages += [0] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [tuple(r)[1:] for r in sorted(suffix_dedup.digests(suffix_dedup.repeated_bytes(docs)).collect())]
    assert got == brute(texts, suffix_dedup.LENGTH)
    for text, passage, (n_bytes, n_removed, n_spans, _) in zip(texts, passages, got):
        assert n_bytes == len(text.encode())
        assert n_spans == (passage > 0)
        assert passage <= n_removed <= (passage and passage + 20)
