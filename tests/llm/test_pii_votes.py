"""The votes of the personal-data labelers: secrets, and expectation-maximisation against a span-by-span version."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from logwarden.llm import pii


def test_secrets_are_added_by_votes(spark):
    rng = random.Random(9)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    texts = [f'before token = "{h}" after' for h in hexes[:20]] + [f"api_key: {h}" for h in hexes[20:]]
    texts += [f"a plain word {'x' * 40} and chapter-heading-number-12 of section_overview_{i}" for i in range(30)]
    texts += [f"commit {i} of release_candidate_build_{i}" for i in range(20)] + ["", None, "12345678901234567890"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for i, t in enumerate(texts):
        want = [(t.index(hexes[i]), t.index(hexes[i]) + 40)] if i < 30 else []
        assert [tuple(s) for s in rows[i].secret_added] == want, t
        assert rows[i].secret_base == []


def test_estimate_equals_em_over_single_spans():
    rng = random.Random(3)
    spans = []
    for _ in range(400):
        y = rng.random() < 0.4
        vote = lambda right: rng.choices([1, 0, -1], right if y else right[::-1])[0]  # noqa: B023, E731
        spans.append((vote([7, 2, 1]), vote([5, 4, 1]), vote([4, 5, 1])))
    counts = [Row(kind="email", strict=a, listed=b, context=c, feature="all", n=n) for (a, b, c), n in Counter(spans).items()]
    prior, _ = pii.estimate(counts, rounds=30)
    votes = np.array(spans)
    belief = {1: {1: 0.6, 0: 0.3, -1: 0.1}, 0: {1: 0.2, 0: 0.3, -1: 0.5}}
    rates, share = [{y: dict(belief[y]) for y in (0, 1)} for _ in range(3)], 0.5
    for _ in range(30):
        one = np.array([share * math.prod(rates[k][1][v] for k, v in enumerate(s)) for s in spans])
        zero = np.array([(1 - share) * math.prod(rates[k][0][v] for k, v in enumerate(s)) for s in spans])
        soft = one / (one + zero)
        share = (soft.sum() + 1) / (len(spans) + 2)
        for k in range(3):
            for y, mass in ((1, soft), (0, 1 - soft)):
                for v in (-1, 0, 1):
                    rates[k][y][v] = (mass[votes[:, k] == v].sum() + 4 * belief[y][v]) / (mass.sum() + 4)
    assert prior["email"] == pytest.approx(math.log(share / (1 - share)))
