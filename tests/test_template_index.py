"""Clustering by looked-up words against a plain pass over all templates."""

import random

import numpy as np
import pytest

from logwarden.operators import templates


def plain(rows, similarity):
    found = []
    for row in rows:
        ranks = [(sum(a == b != 0 for a, b in zip(t, row)), sum(a == 0 for a in t), -i) for i, t in enumerate(found)]
        same, _, oldest = max(ranks, default=(0, 0, 0))
        if found and (same / len(row) if row else 1.0) >= similarity:
            found[-oldest] = [a if a == b else 0 for a, b in zip(found[-oldest], row)]
        else:
            found.append(list(row))
    return found


@pytest.mark.parametrize("width,words", [(0, 1), (1, 5), (3, 40), (8, 12), (12, 60)])
def test_index_gives_the_plain_result(monkeypatch, width, words):
    monkeypatch.setattr(templates, "PENDING", 3)
    rnd = random.Random(width)
    rows = [[int(words * rnd.random() ** 2) for _ in range(width)] for _ in range(300)]
    clusters = templates._Clusters(0.4, width)
    for i, row in enumerate(rows):
        clusters.add(np.array(row, np.int32), i, 1)
    assert clusters.matrix[: len(clusters.lines)].tolist() == plain(rows, 0.4)
    assert sum(clusters.lines) == len(rows)


def test_few_templates_are_compared():
    rnd = random.Random(1)
    clusters = templates._Clusters(0.4, 20)
    for i in range(2000):
        clusters.add(np.array([1, *(rnd.randrange(2, 5000) for _ in range(19))], np.int32), i, 1)
    row = np.array([1, *(rnd.randrange(2, 5000) for _ in range(19))], np.int32)
    assert len(clusters.lines) == 2000
    assert len(clusters._found(row)) < templates.PENDING + 50
