"""Centroids of signatures, against plain k-means on whole numbers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from inkledger.llm.centroids import cluster_signatures, nearest, squared

SCHEMA = "cand_id long, signature array<float>, cluster int, whole string, bounds long"


def plain(rows, k=8, rounds=10, seed=3, bins=64, scale=1024):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in s]) for i, s in rows
            if s is not None and len(s) == bins
            and all(x is not None and math.isfinite(x) and abs(x) < 1e5 for x in s)]

    def place(row):
        name = "~" if row[0] is None else hashlib.sha256(f"{seed}:{row[0]}".encode()).hexdigest()
        return name, np.array(row[1], "<i4").tobytes()

    centres = [c for _, c in sorted(kept, key=place)[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centres))
                for _, v in kept]

    for _ in range(rounds):
        best = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, best) if c == j]
            if own:
                centres[j] = [sum(column) // len(own) for column in zip(*own)]
    best = assign()
    inertia = [sum(d for d, c in best if c == j) for j in range(len(centres))]
    return sorted(((i, c, d, inertia[c], sum(inertia),
                    hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
                   for (i, _), (d, c) in zip(kept, best)), key=str)


def found(spark, rows, **settings):
    table = spark.createDataFrame([(i, s, 1, "w", 2) for i, s in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in cluster_signatures(table, **settings).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(4)
    middle = draw.normal(size=(5, 6))
    signatures = (middle[draw.integers(5, size=300)] + draw.normal(scale=0.7, size=(300, 6))).tolist()
    lattice = draw.integers(0, 3, size=(150, 6)).astype(float).tolist()  # many equal distances
    odd = [None, [], [1.0] * 5, [1.0] * 7, [1.0, None] * 3, [float("nan")] * 6, [float("inf")] * 6,
           [-float("inf")] * 6, [3e38] * 6, [-3e38] * 6, [0.0] * 6, [0.0] * 6, [-0.0001] * 6]
    all_rows = [*enumerate([*signatures, *lattice, *odd])]
    return all_rows + all_rows[:20] + [(None, [0.5] * 6), (None, None), (7, [9.0] * 6)]


@pytest.mark.parametrize("settings", [{}, {"k": 3, "rounds": 1}, {"k": 40, "scale": 3}, {"k": 1}, {"rounds": 0}])
def test_against_plain_rounds(spark, rows, settings):
    settings = {"bins": 6, **settings}
    assert found(spark, rows, **settings) == plain(rows, **settings)


def test_nothing_and_fewer_rows_than_centroids(spark):
    assert found(spark, [], bins=6) == []
    few = [(1, [1.0, 2.0]), (2, [3.0, 4.0]), (2, [3.0, 4.0])]
    assert found(spark, few, bins=2) == plain(few, bins=2)


def test_bounds_save_most_distances():
    """Centroids that go to and fro loosen a bound by where they are, not by their way there."""
    draw = np.random.default_rng(1)
    whole = np.concatenate([draw.normal(c, 30, size=(500, 4)) for c in (0, 1000, 2000)]).astype(np.int64)
    centres = np.array([[0] * 4, [1000] * 4, [2000] * 4])
    history = np.stack([centres + 60 * (t % 2) for t in range(9)])
    exact = np.stack([squared(whole, c) for c in history[0]], axis=1)
    cluster, bounds = exact.argmin(axis=1).astype(np.int32), np.sqrt(exact)
    seen, computed = np.zeros(exact.shape, np.uint16), 0
    for t in range(1, 9):
        cluster, bounds, seen, n = nearest(whole, cluster, bounds, seen, history[:t + 1])
        want = np.stack([squared(whole, c) for c in history[t]], axis=1)
        assert (cluster == want.argmin(axis=1)).all()
        computed += n
    assert computed < 0.02 * 8 * exact.size
