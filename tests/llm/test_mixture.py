"""Mixtures of sources, against plain water-filling and walking."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest

from inkledger.llm import mixture
from inkledger.llm.mixture import mix_sources

SCHEMA = "position long, notes string, reviewed_by string, source int, size string, target long, of int"


def plain(records, weights, share=1.5, most=2, seed=13):
    sizes, members = defaultdict(int), defaultdict(list)
    for p, note, source in records:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", note or ""))
        name = ":".join([str(seed), "" if p is None else str(p)] + ([] if note is None else [note]))
        members[source].append((hashlib.sha256(name.encode()).hexdigest()[:32], p, size))
        sizes[source] += size
    weight = {s: weights.get(s, 0) for s in sizes}
    goal, clamped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in clamped and weight[s]]
        level = (goal - sum(most * sizes[s] for s in clamped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if most * sizes[s] < weight[s] * level}
        if not over:
            break
        clamped |= over
    target = {s: float(most * sizes[s]) if s in clamped else weight[s] * level for s in sizes}
    out = []
    for source, rows in members.items():
        whole = int(target[source])
        epochs = whole // sizes[source] if sizes[source] else 0
        left = whole - epochs * sizes[source]
        for _, p, size in sorted(rows, key=lambda r: (r[0], r[2])):
            out.append((p, source, size, sizes[source], target[source], epochs * size + min(size, left)))
            left -= min(size, left)
    return sorted(out, key=str)


def found(spark, records, weights, parts=3, **settings):
    table = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in records], SCHEMA).repartition(parts)
    listed = spark.createDataFrame([*weights.items()], "source string, weight double")
    return sorted((tuple(r) for r in mix_sources(table, listed, **settings).collect()), key=str)


@pytest.fixture(scope="module")
def records():
    rows = [(i, "word " * (i * 37 % 90), ["ann", "bo", "cy", None, ""][(i * i) % 7 % 5]) for i in range(400)]
    rows += [(1000, "scan " * 30000, "ann"), (1001, None, "bo"), (1002, "", "bo"), (1003, " \t\n", "dee")]
    rows += [(None, None, None), (None, "no place", None), (5, "one place, two notes", "ann")]
    return rows + [(77, "the same record again", "cy")] * 300


@pytest.mark.parametrize("settings", [{}, {"share": 0.3}, {"share": 2.0}, {"share": 9.0}, {"most_epochs": 5, "seed": 4}])
def test_against_plain_walk(spark, records, settings, monkeypatch):
    monkeypatch.setattr(mixture, "BUCKET_ROWS", 20)
    monkeypatch.setattr(mixture, "RUN_ROWS", 7)
    weights = {"ann": 3.0, "bo": 1.0, "cy": 2.0, None: 0.5, "dee": 1.0, "nobody": 8.0}
    got = found(spark, records, weights, **settings)
    names = {"most_epochs": "most"}
    assert got == plain(records, weights, **{names.get(k, k): v for k, v in settings.items()})
    assert got == found(spark, records, weights, parts=5, **settings)


def test_targets_are_met(spark, records):
    weights = {"ann": 3.0, "bo": 1.0, "cy": 2.0}
    taken, target = defaultdict(int), {}
    for _, source, size, total, goal, words in found(spark, records, weights):
        assert 0 <= words <= 2 * size and goal <= 2 * total
        taken[source] += words
        target[source] = goal
    assert all(abs(taken[s] - target[s]) < 1 for s in target)
    assert target[""] == 0 and target["bo"] > 0


def test_one_word_sources_and_nothing(spark):
    assert found(spark, [], {"ann": 1.0}) == []
    assert found(spark, [(1, None, "ann")], {"ann": 1.0}) == [(1, "ann", 0, 0, 0.0, 0)]
    assert found(spark, [(1, "worn", "ann")], {}) == [(1, "ann", 1, 1, 0.0, 0)]
