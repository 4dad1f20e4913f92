"""Suppression of near candidates, against taking the strongest first in a plain loop."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkledger.operators.suppression import independent, strongest

SCHEMA = "page_id long, cy int, cx int, radius double, votes double, min_sep double, note string"


def plain(rows):
    kept = defaultdict(list)
    for row in sorted(set(rows), key=lambda r: (-r[4], r[1], r[2], r[3])):
        sep = row[5] or 0.0
        if all((row[1] - k[1]) ** 2 + (row[2] - k[2]) ** 2 > sep * sep for k in kept[row[0]]):
            kept[row[0]].append(row)
    return sorted((r for page in kept.values() for r in page), key=str)


def found(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted((tuple(r) for r in independent(table, ["page_id"], "min_sep").collect()), key=str)


@pytest.mark.parametrize("sep", [0.0, 1.0, 4.5, 30.0])
def test_random_pages(spark, sep):
    draw = np.random.default_rng(int(sep * 10))
    rows = [(int(p) if p else None, int(y), int(x), float(r), float(v), sep, "n")
            for p, y, x, r, v in zip(draw.integers(0, 4, 600), draw.integers(-20, 50, 600),
                                     draw.integers(0, 50, 600), draw.integers(3, 6, 600), draw.integers(1, 12, 600))]
    assert found(spark, rows + rows[:30]) == plain(rows)


def test_chain_of_waiting_candidates(spark):
    """Each is weaker than the one before it and near it: every second one stays."""
    rows = [(1, 0, 3 * i, 5.0, float(100 - i), 4.0, "n") for i in range(24)]
    assert found(spark, rows) == plain(rows)
    assert len(plain(rows)) == 12


def test_nothing_equal_rows_and_no_distance(spark):
    assert found(spark, []) == []
    twice = [(1, 2, 3, 4.0, 5.0, None, "n")] * 3 + [(None, 2, 3, 4.0, 5.0, 2.0, "n")] * 2
    assert found(spark, twice) == plain(twice)


def test_crowded_page(spark):
    """100,000 peaks of one page, a third of them in one cell; no group is one row or task."""
    peaks = spark.range(100_000).select(
        F.lit(1).cast("long").alias("page_id"),
        F.when(F.col("id") % 3 == 0, F.pmod(F.xxhash64("id"), F.lit(9))).otherwise(
            F.pmod(F.xxhash64("id"), F.lit(4000))).cast("int").alias("cy"),
        F.when(F.col("id") % 3 == 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9))).otherwise(
            F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4000))).cast("int").alias("cx"),
        F.lit(5.0).alias("radius"), F.pmod(F.hash("id"), F.lit(5000)).cast("double").alias("votes"),
        F.lit(9.0).alias("min_sep"), F.lit("n").alias("note"))
    kept = independent(peaks, ["page_id"], "min_sep")
    got = sorted((r["cy"], r["cx"], r["votes"]) for r in kept.collect())
    cells, want = defaultdict(list), []
    for v, y, x in sorted({(-r["votes"], r["cy"], r["cx"]) for r in peaks.collect()}):
        around = (k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in cells[y // 9 + i, x // 9 + j])
        if all((y - a) ** 2 + (x - b) ** 2 > 81 for a, b in around):
            cells[y // 9, x // 9].append((y, x))
            want.append((y, x, -v))
    assert got == sorted(want)


def test_strongest_of_each_group(spark):
    rows = [(p, i, 0, 5.0, float(i), 1.0, "n") for p in (1, 2) for i in range(9)]
    top = strongest(spark.createDataFrame(rows, SCHEMA), ["page_id"], 2)
    assert sorted((r["page_id"], r["votes"]) for r in top.collect()) == [(1, 7.0), (1, 8.0), (2, 7.0), (2, 8.0)]
