"""Passages of a few lines between foreign lines, as an earlier note holds them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from inkledger.llm import chunks


def test_short_passages_go_whole(spark):
    draw = np.random.default_rng(8)
    serial = iter(range(1_000_000))

    def line(words=18):
        return " ".join(f"w{next(serial)}" for _ in range(words))

    rows, own = [], {}
    for case in range(80):
        passage = [line() for _ in range(1 + case % 4)]
        if len(passage) == 1:
            passage = [line(51)]
        elif case % 3 == 0:
            passage.insert(1, "")
        for copy in range(3):
            head, foot = ([line() for _ in range(draw.integers(1, 4))] for _ in range(2))
            at = 10 * case + copy
            rows.append((at, "\n".join([*head, *passage, *foot])))
            own[at] = "\n".join([*head, *(passage if copy == 0 else []), *foot])
    # A short line alone stays, and so does one that only nulls share.
    once = line(50)
    rows += [(2000, once), (2001, f"{line()}\n{once}"), (None, f"{once}\nnull")]
    own |= dict(rows[-3:])
    table = spark.createDataFrame(rows, "position long, notes string").repartition(4)
    got = chunks.drop_repeated_lines(table).select(F.col("_row.position"), "text").collect()
    assert len(got) == len(rows) and {r.position: r.text for r in got} == own


def test_lines_from_different_notes_stay(spark):
    """Lines 1 and 2 hold apart from each other are no passage when note 3 puts them together."""
    rows = [(1, "a one\nfirst line\nb two"), (2, "c three\nsecond line\nd four"),
            (3, "e five\nfirst line\nsecond line\nf six"), (4, "first line\nsecond line\ng seven")]
    table = spark.createDataFrame(rows, "position long, notes string")
    got = {r.position: r.text for r in chunks.drop_repeated_lines(table).select(F.col("_row.position"), "text").collect()}
    assert got == dict(rows) | {4: "g seven"}


def test_random_notes_against_pairs_of_lines(spark):
    """Lines that go are exactly those of two neighbouring lines an earlier note holds."""
    draw = np.random.default_rng(21)
    rows = []
    for at in range(150):
        lines = [f"line {k}" for k in draw.integers(0, 60, draw.integers(1, 14))]
        rows.append((at, "\n".join(line if draw.random() < 0.9 else "" for line in lines)))
    want, seen = {}, set()
    for at, note in rows:
        lines = note.split("\n")
        worded = [i for i, line in enumerate(lines) if line]
        pairs = [(i, j) for i, j in zip(worded, worded[1:])]
        marked = {k for i, j in pairs if (lines[i], lines[j]) in seen for k in range(i, j + 1)}
        end = False
        drop = set()
        for i in range(len(lines)):
            end = i in marked or (end and not lines[i])
            if end:
                drop.add(i)
        want[at] = "\n".join(line for i, line in enumerate(lines) if i not in drop)
        seen |= {(lines[i], lines[j]) for i, j in pairs}
    table = spark.createDataFrame(rows, "position long, notes string").repartition(4)
    got = {r.position: r.text for r in chunks.drop_repeated_lines(table).select(F.col("_row.position"), "text").collect()}
    assert got == want


def test_bytes_are_compared(spark):
    """Where all hashes collide, only lines with the same bytes go."""
    rows = [(i, f"own {i}\nfirst {i % 3}\nsecond {i % 3}\nend {i}") for i in range(9)]
    table = spark.createDataFrame(rows, "position long, notes string").repartition(3)
    left = chunks.drop_repeated_lines(table, digest=lambda text: bytes(16))
    got = {r.position: r.text for r in left.select(F.col("_row.position"), "text").collect()}
    assert got == {i: note if i < 3 else f"own {i}\nend {i}" for i, note in rows}


def test_hashes_that_partly_collide(spark):
    """Whatever collides, and with null or repeated ids, the notes that are left are the same."""
    draw = np.random.default_rng(5)
    rows = []
    for at in range(120):
        lines = [f"line {k}" if k else "" for k in draw.integers(0, 40, draw.integers(1, 12))]
        rows.append((None if at % 17 == 0 else at // 2 if at % 5 == 0 else at, "\n".join(lines)))
    rows += [*rows[:6], (500, None), (501, "")]
    table = spark.createDataFrame(rows, "position long, notes string").repartition(4)

    def left(**digest):
        got = chunks.drop_repeated_lines(table, **digest)
        return sorted(map(str, got.select("_row.position", "text", "removed_lines", "removed_spans").collect()))

    want = left()
    assert left(digest=lambda text: bytes(15) + bytes([sum(text) % 3])) == want
    assert sum("removed_lines=0" not in row for row in want) > 40


def test_notes_are_shuffled_once(spark):
    """What is returned was written by the step that takes lines out; nothing is joined to the notes again."""
    rows = [(i, f"own {i}\nfirst {i % 3}\nsecond {i % 3}\nend {i}") for i in range(9)]
    table = spark.createDataFrame(rows, "position long, notes string")
    plan = chunks.drop_repeated_lines(table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Scan parquet" in plan
