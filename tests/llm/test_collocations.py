"""Collocations of review notes, against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from inkledger.llm.collocations import collocations, phrase_counts

SCHEMA = "stamp_type string, notes string, kind string, n long, words string"


def plain(records, least=10, width=3, percent=50, first=2000, unknown=""):
    counts, total = defaultdict(Counter), Counter()
    for kind, note in records:
        kind = unknown if kind is None else kind
        low = re.sub("[A-Z]", lambda m: m[0].lower(), note or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            total[kind] += len(words)
            for size in range(1, width + 1):
                for i in range(len(words) - size + 1):
                    counts[kind][tuple(words[i:i + size])] += 1
    out = []
    for kind, f in counts.items():
        longest = Counter()
        for p, c in f.items():
            if c >= least:
                for size in range(1, len(p)):
                    for i in range(len(p) - size + 1):
                        longest[p[i:i + size]] = max(longest[p[i:i + size]], c)
        rows = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and 100 * longest[p] < percent * a:
                score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:first], 1):
            out.append((kind, rank, phrase.decode(), -a, left, right, total[kind], -score))
    return sorted(out)


def found(spark, records, **settings):
    table = spark.createDataFrame([(*r, "other", 1, "x") for r in records], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in collocations(table, **settings).collect())


@pytest.fixture(scope="module")
def records():
    draw = random.Random(5)
    common = ["depth", "Ring", "date", "stamp", "worn", "the", "é", "日本", "x\x00y", "\x01"]
    rare = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        words = [draw.choice(common if draw.random() < 0.8 else rare) for _ in range(draw.randint(0, 60))]
        if i % 3 == 0:
            words += ["received", "DATE", "stamp", "seen"]
        ends = [draw.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x1c "]) for _ in words]
        kind = draw.choice(["IHS", "IHS", "IHS", "TWDB", None, ""])
        rows.append((kind, "".join(w + e for w, e in zip(words, ends))))
    return rows + [("IHS", None), (None, None), ("IHS", ""), ("IHS", " .;\t")] + rows[:40]


@pytest.mark.parametrize("settings", [
    {}, {"range_bytes": 300}, {"max_words": 4, "range_bytes": 500}, {"max_words": 2, "first": 5},
    {"min_count": 2, "inside_percent": 100, "range_bytes": 1000, "unknown": "none"},
])
def test_against_plain_counting(spark, records, settings):
    names = {"min_count": "least", "max_words": "width", "inside_percent": "percent"}
    want = plain(records, **{names.get(k, k): v for k, v in settings.items() if k != "range_bytes"})
    assert want and found(spark, records, **settings) == want


def test_hot_word_over_many_ranges(spark):
    """One word begins and ends most phrases; its runs span every range."""
    draw = random.Random(2)
    records = [("IHS", " ".join("the " + draw.choice("abcdefgh") * draw.randint(1, 4) for _ in range(40)))
               for _ in range(200)]
    assert found(spark, records, range_bytes=400) == plain(records)


def test_nothing_and_one_long_note(spark):
    assert found(spark, []) == []
    long = [("IHS", "worn outline here. " * 30000 + "z" * 50000)]
    assert found(spark, long) == plain(long)


def test_parts_of_single_words_are_empty(spark, records):
    table = spark.createDataFrame([(*r, "other", 1, "x") for r in records], SCHEMA)
    phrases, totals = phrase_counts(table)
    assert phrases.filter("size(starts) <> size(words) - 1 or size(ends) <> size(words) - 1 "
                          "or exists(starts, x -> x is null) or exists(ends, x -> x is null)").count() == 0
    assert totals.count() == 3  # null and blank kinds are one
