"""The pipeline's near-copy stage against all pairs of shingle sets."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from inkledger.llm import alike, links


def shingles(text):
    words = (text or "").split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def first_rows(rows):
    """Plain version: which (doc_id, text) stay."""
    distinct = sorted({(i is None, i or 0, t or "") for i, t in rows})
    root = list(range(len(distinct)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    sets = [shingles(t) for _, _, t in distinct]
    for b in range(len(sets)):
        for a in range(b):
            common = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 10 * common >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {distinct[k] for k in range(len(root)) if root[k] == k}


def stage(spark, rows):
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, table.repartition(4), "").collect()
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept)
    return {(r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept}


def test_links_are_those_of_the_texts(spark):
    """Families whose similarities lie on both sides of 0.8, and chains below it."""
    draw = np.random.default_rng(11)
    rows = []
    for family in range(25):
        base = [f"w{k}" for k in draw.integers(0, 9000, 220)]
        for copy in range(10):
            words = list(base)
            for at in draw.choice(220, copy, replace=False):
                words[at] = f"edit{family}-{copy}-{at}"
            rows.append((100 * family + copy, " ".join(words)))
    assert stage(spark, rows) == first_rows(rows)


@pytest.mark.parametrize("shared", [600, 0])
def test_rows_without_an_id_of_their_own(spark, shared):
    """Null and repeated ids: different texts all stay, equal rows once."""
    draw = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in draw.integers(0, 9000, 90)) for _ in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]),
            (3, texts[3]), (9, texts[4]), (9, texts[4]), (None, texts[4]), (1, None), (2, ""), (4, "short"),
            (5, "short"), (6, "other words")]
    base = [f"b{k}" for k in range(200)]
    rows += [(1000 + k, " ".join([*base[:198], f"x{k}", f"y{k}"])) for k in range(shared)]
    got = stage(spark, rows)
    kept = {(none, i) if t not in (texts[0], texts[1], texts[2], texts[3]) else t for none, i, t in got}
    want = {*texts[:4], (False, 9), (False, 1), (False, 4), (False, 6)} | ({(False, 1000)} if shared else set())
    assert kept == want


def kept_of_all_pairs(texts):
    """Plain version for many rows: how many groups the links among all pairs leave."""
    sets = [shingles(t) for t in texts]
    names = {s: k for k, s in enumerate(sorted(frozenset().union(*sets)))}
    held = np.zeros((len(texts), len(names)), np.float32)
    for row, of in enumerate(sets):
        held[row, [names[s] for s in of]] = 1
    size = held.sum(1)
    common = held @ held.T
    linked = 10 * common >= 8 * (size[:, None] + size[None, :] - common)
    root = np.arange(len(texts))
    while True:
        low = np.where(linked, root[None, :], len(texts)).min(1)
        if (low == root).all():
            return len(set(root)), int(np.triu(linked, 1).sum())
        root = low


def test_a_large_family_that_is_mostly_no_copies(spark):
    """2,000 notes of one origin, mutual similarity about 0.4 to 0.9: no link is made up, few are lost."""
    draw = np.random.default_rng(29)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for note in range(2000):
        words = list(base)
        for at in draw.choice(40, draw.integers(4, 8), replace=False):
            words[5 * at] = f"other{at}-{draw.integers(0, 4)}"
        texts.append(" ".join(words))
    texts = sorted(set(texts))
    want, links = kept_of_all_pairs(texts)
    got = len(stage(spark, list(enumerate(texts))))
    assert links > 1000 and want < len(texts) - 400
    assert want <= got and len(texts) - got >= 0.99 * (len(texts) - want)


def test_every_pair_that_meets_is_verified(spark):
    """A family of many sides, mutual similarity on both sides of 0.8: the groups are those of all pairs."""
    draw = np.random.default_rng(31)
    base = [f"w{k}" for k in range(200)]
    texts = set()
    for _ in range(500):
        words = list(base)
        for at in draw.choice(40, draw.integers(4, 7), replace=False):
            words[5 * at] = f"other{at}-{draw.integers(0, 4)}"
        texts.add(" ".join(words))
    texts = sorted(texts)
    want, links = kept_of_all_pairs(texts)
    assert links > 20 and len(stage(spark, list(enumerate(texts)))) == want


def test_few_tables_are_planned(spark, monkeypatch):
    """The driver plans every table that is written between; a family that stays open takes 30 at most."""
    written = []
    for module in (alike, links):
        monkeypatch.setattr(module, "cut_lineage", lambda df, cut=module.cut_lineage: written.append(1) or cut(df))
    draw = np.random.default_rng(37)
    base = [f"w{k}" for k in range(200)]
    texts = set()
    for _ in range(120):
        words = list(base)
        for at in draw.choice(40, draw.integers(3, 7), replace=False):
            words[5 * at] = f"other{at}-{draw.integers(0, 4)}"
        texts.add(" ".join(words))
    texts = sorted(texts)
    want, found = kept_of_all_pairs(texts)
    assert found > 20 and len(stage(spark, list(enumerate(texts)))) == want
    assert 10 < len(written) <= 30


def test_a_family_of_no_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    """1,200 notes of one origin, most of them between 0.65 and 0.78 alike: few pairs are verified, no link is lost."""
    draw = np.random.default_rng(41)
    base, texts = [f"w{k}" for k in range(200)], []
    for note in range(1000):
        words = list(base)
        for at in draw.choice(200, draw.integers(5, 9), replace=False):
            words[at] = f"own{note}-{at}"
        texts.append(" ".join(words))
        if note % 5 == 0:
            words[draw.integers(0, 200)] = f"copy{note}"
            texts.append(" ".join(words))
    compared = []
    monkeypatch.setattr(alike, "_checked", lambda pairs, *rest, check=alike._checked: (
        compared.append(pairs.count()) or check(pairs, *rest)))
    want, links = kept_of_all_pairs(texts)
    assert links >= 200 and len(stage(spark, list(enumerate(texts)))) == want
    assert sum(compared) < 60 * len(texts)


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_candidates_hold_every_link(spark, percent):
    """Sets of many sizes over rare and common shingles: each pair at the similarity is a candidate, if the roots differ."""
    draw = np.random.default_rng(percent)
    held = []
    for _ in range(60):
        base = draw.choice(3000, draw.integers(1, 60), replace=False)
        for drop in range(4):
            kept = base[draw.random(len(base)) >= 0.04 * drop]
            held.append(sorted({*kept.tolist(), *draw.choice(40, draw.integers(0, 4)).tolist()} or {0}))
    roots = draw.integers(0, 30, len(held)).tolist()
    name = "{:04d}".format
    notes = spark.createDataFrame([(name(k).encode(), len(s), name(r).encode()) for k, (s, r) in enumerate(zip(held, roots))],
                                  "node binary, n int, root binary")
    sets = spark.createDataFrame([(name(k).encode(), s) for k, s in enumerate(held)], "node binary, shingles array<long>")
    got = [(int(r.a), int(r.b)) for r in alike._candidates(notes, sets, percent).collect()]
    links = set()
    for b, y in enumerate(held):
        for a in range(b):
            common = len({*held[a]} & {*y})
            if 100 * common >= percent * (len(held[a]) + len(y) - common) and roots[a] != roots[b]:
                links.add((a, b))
    assert links and links <= set(got) and len(got) == len(set(got))
    assert all(a < b and roots[a] != roots[b] for a, b in got)


MISSED = [59464, 521561, 738932]


def test_links_that_meet_in_no_band_are_found(spark):
    """Pairs at exactly 0.8 whose minima agree in no band, beside notes that share nothing with them."""
    texts = []
    for k in MISSED:
        words = [f"{k}-{i}" for i in range(9)]
        pair = [" ".join(words), " ".join(words[:8])]
        keys = [set(alike._keys(alike.shingle_set(t, 5), *alike._draws(alike.BANDS, alike.ROWS))) for t in pair]
        assert not keys[0] & keys[1]
        texts += pair
    texts += [" ".join(f"other{k}-{i}" for i in range(30)) for k in range(40)]
    rows = list(enumerate(texts))
    assert stage(spark, rows) == first_rows(rows)
    assert len(first_rows(rows)) == len(rows) - len(MISSED)


def test_one_link_between_a_large_group_of_copies_and_others(spark, monkeypatch):
    """A group of 800 near copies and notes that hold half of it: the rarest shingles are the group's own, few pairs meet."""
    draw = np.random.default_rng(43)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for note in range(800):
        words = list(base)
        words[draw.integers(0, 150)] = f"own{note}"
        texts.append(" ".join(words))
    texts += [" ".join([*base[:75], *(f"x{k}-{i}" for i in range(75))]) for k in range(20)]
    compared = []
    monkeypatch.setattr(alike, "_checked", lambda pairs, *rest, check=alike._checked: (
        compared.append(pairs.count()) or check(pairs, *rest)))
    rows = list(enumerate(texts))
    assert len(stage(spark, rows)) == kept_of_all_pairs(texts)[0] == 21
    assert sum(compared) < 30 * len(rows)
