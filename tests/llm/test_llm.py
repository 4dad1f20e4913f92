"""Training-data operators on review records, against plain versions on small tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkledger.llm import (
    bytepair, chunks, curves, packing, paths, records, repetition, shards, simhash, toxicity,
)
from inkledger.llm.hilbert import hilbert_keys
from inkledger.llm.links import components
from inkledger.session import scratch_path

PATTERN = public_tokenizers.PATTERN
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "position long, notes string, reviewed_by string, score double, text string, bin int"

LONG = " ".join(f"depth {i} looks {'clear' if i % 3 else 'worn'}" for i in range(4000))
NOTES = [
    (3, "Stamp at the foot,  partly cut.\n\nSee page 2 of 4", "ann"),
    (1, "Ring closed; digits 17 MAR 1964 don't read", "ann"),
    (2, None, "bo"), (4, "", "bo"), (5, "   ", None), (6, "x" * 3000, "bo"), (7, LONG, "ann"),
    (8, "naïve – Größe 日本 \U0001F600 \x1c\x85 end ", "bo"), (8, "same position", "bo"),
    (9, "twice", "ann"), (9, "twice", "ann"), (None, "no position", None), (None, None, None),
]


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame([(*r, 0.5, "other", 1) for r in NOTES], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(position, rest):
    return (position is not None, position or 0, rest)


@pytest.fixture(scope="module")
def plain_ids():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    return lambda note: tokenizer.encode(note or "", add_special_tokens=False).ids


def test_record_files_round_trip(spark, notes, nothing, plain_ids):
    folder = scratch_path(spark)
    manifest = records.write_notes(notes, folder, TOKENIZER, PATTERN, 0, partitions=4).collect()
    got = records.read_notes(spark, folder).collect()
    start, expected = 0, []
    for p, n, _ in sorted(NOTES, key=lambda r: key(r[0], r[1] or "")):
        ids = plain_ids(n) + [0]
        expected.append((key(p, start), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = [(key(r.position, r.start), r.n_tokens, zlib.crc32(r.token_bytes)) for r in got]
    assert sorted(found) == expected
    assert sum(m.n_records for m in manifest) == len(NOTES)
    position, ids = records.read_record(folder, manifest[-1].file, manifest[-1].n_records - 1)
    assert position == 9 and ids.tolist() == plain_ids("twice") + [0]
    empty = scratch_path(spark)
    assert records.write_notes(nothing, empty, TOKENIZER, PATTERN, 0).count() == 0
    assert records.read_notes(spark, empty).count() == 0


def test_damaged_record_is_found(tmp_path):
    path = tmp_path / "r"
    path.write_bytes(records.frame(b"abc")[:-1] + b"!")
    with path.open("rb") as stream, pytest.raises(ValueError):
        records.read_frame(stream)


@pytest.mark.parametrize("frequent", [bytepair.FREQUENT, 4])
def test_byte_pairs(notes, nothing, frequent):
    ranks = bytepair.read_ranks(RANKS)
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bytepair.encode_notes(notes, RANKS, PATTERN, frequent=frequent)
    got = bytepair.decode_notes(encoded, RANKS).collect()
    assert sorted(list(r.token_ids) for r in got) == sorted(coder.encode_ordinary(n or "") for _, n, _ in NOTES)
    assert sorted(bytes(r.note_bytes) for r in got) == sorted((n or "").encode() for _, n, _ in NOTES)
    if frequent == 4:
        none = bytepair.encode_notes(nothing, RANKS, PATTERN)
        assert none.count() == 0 and bytepair.decode_notes(none, RANKS).count() == 0


def test_toxicity(spark, nothing):
    mild = ["the ring is closed and the digits read well", "gap worn near the text", "no stamp here"]
    rows = [(i, f"{mild[i % 3]} {i} " + ("you stupid idiot " if i % 4 == 0 else "fine work ") + mild[i % 2],
             "en", int(i % 4 == 0)) for i in range(400)] + [(900, None, "xx", 0), (901, "", None, 0)]
    table = spark.createDataFrame(rows, "position long, notes string, language string, toxic int")
    known = table.filter("position % 3 <> 1 and position < 400")
    model = toxicity.fit_toxicity(table, known.select("position", "toxic"), language="language")
    scored = toxicity.score_notes(table, model, language="language").select("_row.*", "score", "rejected").collect()
    held = [r for r in scored if r.position % 3 == 1 and r.position < 400]
    assert all((r.score >= 0.7) == bool(r.toxic) for r in held)
    assert all(0 <= r.score <= 1 for r in scored) and len(scored) == len(rows)
    assert not any(r.rejected for r in scored if r.position >= 900)
    assert toxicity.score_notes(nothing, model).count() == 0
    untrained = toxicity.fit_toxicity(table, table.select("position", "toxic").filter("toxic = 0"))
    assert toxicity.score_texts(untrained, ["idiot"])[0] < 0.5


def test_shards(spark):
    rows = [(i, 400 + i % 7, 1000 * (i % 50), None if i % 90 == 0 else 20 + i % 11, f"r{i}") for i in range(3000)]
    rows += [(5000 + i, 400, 10, 20, "copy") for i in range(1500)] + [(None, 1, 1, 1, "r0"), (7, 407, 7000, 20, None)]
    pages = spark.createDataFrame(rows, "page_id long, width int, height int, n_bytes int, revision string")
    placed = shards.shard_pages(
        pages, 7, {"width": F.col("width"), "height": F.col("height")}, F.col("n_bytes"),
        F.col("revision"), keep={"revision": F.col("revision")}).collect()
    assert len(placed) == len(rows)
    size = Counter()
    for r in placed:
        size[r.shard] += r.size
    assert set(size) == set(range(7)) and max(size.values()) < 1.02 * min(size.values())
    for s in range(7):
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed)))
    empty = shards.shard_pages(pages.limit(0), 3, {"width": F.col("width")}, F.col("n_bytes"), F.col("revision"))
    assert empty.count() == 0


def simple_fingerprint(note, shingle, seed=42):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in note or ""))
    runs = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("blocks,bucket", [(2, 4096), (2, 2), (1, 4096)])
def test_near_copies(spark, notes, nothing, blocks, bucket):
    base = [f"word{i * 7 % 101}" for i in range(300)]
    rows = [(100 + i, " ".join(base[: 295 + i % 5] + [f"tail{i % 9}"])) for i in range(40)]
    extra = spark.createDataFrame(rows, "position long, notes string")
    table = notes.select("position", "notes").unionByName(extra)
    groups = simhash.near_copies(table, shingle=4, radius=4, blocks=blocks, bucket=bucket).collect()
    prints = [(p, simple_fingerprint(n, 4)) for p, n in [*((p, n) for p, n, _ in NOTES), *rows]]
    assert Counter((r.position, r.fingerprint % (1 << 64)) for r in groups) == Counter(prints)
    root = {f: f for _, f in prints}
    for _ in prints:
        for a in root:
            root[a] = min(root[b] for b in root if (a ^ b).bit_count() <= 4)
    least = {}
    for p, f in prints:
        if p is not None:
            least[root[f]] = min(p, least.get(root[f], p))
    assert all(r.component_id == least.get(root[r.fingerprint % (1 << 64)]) for r in groups)
    if bucket == 2:
        assert simhash.near_copies(nothing).count() == 0


@pytest.mark.parametrize("bucket", [2, 4096])
def test_near_copies_of_wide_fingerprints(spark, notes, nothing, bucket):
    """All pairs within 20 of 128 bits, also where every bucket is full."""
    draw = np.random.default_rng(5)
    rows = []
    for family in range(6):
        base = [f"w{k}" for k in draw.integers(0, 5000, 240)]
        for copy in range(12):
            words = list(base)
            for at in draw.integers(0, 240, copy % 7):
                words[at] = f"edit{family}-{copy}-{at}"
            rows.append((1000 * family + 100 + copy, " ".join(words)))
    table = notes.select("position", "notes").unionByName(
        spark.createDataFrame(rows, "position long, notes string"))
    groups = simhash.near_copies(table, shingle=5, radius=20, bits=128, blocks=7, bucket=bucket).collect()
    prints = [(p, simple_fingerprint(n, 5) | simple_fingerprint(n, 5, 43) << 64)
              for p, n in [*((p, n) for p, n, _ in NOTES), *rows]]
    assert Counter((r.position, int.from_bytes(r.fingerprint, "little")) for r in groups) == Counter(prints)
    root = {f: f for _, f in prints}
    for _ in prints:
        for a in root:
            root[a] = min(root[b] for b in root if (a ^ b).bit_count() <= 20)
    least = {}
    for p, f in prints:
        if p is not None:
            least[root[f]] = min(p, least.get(root[f], p))
    assert all(r.component_id == least.get(root[int.from_bytes(r.fingerprint, "little")]) for r in groups)
    assert len({r.component_id for r in groups if r.position and r.position >= 100}) < 40
    if bucket == 2:
        assert simhash.near_copies(nothing, bits=128, radius=20, blocks=7).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 200)}}


def test_line_chunks(spark, notes, nothing):
    passage = [f"the survey notes for line {i} of the long passage were copied here" for i in range(12)]
    head = "a heading that everyone uses"
    rows = [(i, "\n".join([head, *[f"own {i} line {j}" for j in range(i % 4 + 1)],
                           *(passage if i % 2 else []), f"end {i}"])) for i in range(20)]
    rows += [(50, rows[1][1]), (None, rows[1][1])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "position long, notes string, text string")
    got = {r.position: r for r in chunks.drop_repeated_lines(table).select(
        "_row.position", "text", "removed_lines").collect()}
    assert got[1].text == rows[1][1] and got[0].text == rows[0][1]
    for i in range(3, 20, 2):
        own = [x for x in rows[i][1].split("\n") if x not in passage]
        left = got[i].text.split("\n")
        assert [x for x in left if x not in passage] == own
        # Outermost lines may stay where no other note's chunks end alike.
        assert got[i].removed_lines >= 8 and len(left) == len(own) + 12 - got[i].removed_lines
    assert got[2].removed_lines == 0 and got[50].text == "" and got[None].text == ""
    same = chunks.drop_repeated_lines(notes).select("_row.position", F.col("text").alias("left")).collect()
    assert Counter(map(tuple, same)) == Counter((p, n) for p, n, _ in NOTES)
    assert chunks.drop_repeated_lines(nothing).count() == 0


def brute_quality(note, least=8):
    words = re.findall(r"[^\x20\x09-\x0D]+", note or "")
    runs = Counter(tuple(words[i:i + least]) for i in range(len(words) - least + 1))
    again, longest = set(), 0
    for i in range(len(words) - least + 1):
        if runs[tuple(words[i:i + least])] > 1:
            again |= set(range(i, i + least))
            for j in range(i + 1, len(words) - least + 1):
                k = 0
                while j + k < len(words) and words[i + k] == words[j + k]:
                    k += 1
                longest = max(longest, k)
    lines = [x for x in (note or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", note or "")),
            len(lines) - len(set(lines)), len(again), longest if longest >= least else 0)


def test_repetition(spark, notes, nothing):
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in draw.integers(0, 3, draw.integers(0, 60))) for _ in range(60)]
    run = " ".join(f"v{i}" for i in range(40))
    texts += [f"{run} a {run} b", f"{run}\n{run}\n{run}", " ".join(["aa"] * 50), "# $ |\n# $ |"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(p, n) for p, n, _ in NOTES if p != 7]
    table = spark.createDataFrame(rows, "position long, notes string")
    got = repetition.judge_notes(table, keep=["notes"]).collect()
    assert len(got) == len(rows)
    for r in got:
        n, c, s, d, again, longest = brute_quality(r.notes)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.longest_repeat) == (
            n, c, s, d, again, longest)
        assert r.base_failed == (n < 20 or 100 * again > 30 * n) and not (r.base_failed and r.kept)
    long = repetition.judge_notes(notes.filter("position = 7")).first()
    assert long.n_words == 16000 and long.kept
    assert repetition.judge_notes(nothing).count() == 0


def test_link_rules(spark):
    rules = [paths.Rule("com", "/", "allow"), paths.Rule("share.com", "/wells/", "block"),
             paths.Rule("*", "/*/tmp/", "block"), paths.Rule("*", "/a*b", "block")]
    rows = ["http://www.Share.COM/wells/1.tif?x=/tmp/", "ftp://share.com/logs/", "http://com", "x.tif", None, "",
            "//host/tmp/a.tif", "smb://host/old/tmp/a.tif", "smb://host/axxb#f", "http://notshare.com/wells/1",
            "http://com.org/wells/", "smb://host/axxb#f"]
    table = spark.createDataFrame([(i, u, "h") for i, u in enumerate(rows)], "page_id int, file_link string, host string")
    got = {r.page_id: r for r in paths.judge_links(table, rules).select("_row.page_id", "host", "path", "rule",
                                                                       "pattern_rule", "verdict").collect()}
    assert [(got[i].rule, got[i].pattern_rule, got[i].verdict) for i in range(len(rows))] == [
        ("share.com/wells/", None, "block"), ("com/", None, "allow"), (None, None, "allow"), (None, None, "allow"),
        (None, None, "allow"), (None, None, "allow"), (None, None, "allow"), (None, "*/*/tmp/", "block"),
        (None, "*/a*b", "block"), ("com/", None, "allow"), (None, None, "allow"), (None, "*/a*b", "block")]
    assert (got[0].host, got[0].path) == ("www.share.com", "/wells/1.tif")
    assert paths.judge_links(table.limit(0), rules).count() == 0


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1).max() == 1


def test_nearest_signatures(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(40, 16))
    vectors = (centres[draw.integers(0, 40, 2500)] + 0.4 * draw.normal(size=(2500, 16))).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(3000 + i, vectors[0]) for i in range(30)]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [float("nan")] * 16), (4004, [1.0, None]),
             (4005, [1.0]), (None, vectors[1]), (5, vectors[5])]
    table = spark.createDataFrame(rows, "cand_id long, signature array<double>")
    got = curves.nearest_signatures(table, F.col("cand_id") % 100 == 0).collect()
    ids = np.array([i for i in range(2500)] + [3000 + i for i in range(30)])
    mat = np.array([*vectors, *[vectors[0]] * 30])
    found = total = 0
    for q in [i for i in ids if i % 100 == 0]:
        d = np.sqrt(((mat - mat[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        own = sorted((r["rank"], r.cand_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert all(abs(s - d[ids == c][0]) < 1e-9 for _, c, s in own)
        found, total = found + len({c for _, c, _ in own} & set(best)), total + 10
    assert found >= 0.95 * total
    zero = sorted((r["rank"], r.cand_id) for r in got if r.query_id == 0)
    assert [c for _, c in zero] == [3000 + i for i in range(10)]
    few = curves.nearest_signatures(table.filter("cand_id < 4"), F.col("cand_id") == 0).collect()
    assert len(few) == 3 and curves.nearest_signatures(table.limit(0), F.lit(True)).count() == 0


def test_differencing_balances():
    draw = np.random.default_rng(2)
    for _ in range(40):
        sizes = draw.integers(1, 257, draw.integers(1, 500))
        window = packing.balanced(sizes, 1024)
        loads = np.bincount(window, weights=sizes)
        assert loads.max() <= 1024 and len(loads) <= -(-sizes.sum() // 1024) + 1
    sizes = np.array([8, 7, 6, 5, 4])
    assert sorted(np.bincount(packing.difference(sizes, 2), weights=sizes)) == [14, 16]


def test_packing(notes, nothing, plain_ids):
    got = packing.pack_notes(notes, TOKENIZER, PATTERN, 0).collect()
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.token_bytes) == 4 * r.length
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    whole = sorted(np.frombuffer(r.token_bytes, "<u4").tolist() for r in got if r.doc_tokens == r.length)
    short = sorted(i for i in (plain_ids(n) + [0] for _, n, _ in NOTES) if len(i) <= 256)
    assert [w for w in whole if len(w) <= 256] == short
    long = sorted((r.start, r.token_bytes) for r in got if r.position == 7)
    assert np.frombuffer(b"".join(bytes(b) for _, b in long), "<u4").tolist() == plain_ids(LONG) + [0]
    assert packing.pack_notes(nothing, TOKENIZER, PATTERN, 0).count() == 0
