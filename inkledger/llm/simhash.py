"""Near copies of review notes by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints within the radius agree within radius // blocks on at least one block of
their bits. On every block a fingerprint emits all variants within half of that, so two close
blocks share a variant; those that meet on one are compared on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm.links import components
from inkledger.session import cut_lineage

BITS = 64
SEED = 42
# Fingerprints compared within one bucket. The members of fuller buckets go through balls over
# the whole word, which hold at most 2,081 distinct fingerprints for a radius of 4, or, where
# such balls are too large, meet in parts of half this size, each two parts in a group.
BUCKET = 4096


def fingerprint(note: str, shingle: int, bits: int = BITS) -> int:
    """SimHash: a bit is set if it is set in over half of the shingles' hashes.

    Bits past the 64th come from further hashes of the same shingles, with the next seeds.
    """
    words = note.encode().lower().split()  # bytes: only A-Z is lowered, only ASCII blanks cut
    if not words:
        return 0
    whole = 0
    for seed in range(bits // BITS):
        if len(words) <= shingle:
            shingles = [b" ".join(words)]
        else:
            shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED + seed)), np.uint64)
        set_in = np.zeros(BITS, np.int64)
        for at in range(0, len(hashes), 8192):
            part = hashes[at:at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
            set_in += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
        word = np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0]
        whole |= int(word) << (BITS * seed)
    return whole


def _column(prints: np.ndarray) -> pa.Array:
    """Fingerprints, rows of 64-bit words, as longs if they have one word and else as bytes."""
    if prints.shape[1] == 1:
        return pa.array(prints[:, 0].view(np.int64))
    whole = np.ascontiguousarray(prints)
    kind = pa.binary(8 * whole.shape[1])
    return pa.FixedSizeBinaryArray.from_buffers(
        kind, len(whole), [None, pa.py_buffer(whole)]).cast(pa.binary())


def _prints(column: pa.Array, words: int) -> np.ndarray:
    if words == 1:
        return column.to_numpy().view(np.uint64)[:, None]
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits."""
    return sum(np.bitwise_count(a[..., k] ^ b[..., k]) for k in range(a.shape[-1]))


def _distinct(prints: np.ndarray) -> np.ndarray:
    rows = prints[np.lexsort(prints.T)]
    return rows[np.r_[True, (rows[1:] != rows[:-1]).any(1)]]


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = b"".join(
            fingerprint(n or "", shingle, bits).to_bytes(bits // 8, "little") for n in batch[1].to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch[0], _column(np.frombuffer(found, np.uint64).reshape(-1, bits // BITS))],
            names=["position", "fingerprint"])


def fingerprints(records: DataFrame, shingle: int, position: str = "position",
                 notes: str = "notes", bits: int = BITS) -> DataFrame:
    """(position, fingerprint) of every record; a note without words has 0.

    A fingerprint of 64 bits is a signed long; a longer one is binary, least byte first.
    """
    rows = records.select(
        F.col(position).cast("long").alias("position"), F.col(notes).cast("string").alias("notes"))
    return rows.mapInArrow(lambda batches: _fingerprints(batches, shingle, bits),
                           f"position long, fingerprint {'long' if bits == BITS else 'binary'}")


def _block(prints: np.ndarray, first: int, end: int) -> np.ndarray:
    """Bits ``first`` to ``end`` of every fingerprint; they may lie in two words."""
    word, low = divmod(first, BITS)
    cut = prints[:, word] >> np.uint64(low)
    if low + end - first > BITS:
        cut |= prints[:, word + 1] << np.uint64(BITS - low)
    return cut & np.uint64((1 << (end - first)) - 1)


def _variants(batches: Iterator[pa.RecordBatch], bits: int, blocks: int, flips: int) -> Iterator[pa.RecordBatch]:
    """Every fingerprint under each variant of each block, as (block, variant, fingerprint)."""
    edges = [bits * k // blocks for k in range(blocks + 1)]
    plan = []
    for first, end in zip(edges, edges[1:]):
        turned = [sum(1 << k for k in some) for n in range(flips + 1) for some in combinations(range(end - first), n)]
        plan.append((first, end, np.array(turned, np.uint64)))
    for batch in batches:
        prints = _prints(batch[0], bits // BITS)
        for number, (first, end, turned) in enumerate(plan):
            step = max(1, 400_000 // len(turned))
            for at in range(0, len(prints), step):
                some = prints[at:at + step]
                keys = (_block(some, first, end)[:, None] ^ turned[None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), number, np.int32)), pa.array(keys.view(np.int64)),
                     _column(np.repeat(some, len(turned), axis=0))],
                    names=["block", "variant", "fingerprint"])


def _meet(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep one bucket's close fingerprints together: a tree, not all pairs."""
    n = len(prints)
    root = np.arange(n)
    while True:  # labels sink along links until they rest; rows in blocks
        before = root.copy()
        for at in range(0, n, 512):
            near = _apart(prints[at:at + 512, None], prints[None, :]) <= radius
            root[at:at + 512] = np.where(near, root[None, :], n).min(1)
        root = root[root]
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(n))
    return prints[moved], prints[root[moved]]


def _with_close(prints: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int) -> np.ndarray:
    """Which of these buckets of one batch hold two different close fingerprints."""
    hit = np.zeros(len(starts), bool)
    bucket = np.repeat(np.arange(len(starts)), ends - starts)
    at = np.arange(len(bucket)) + np.repeat(starts - np.r_[0, np.cumsum(ends - starts)[:-1]], ends - starts)
    step = 1
    while len(at):
        inside = (at + step < ends[bucket]) & ~hit[bucket]
        at, bucket = at[inside], bucket[inside]
        apart = _apart(prints[at], prints[at + step])
        hit[bucket[(apart <= radius) & (apart > 0)]] = True
        step += 1
    return hit


def _collide(batches: Iterator[pa.RecordBatch], words: int, radius: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """Buckets come sorted. Emits links (a, b); members of a full bucket as (a, null) with its key."""
    held: list[np.ndarray] = []  # of the bucket that is still open
    key = None
    full = False
    a_out, b_out = [], []

    def close():
        if held and not full:
            prints = _distinct(np.concatenate(held))
            if len(prints) > 1:
                a, b = _meet(prints, radius)
                a_out.append(a)
                b_out.append(b)

    def rows(block, variant, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        left = _column(a)
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * len(a), pa.int32()), pa.array([variant] * len(a), pa.int64()),
             left, pa.nulls(len(a), left.type) if b is None else _column(b)],
            names=["block", "variant", "a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        block = batch[0].to_numpy()
        variant, prints = batch[1].to_numpy(), _prints(batch[2], words)
        cuts = np.flatnonzero((np.diff(variant) != 0) | (np.diff(block) != 0)) + 1
        starts = np.r_[0, cuts].astype(np.int64)
        ends = np.r_[cuts, len(variant)].astype(np.int64)
        size = ends - starts
        inner = np.ones(len(starts), bool)
        inner[[0, -1]] = False  # the outer ones may go on in the batch before or after
        pair = (size == 2) & inner
        left, right = prints[starts[pair]], prints[starts[pair] + 1]
        apart = _apart(left, right)
        near = (apart <= radius) & (apart > 0)
        a_out.append(left[near])
        b_out.append(right[near])
        own = ~inner | (size > 2)
        # Most small buckets are chance meetings: they are looked through together.
        small = np.flatnonzero(inner & (size > 2) & (size <= 64))
        own[small] = _with_close(prints, starts[small], ends[small], radius)
        for s, e in zip(starts[own].tolist(), ends[own].tolist()):
            at = int(block[s]), int(variant[s])
            if at != key:
                close()
                held, key, full = [], at, False
            held.append(prints[s:e])
            if not full and sum(map(len, held)) > bucket:
                full = True
            if full:
                yield rows(*key, _distinct(np.concatenate(held)), None)
                held = []
        if sum(map(len, a_out)):
            yield rows(None, None, np.concatenate(a_out), np.concatenate(b_out))
        a_out, b_out = [], []
    close()
    if sum(map(len, a_out)):
        yield rows(None, None, np.concatenate(a_out), np.concatenate(b_out))


def _met(keyed: DataFrame, words: int, radius: int, bucket: int) -> DataFrame:
    """(block, variant, fingerprint) rows -> links and the members of full buckets."""
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = keyed.schema["fingerprint"].dataType.simpleString().replace("bigint", "long")
    return (
        keyed.repartition(tasks, "block", "variant").sortWithinPartitions("block", "variant")
        .mapInArrow(lambda b: _collide(b, words, radius, bucket),
                    f"block int, variant long, a {kind}, b {kind}")
    )


def _links(distinct: DataFrame, radius: int, bits: int, blocks: int, bucket: int) -> DataFrame:
    flips = -(-(radius // blocks) // 2)
    kind = "long" if bits == BITS else "binary"
    keyed = distinct.mapInArrow(lambda b: _variants(b, bits, blocks, flips),
                                f"block int, variant long, fingerprint {kind}")
    return _met(keyed, bits // BITS, radius, bucket)


def _full_buckets(crowd: DataFrame, radius: int, bits: int, bucket: int) -> DataFrame:
    """Links inside full buckets: parts of a bucket meet two by two, each meeting one group."""
    members = crowd.select("block", "variant", F.col("a").alias("fingerprint")).distinct()
    parts = members.groupBy("block", "variant").agg(
        F.ceil(2 * F.count("*") / F.lit(bucket)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    met = members.join(parts, ["block", "variant"]).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    named = F.xxhash64("block", "variant", low, high)  # should two names meet, they only compare more
    keyed = met.select("block", named.alias("variant"), "fingerprint")
    return _met(keyed, bits // BITS, radius, 1 << 62)


def near_copies(
    records: DataFrame, shingle: int = 5, radius: int = 4, blocks: int = 2,
    position: str = "position", notes: str = "notes", bucket: int = BUCKET, bits: int = BITS,
) -> DataFrame:
    """Groups of review notes whose fingerprints are linked within ``radius`` bits.

    ASCII letters are lowered, words are runs without ASCII white space, shingles are ``shingle``
    words in a row (a shorter note is one shingle). ``bits`` is a multiple of 64, and a block has
    64 of them at most. Returns position, fingerprint (see ``fingerprints``) and component_id, the least position that can be reached over links, its own included.
    Equal fingerprints are one node, so copies cost nothing; a note without words, null or
    empty, has fingerprint 0. Rows with a null position get the group's least other position;
    repeated rows are returned as often as they come. No cap: see BUCKET for full buckets.
    """
    prints = cut_lineage(fingerprints(records, shingle, position, notes, bits))
    classes = cut_lineage(prints.groupBy("fingerprint").agg(F.min("position").alias("first")))
    found = cut_lineage(_links(classes.select("fingerprint"), radius, bits, blocks, bucket))
    links, crowd = found.filter("b is not null").select("a", "b"), found.filter("b is null")
    if blocks > 1 and not crowd.isEmpty():
        if bits == BITS and blocks == 2:
            # Whole-word balls for the fingerprints of full buckets; these can't fill up.
            whole = crowd.select(F.col("a").alias("fingerprint")).distinct()
            more = _links(whole, radius, bits, 1, 1 << 62)
        else:
            more = _full_buckets(crowd, radius, bits, bucket)
        links = links.unionByName(more.filter("b is not null").select("a", "b"))
    groups = components(links.distinct())
    rooted = classes.join(groups.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("position", "fingerprint", "component_id")
