"""Centroids of angular signatures by exact k-means that skips most distances (ns-bounds)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.session import cut_lineage

# Whole numbers of a signature are below this, so that squared distances fit in 64 bits.
LARGEST = 1 << 28
# Relative room for the rounding of bounds, which are doubles.
SLACK = 1e-9
ROWS = 4096  # rows a task handles at once

STATE = "cand_id long, whole binary, cluster int, was int, bounds binary, seen binary"
_STATE = pa.schema([("cand_id", pa.int64()), ("whole", pa.binary()), ("cluster", pa.int32()),
                    ("was", pa.int32()), ("bounds", pa.binary()), ("seen", pa.binary())])
_MOVED = pa.schema([("cluster", pa.int32()), ("bin", pa.int32()), ("total", pa.int64())])


def _matrix(blobs: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), dtype).reshape(len(blobs), -1)


def _blobs(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def squared(whole: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = whole.astype(np.int64) - centroid
    return (apart * apart).sum(axis=1)


def nearest(
    whole: np.ndarray, cluster: np.ndarray, bounds: np.ndarray, seen: np.ndarray, history: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroid of every row; ties go to the smaller number.

    ``bounds[i, j]`` is the distance of row i to centroid j in round ``seen[i, j]``, when it was
    last computed, and ``history[t]`` holds the centroids of round t. Since then the centroid
    has moved by the norm of its total displacement, however it got there, so the distance now
    is within that of the stored one. Rows whose own centroid is surely the nearest are done;
    of the others the own distance is computed, and then those to the centroids that may still
    be as near. All decisions are made on exact squared distances. Returns the nearest
    centroids, the bounds and their rounds, and the number of distances computed.
    """
    now = len(history) - 1
    apart = (history[now] - history).astype(np.float64)
    drift = np.sqrt((apart * apart).sum(axis=2))  # round x centroid
    numbers = np.arange(history.shape[1])
    rows = np.arange(len(whole))
    low = (bounds - drift[seen, numbers]) * (1 - SLACK) - SLACK
    own = bounds[rows, cluster] + drift[seen[rows, cluster], cluster]
    own = own * (1 + SLACK) + SLACK
    low[rows, cluster] = np.inf
    open_rows = np.flatnonzero(low.min(axis=1) <= own)
    cluster, bounds, seen = cluster.copy(), bounds.copy(), seen.copy()
    # The far side of a stored distance never needs more than this one.
    exact = np.empty(len(open_rows), np.int64)
    for j in numbers:
        at = np.flatnonzero(cluster[open_rows] == j)
        exact[at] = squared(whole[open_rows[at]], history[now][j])
    bounds[open_rows, cluster[open_rows]], seen[open_rows, cluster[open_rows]] = np.sqrt(exact), now
    computed = len(open_rows)
    near = np.sqrt(exact) * (1 + SLACK) + SLACK
    best, best_number = exact, cluster[open_rows]
    may = low[open_rows] <= near[:, None]
    for j in numbers:
        at = np.flatnonzero(may[:, j])
        if not len(at):
            continue
        there = squared(whole[open_rows[at]], history[now][j])
        bounds[open_rows[at], j], seen[open_rows[at], j] = np.sqrt(there), now
        computed += len(at)
        wins = (there < best[at]) | ((there == best[at]) & (j < best_number[at]))
        best[at[wins]], best_number[at[wins]] = there[wins], j
    cluster[open_rows] = best_number
    return cluster, bounds, seen, computed


def _begin(history: np.ndarray):
    """Whole signatures to their first state: all distances are computed once."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            whole = _matrix(batch.column("whole"), "<i4")
            exact = np.stack([squared(whole, c) for c in history[0]], axis=1)
            cluster = exact.argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cand_id"), batch.column("whole"), pa.array(cluster),
                 pa.nulls(len(batch), pa.int32()), _blobs(np.sqrt(exact)),
                 _blobs(np.zeros(exact.shape, np.uint16))], schema=_STATE)

    return begin


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), ROWS):
            yield batch.slice(low, ROWS)


def _again(history: np.ndarray):
    """A state to that of the next round."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            whole = _matrix(batch.column("whole"), "<i4")
            before = batch.column("cluster").to_numpy()
            cluster, bounds, seen, _ = nearest(
                whole, before, _matrix(batch.column("bounds"), "<f8"),
                _matrix(batch.column("seen"), "<u2"), history)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cand_id"), batch.column("whole"), pa.array(cluster, pa.int32()),
                 batch.column("cluster"), _blobs(bounds), _blobs(seen)], schema=_STATE)

    return again


def _moves(k: int, bins: int):
    """Change of every cluster's sums (bin ``bins`` is its count), of the rows that moved."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, bins + 1), np.int64)
        for batch in _slices(batches):
            now, was = batch.column("cluster"), batch.column("was").fill_null(-1)
            now, was = now.to_numpy(), was.to_numpy()
            at = np.flatnonzero(now != was)
            if not len(at):
                continue
            whole = _matrix(batch.column("whole").take(pa.array(at)), "<i4").astype(np.int64)
            for j in range(k):
                for numbers, sign in ((now[at], 1), (was[at], -1)):
                    chosen = numbers == j
                    total[j, :bins] += sign * whole[chosen].sum(axis=0)
                    total[j, bins] += sign * int(chosen.sum())
        cluster, bin_ = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster, pa.int32()), pa.array(bin_, pa.int32()), pa.array(total[cluster, bin_])],
            schema=_MOVED)

    return moved


def whole_signatures(candidates: DataFrame, bins: int, scale: int) -> DataFrame:
    """``cand_id, whole``: signatures as whole numbers ``floor(scale * value)``, packed.

    Kept are those of exactly ``bins`` values, none of them null or not finite, whose numbers
    are below 2^28 in size.
    """
    limit = float("inf")
    scaled = F.transform("signature", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    shaped = candidates.select(F.col("cand_id").cast("long").alias("cand_id"), "signature").filter(
        (F.size("signature") == bins)
        & F.forall("signature", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(limit)))
    ).select("cand_id", scaled.alias("whole")).filter(
        F.forall("whole", lambda v: (v < F.lit(LARGEST)) & (v > F.lit(-LARGEST))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            if len(batch):
                flat = batch.column("whole").flatten().to_numpy().astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cand_id"), _blobs(flat.reshape(len(batch), -1))],
                    names=["cand_id", "whole"])

    return shaped.mapInArrow(pack, "cand_id long, whole binary")


def cluster_signatures(
    candidates: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, bins: int = 64,
    scale: int = 1024,
) -> DataFrame:
    """Group the angular signatures of ring candidates around ``k`` centroids, exactly.

    ``candidates`` has ``cand_id`` and ``signature`` (array of numbers). Signatures become whole
    numbers (see ``whole_signatures``). The centroids begin as the ``k`` signatures whose SHA-256
    of ``<seed>:<cand_id>`` (lowercase hex) is least, in that order. A round assigns every
    signature to its nearest centroid, ties to the smaller number, and sets each centroid that
    has any to the rounded-down mean of its signatures; after ``rounds`` rounds they are assigned
    once more. Stored distances are loosened by the norm of a centroid's total displacement since
    they were computed (``nearest``), so most are computed once in many rounds.

    Returns ``cand_id, cluster, distance`` (squared), ``cluster_inertia`` and ``inertia`` (distance
    summed over the cluster and over all) and ``centroid_sha256`` (of the final centroid's
    numbers, joined with commas). Signatures that are null, of another length, or with values
    that are null, not finite or 2^18 and more have no row. A null id is kept, but seeds nothing
    unless there is nothing else; repeated rows each count, equal seeds are told apart by their
    numbers; other columns take no part; an empty table, or one with fewer than ``k`` rows, has
    as many centroids as rows.

    Each round reads the state of the last one, which is cached next to the signatures and
    depends on it row by row: a lost executor's part is computed again from the written
    signatures. To the driver go the ``k`` seeds and ``k * bins`` sums a round.
    """
    spark = candidates.sparkSession
    rows = cut_lineage(whole_signatures(candidates.select("cand_id", "signature"), bins, scale))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("cand_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "whole").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "cand_id long, cluster int, distance long, "
                                         "cluster_inertia long, inertia long, centroid_sha256 string")
    history = np.stack([np.frombuffer(r["whole"], "<i4").astype(np.int64) for r in first])[None]
    k = len(first)
    sums = np.zeros((k, bins + 1), dtype=object)
    state = rows.mapInArrow(_begin(history), STATE).persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(rounds):
        moved = state.select("whole", "cluster", "was").mapInArrow(
            _moves(k, bins), "cluster int, bin int, total long")
        for r in moved.groupBy("cluster", "bin").agg(F.sum("total").alias("total")).collect():
            sums[r["cluster"], r["bin"]] += r["total"]
        now = [[int(s) // int(x[bins]) for s in x[:bins]] if x[bins] else list(old)
               for x, old in zip(sums, history[-1])]
        history = np.concatenate([history, np.array(now, np.int64)[None]])
        last, state = state, state.mapInArrow(_again(history), STATE).persist(StorageLevel.MEMORY_AND_DISK)
        state.count()
        last.unpersist()
    final = history[-1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            cluster = batch.column("cluster").to_numpy()
            apart = _matrix(batch.column("whole"), "<i4").astype(np.int64) - final[cluster]
            yield pa.RecordBatch.from_arrays(
                [batch.column("cand_id"), batch.column("cluster"), pa.array((apart * apart).sum(axis=1))],
                names=["cand_id", "cluster", "distance"])

    measured = cut_lineage(state.select("cand_id", "cluster", "whole").mapInArrow(
        measure, "cand_id long, cluster int, distance long"))
    state.unpersist()
    inertia = {r["cluster"]: int(r["total"]) for r in measured.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    # One array entry per centroid.
    of_cluster = F.array(*[F.lit(inertia.get(j)).cast("long") for j in range(k)])
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
                        for c in final.tolist()])
    return measured.select(
        "cand_id", "cluster", "distance", F.get(of_cluster, "cluster").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        F.get(digests, "cluster").alias("centroid_sha256"))
