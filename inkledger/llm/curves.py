"""Nearest signatures over several shifted Hilbert orderings of projected vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkledger.llm.hilbert import hilbert_keys
from inkledger.session import cut_lineage

# Rows the curves' key ranges are fitted on, at most; every row is indexed.
FIT_ROWS = 4096
ORDERINGS = 32
PROJECTED = 12
CELL_BITS = 5
# Key ranges per ordering; a query searches its own and the two beside it.
RANGES = 64
LEAST_PER_RANGE = 128
# Rows of one range that one task compares; fuller ranges are split by a hash.
RANGE_ROWS = 100_000


@dataclass
class CurveIndex:
    """Projections, shifts and key bounds of all orderings."""

    turns: np.ndarray  # orderings x dims x projected
    low: np.ndarray
    span: np.ndarray
    shifts: np.ndarray
    bounds: list[np.ndarray]

    def keys(self, vectors: np.ndarray, t: int) -> np.ndarray:
        """Hilbert keys in the ordering's doubled, shifted grid."""
        at = (vectors @ self.turns[t] - self.low[t]) / (2 * self.span[t]) + self.shifts[t]
        cells = np.clip(np.floor(at * (1 << CELL_BITS)), 0, (1 << CELL_BITS) - 1).astype(np.int64)
        return hilbert_keys(cells, CELL_BITS)

    def ranges(self, vectors: np.ndarray, t: int) -> np.ndarray:
        return np.searchsorted(self.bounds[t], self.keys(vectors, t), side="right")


def fit_curves(sample: np.ndarray, ranges: int, orderings: int = ORDERINGS, seed: int = 3) -> CurveIndex:
    draw = np.random.default_rng(seed)
    dims = sample.shape[1]
    wide = min(PROJECTED, dims)
    turns = np.stack([np.linalg.qr(draw.normal(size=(dims, wide)))[0] for _ in range(orderings)])
    x = np.einsum("nd,tdp->tnp", sample, turns)
    low, high = x.min((1, 2)), x.max((1, 2))
    index = CurveIndex(turns, low, np.maximum(high - low, 1e-12),
                       draw.uniform(0, 0.5, (orderings, wide)), [])
    for t in range(orderings):
        keys = np.sort(index.keys(sample, t))
        index.bounds.append(keys[[len(keys) * k // ranges for k in range(1, ranges)]])
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _count(batches: Iterator[pa.RecordBatch], held, ranges: int) -> Iterator[pa.RecordBatch]:
    index = held.value
    total = np.zeros(len(index.bounds) * ranges, np.int64)
    for batch in batches:
        if len(batch):
            vectors = _matrix(batch[0])
            for t in range(len(index.bounds)):
                total += np.bincount(t * ranges + index.ranges(vectors, t), minlength=len(total))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(total))), pa.array(total)], names=["slot", "n"])


_ROUTED = "slot int, part int, kind int, cand_id long, signature binary"


def _route(batches: Iterator[pa.RecordBatch], held, ranges: int, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows to the part of their range; queries to all parts of three ranges."""
    index = held.value
    for whole in batches:
        for at in range(0, len(whole), 2000):
            batch = whole.slice(at, 2000)
            ids, asked = batch[0].to_numpy(), batch[1].to_numpy(zero_copy_only=False)
            vectors = _matrix(batch[2])
            raw = np.ascontiguousarray(vectors, "<f8")
            blobs = pa.array([r.tobytes() for r in raw], pa.binary())
            for t in range(len(index.bounds)):
                own = index.ranges(vectors, t)
                slot = t * ranges + own
                part = (ids * 0x9E3779B1 >> 7) % parts[slot]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot, pa.int32()), pa.array(part, pa.int32()),
                     pa.array(np.ones(len(ids), np.int32)), batch[0], blobs],
                    names=["slot", "part", "kind", "cand_id", "signature"])
                to = [(t * ranges + r, p, i) for i in np.flatnonzero(asked).tolist()
                      for r in range(max(0, own[i] - 1), min(ranges, own[i] + 2))
                      for p in range(parts[t * ranges + r])]
                if to:
                    slots, ps, which = map(np.array, zip(*to))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slots, pa.int32()), pa.array(ps, pa.int32()),
                         pa.array(np.zeros(len(to), np.int32)), batch[0].take(pa.array(which)),
                         blobs.take(pa.array(which))],
                        names=["slot", "part", "kind", "cand_id", "signature"])


def _rerank(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range, part and kind: a part's queries, then its rows."""
    key = None
    asked: list[np.ndarray] = []
    asked_ids: list[np.ndarray] = []
    best_d = best_i = None

    def result():
        if best_d is None:
            return None
        ids = np.concatenate(asked_ids)
        q, c = np.nonzero(np.isfinite(best_d))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[q]), pa.array(best_i[q, c]), pa.array(np.sqrt(best_d[q, c]))],
            names=["query_id", "cand_id", "score"])

    for batch in batches:
        if not len(batch):
            continue
        slot, part, kind = (batch[c].to_numpy().astype(np.int64) for c in range(3))
        ids = batch[3].to_numpy()
        vectors = np.frombuffer(b"".join(batch[4].to_pylist()), "<f8").reshape(len(batch), -1)
        name = (slot << 32) + (part << 1) + kind
        cuts = np.r_[0, np.flatnonzero(np.diff(name)) + 1, len(batch)]
        for s, e in zip(cuts.tolist(), cuts[1:].tolist()):
            at = slot[s], part[s]
            if at != key:
                if (done := result()) is not None:
                    yield done
                key, asked, asked_ids, best_d, best_i = at, [], [], None, None
            if kind[s] == 0:
                asked.append(vectors[s:e])
                asked_ids.append(ids[s:e])
                continue
            if not asked:
                continue
            q = np.concatenate(asked)
            if best_d is None:
                best_d = np.full((len(q), k), np.inf)
                best_i = np.zeros((len(q), k), np.int64)
            for a in range(s, e, 2048):
                b = min(e, a + 2048)
                some, some_ids = vectors[a:b], ids[a:b]
                for f in range(0, len(q), 512):
                    # A quick bound by a product, then the exact distance of what may enter.
                    part_q = q[f:f + 512]
                    rough = ((part_q**2).sum(1)[:, None] + (some**2).sum(1)[None] - 2 * part_q @ some.T)
                    worst = best_d[f:f + 512].max(1)
                    near = min(k, b - a)
                    pick = np.argpartition(rough, near - 1, axis=1)[:, :near] if near < b - a else \
                        np.tile(np.arange(b - a), (len(part_q), 1))
                    edge = np.take_along_axis(rough, pick, 1).max(1)
                    slack = 1e-9 * (1 + np.abs(edge))
                    rows, cols = np.nonzero(rough <= np.minimum(edge + slack, worst + slack)[:, None])
                    if not len(rows):
                        continue
                    exact = ((part_q[rows] - some[cols]) ** 2).sum(1)
                    _merge(best_d[f:f + 512], best_i[f:f + 512], rows, exact, some_ids[cols])
    if (done := result()) is not None:
        yield done


def _merge(best_d: np.ndarray, best_i: np.ndarray, rows: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
    """Put new (row, distance, id) among each row's best; ties go to smaller ids."""
    k = best_d.shape[1]
    touched = np.unique(rows)
    all_r = np.r_[np.repeat(touched, k), rows]
    all_d = np.r_[best_d[touched].ravel(), d]
    all_i = np.r_[best_i[touched].ravel(), ids]
    order = np.lexsort((all_i, all_d, all_r))
    all_r, all_d, all_i = all_r[order], all_d[order], all_i[order]
    first = np.searchsorted(all_r, touched)
    take = first[:, None] + np.arange(k)
    best_d[touched], best_i[touched] = all_d[take], all_i[take]


def nearest_signatures(
    signatures: DataFrame, is_query: Column, k: int = 10, key: str = "cand_id",
    signature: str = "signature", orderings: int = ORDERINGS,
) -> DataFrame:
    """The k nearest signatures of every queried candidate, by Euclidean distance.

    Vectors are projected at random several times; each projection is shifted and laid along
    a Hilbert curve, whose key ranges (fitted on FIT_ROWS rows) deal the rows to tasks. A query
    is compared, in double precision, with all rows of its own and the two neighbouring
    ranges, and the orderings' finds are merged. Equal vectors are one node, with their
    members put back at the end, so copies cannot fill a range.

    Returns query_id, rank (from 1), cand_id and score, nearest first, ties to smaller ids. A
    vector that is null, empty, zero, has null or non-finite entries or another length than most takes
    no part; rows with a null or repeated key: null takes no part, repeats count once. With
    at most k others all are returned; an empty table gives no rows.
    """
    spark = signatures.sparkSession
    vec = F.col(signature).cast("array<double>")
    rows = signatures.select(
        F.col(key).cast("long").alias("cand_id"), vec.alias("signature"), is_query.alias("asked")
    ).filter(
        F.col("cand_id").isNotNull() & (F.size("signature") > 0)
        & F.forall("signature", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("signature", lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("signature").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    shape = "query_id long, rank int, cand_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], shape)
    # 0.0 and -0.0 are one value.
    rows = rows.filter(F.size("signature") == lengths["n"]).withColumn(
        "signature", F.transform("signature", lambda x: x + F.lit(0.0)))
    rows = rows.withColumn("_h", F.xxhash64("signature"))
    nodes = cut_lineage(rows.groupBy("_h", "signature").agg(
        F.min("cand_id").alias("node"), F.max("asked").alias("asked")))
    n_nodes = nodes.count()
    sample = np.array([r[0] for r in nodes.orderBy(F.xxhash64("node")).limit(FIT_ROWS)
                       .select("signature").collect()], np.float64)
    ranges = max(1, min(RANGES, n_nodes // LEAST_PER_RANGE))
    index = fit_curves(sample, ranges, orderings)
    held = spark.sparkContext.broadcast(index)  # of fixed size
    counts = np.zeros(orderings * ranges, np.int64)
    # As many rows as there are key ranges.
    for r in nodes.select("signature").mapInArrow(
            lambda b: _count(b, held, ranges), "slot long, n long").groupBy("slot").agg(
            F.sum("n").alias("n")).collect():
        counts[r["slot"]] = r["n"]
    parts = np.maximum(1, -(-counts // RANGE_ROWS))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(parts.sum()) // 32)
    found = (
        nodes.select("node", "asked", "signature")
        .mapInArrow(lambda b: _route(b, held, ranges, parts), _ROUTED)
        .repartition(tasks, "slot", "part").sortWithinPartitions("slot", "part", "kind", "cand_id")
        .mapInArrow(lambda b: _rerank(b, k + 1), "query_id long, cand_id long, score double")
        .groupBy("query_id", "cand_id").agg(F.min("score").alias("score"))
    )
    by_query = Window.partitionBy("query_id").orderBy("score", "cand_id")
    near = found.withColumn("_n", F.row_number().over(by_query)).filter(F.col("_n") <= k + 1).select(
        F.col("query_id").alias("_q"), F.col("cand_id").alias("_c"), "score")
    # Members of the nodes found: the k + 1 least ids of each are enough.
    named = rows.join(nodes.select("_h", "signature", "node"), ["_h", "signature"]).select(
        "cand_id", "node", "asked").distinct()
    first = Window.partitionBy("node").orderBy("cand_id")
    members = named.withColumn("_m", F.row_number().over(first)).filter(F.col("_m") <= k + 1)
    asked = named.filter("asked").select(F.col("cand_id").alias("query_id"), F.col("node").alias("_q"))
    full = near.join(members.select(F.col("node").alias("_c"), "cand_id"), "_c")
    pairs = asked.join(full, "_q").filter("query_id <> cand_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "cand_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "cand_id", "score")
