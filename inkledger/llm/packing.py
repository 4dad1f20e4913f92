"""Packing of notes into training windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm.tokens import encoder

# Bytes of notes in one group: about 250 windows of 1,024 ids.
GROUP_BYTES = 1 << 20
PIECES = "bin long, position long, start long, length long, doc_tokens long, token_bytes binary"
PLACED = ("position long, start long, length long, doc_tokens long, sequence_id long, "
          "offset long, token_bytes binary")


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window (0 .. windows-1) of every size, by multiway differencing.

    Every size begins as a partition of its own into ``windows`` parts, all but one empty.
    The two partitions with the largest spread between their parts are merged, the largest
    part of one with the smallest of the other, until one partition is left. While a partition
    has empty parts its spread is its largest part, so it takes in the next sizes one by one;
    such a row of merges is done at once.
    """
    n = len(sizes)
    if windows == 1 or n == 0:
        return np.zeros(n, np.int64)
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order].astype(np.int64)
    left, right = np.full(2 * n, -1), np.full(2 * n, -1)
    made, serial, at = n, 0, 0
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def push(sums: np.ndarray, nodes: np.ndarray) -> None:
        nonlocal serial
        # Only differences matter from here on, so the smallest part becomes zero.
        sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), serial, sums, nodes))
        serial += 1

    def take(count: int) -> tuple[np.ndarray, np.ndarray]:
        nonlocal at
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1)
        sums[:count], nodes[:count] = falling[at:at + count], order[at:at + count]
        at += count
        return sums, nodes

    def merge(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> None:
        nonlocal made
        nodes, other = one[1], two[1][::-1]
        sums = one[0] + two[0][::-1]
        both = np.flatnonzero((nodes >= 0) & (other >= 0))
        merged = np.where(nodes >= 0, nodes, other)
        fresh = np.arange(made, made + len(both))
        left[fresh], right[fresh], merged[both] = nodes[both], other[both], fresh
        made += len(both)
        falls = np.argsort(-sums, kind="stable")
        push(sums[falls], merged[falls])

    while at < n or len(heap) > 1:
        spread = -heap[0][0] if heap else -1
        if at < n and falling[at] >= spread:
            next_in_line = int(np.searchsorted(-falling[at:at + windows], -spread, side="right"))
            block = take(max(1, next_in_line))
            if heap and next_in_line < windows:
                merge(block, heapq.heappop(heap)[2:])
            else:
                push(*block)
        else:
            first = heapq.heappop(heap)[2:]
            if at < n and (not heap or falling[at] >= -heap[0][0]):
                merge(first, take(1))
            else:
                merge(first, heapq.heappop(heap)[2:])
    window = np.full(made, -1)
    nodes = heap[0][3]
    window[nodes[nodes >= 0]] = np.flatnonzero(nodes >= 0)
    links = zip(range(made - 1, n - 1, -1), left[n:made][::-1].tolist(), right[n:made][::-1].tolist())
    for node, a, b in links:
        window[a] = window[b] = window[node]
    return window[:n]


def balanced(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of near-equal sums, none above ``capacity``; as few as differencing manages."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, windows)
        if np.bincount(window, weights=sizes, minlength=1).max(initial=0) <= capacity:
            return window
        windows += 1


def _cutter(tokenizer: str, pattern: str, end_id: int, capacity: int, piece: int):
    schema = pa.schema([("bin", pa.int64()), ("position", pa.int64()), ("start", pa.int64()),
                        ("length", pa.int64()), ("doc_tokens", pa.int64()),
                        ("token_bytes", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, pattern)
        end, width = np.array([end_id], coder.dtype).tobytes(), coder.dtype.itemsize
        for batch in batches:
            rows, held = [], 0
            for group, position, note in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2]):
                packed = coder.packed(note.as_py() or "") + end
                total = len(packed) // width
                whole = total - total % capacity
                starts = list(range(0, whole, capacity))
                parts = -(-(total - whole) // piece)  # the rest, in even pieces
                starts += [whole + (total - whole) * k // parts for k in range(parts)]
                for start, stop in zip(starts, [*starts[1:], total]):
                    ids = np.frombuffer(packed, coder.dtype)[start:stop].astype("<u4").tobytes()
                    rows.append((group, position, start, stop - start, total, ids))
                    held += len(ids)
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return cut


def _placer(capacity: int):
    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["position", "start", "length", "token_bytes"],
                                  na_position="first", kind="stable", ignore_index=True)
        sizes = group["length"].to_numpy(np.int64)
        full = sizes == capacity
        window = np.zeros(len(group), np.int64)
        window[full] = np.arange(full.sum())
        window[~full] = full.sum() + balanced(sizes[~full], capacity)
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.flatnonzero(np.r_[True, np.diff(window[order]) > 0])
        base = np.repeat((ends - sizes[order])[first], np.diff(np.r_[first, len(group)]))
        offset = np.empty(len(group), np.int64)
        offset[order] = ends - sizes[order] - base
        group["sequence_id"] = (group["bin"].to_numpy(np.int64) << 32) + window
        group["offset"] = offset
        return group[[c.split()[0] for c in PLACED.split(", ")]]

    return place


def pack_notes(
    records: DataFrame, tokenizer: str, pattern: str, end_id: int, capacity: int = 1024,
    piece: int = 256, position: str = "position", notes: str = "notes",
) -> DataFrame:
    """Pack the notes of review records into sequences of at most ``capacity`` ids.

    A note is encoded whole and ended with ``end_id``. It fills sequences of ``capacity`` ids
    of its own first; what is left is cut into even pieces of at most ``piece`` ids, and the
    pieces of a group of notes are dealt to near-equal windows by multiway differencing. The
    number of windows starts at the least possible and rises while one exceeds ``capacity``.
    Groups are made by hash and grow in number, not in size, with the table.

    Returns one row per piece: position, start, length, doc_tokens (ids of its note),
    sequence_id, offset (in the sequence, gapless from 0), token_bytes (little-endian 32-bit
    ids). A null note is empty and gives the end id alone; null and repeated positions and
    repeated rows are packed like others; an empty table gives no rows.
    """
    rows = records.select(
        F.col(position).cast("long").alias("position"), F.col(notes).cast("string").alias("notes")
    )
    size = rows.agg(F.sum(F.octet_length("notes")), F.count("*")).first()
    groups = max(1, ((size[0] or 0) + 4 * size[1]) // GROUP_BYTES)
    # Copies of a note go to different groups by their position; equal rows share one, and
    # the text's hash spreads rows that all have the same position.
    keyed = rows.select(
        F.pmod(F.xxhash64("position", "notes"), F.lit(groups)).alias("bin"), "position", "notes"
    )
    pieces = keyed.mapInArrow(_cutter(tokenizer, pattern, end_id, capacity, piece), PIECES)
    return pieces.groupBy("bin").applyInPandas(_placer(capacity), PLACED)
