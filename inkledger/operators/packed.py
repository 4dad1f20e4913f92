"""Rasters and crops as one row each: their pixels lie in an array, and numpy steps run over them.

A row per pixel costs a shuffle, a sort or a spill at every neighbourhood; a raster (a page band)
or crop is bounded by its physical size, so its pixels are put together once and every step reads
the array. Spark deals the rasters to tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows or pixels that a task holds before it hands them on.
HELD = 1 << 18


def pack(ink: DataFrame, by: list[str], y: str = "y", x: str = "x", keep: list[str] = ()) -> DataFrame:
    """``by``, the constant columns ``keep`` and ``px``, the array of pixels."""
    return ink.groupBy(*by).agg(
        *[F.max(c).alias(c) for c in keep],
        F.collect_list(F.struct(F.col(y).cast("int").alias("y"), F.col(x).cast("int").alias("x"))).alias("px"))


def crops(ink: DataFrame) -> DataFrame:
    """``crop_id, px`` of crop ink in either form."""
    return ink if "px" in ink.columns else pack(ink, ["crop_id"], "iy", "ix")


def _pixels(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, dict]]:
    """(row, y, x, the other columns) of every packed row; a null array is an empty one."""
    px = batch.column("px")
    ends = px.offsets.to_numpy()
    y, x = (px.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    names = [c for c in batch.schema.names if c != "px"]
    for i, facts in enumerate(zip(*(batch.column(c).to_pylist() for c in names)) if names else [()] * len(batch)):
        yield i, y[ends[i]:ends[i + 1]], x[ends[i]:ends[i + 1]], dict(zip(names, facts))


def map_rows(frame: DataFrame, fn: Callable, keep: list[str], made: str) -> DataFrame:
    """``fn(y, x, facts)`` gives the arrays of the ``made`` columns, none or any number of rows."""
    fresh = T.StructType.fromDDL(made)
    schema = T.StructType([*[frame.schema[c] for c in keep], *fresh.fields])
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in fresh]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, parts, held = [], [], 0

            def out() -> pa.RecordBatch:
                rows = pa.array(np.repeat(owner, [len(p[0]) for p in parts]).astype(np.int32))
                return pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(rows) for c in keep],
                     *[pa.array(np.concatenate(c), t) for c, t in zip(zip(*parts), types)]], names=schema.names)

            for i, y, x, facts in _pixels(batch):
                got = fn(y, x, facts)
                if got is not None and len(got[0]):
                    owner.append(i)
                    parts.append([np.asarray(g) for g in got])
                    held += len(parts[-1][0])
                if held > HELD:
                    yield out()
                    owner, parts, held = [], [], 0
            if parts:
                yield out()

    return frame.mapInArrow(run, schema)


def map_pixels(frame: DataFrame, fn: Callable, keep: list[str]) -> DataFrame:
    """``fn(y, x, facts)`` says which pixels stay; rows without any go."""
    schema = T.StructType([*[frame.schema[c] for c in keep], frame.schema["px"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, ys, xs = [], [], []
            for i, y, x, facts in _pixels(batch):
                stay = fn(y, x, facts)
                if stay.any():
                    owner.append(i)
                    ys.append(y[stay])
                    xs.append(x[stay])
            if owner:
                ends = pa.array(np.cumsum([0, *map(len, ys)]), pa.int32())
                px = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate(v), pa.int32()) for v in (ys, xs)], names=["y", "x"])
                rows = pa.array(owner, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(rows) for c in keep], pa.ListArray.from_arrays(ends, px)],
                    names=schema.names)

    return frame.mapInArrow(run, schema)


class Rasters:
    """Packed rasters and the steps that the operators of ``raster`` and ``hough`` left for them.

    A step is ``fn(state, facts)``; ``state`` holds the raster's ``ink`` and what earlier steps put there.
    """

    def __init__(self, frame: DataFrame, by: list[str], steps: list[Callable] = ()):
        self.frame, self.by, self.steps = frame, by, list(steps)

    def then(self, step: Callable, **facts: Column) -> Rasters:
        return Rasters(self.with_facts(**facts).frame if facts else self.frame, self.by, [*self.steps, step])

    def with_facts(self, **facts: Column) -> Rasters:
        return Rasters(self.frame.withColumns(facts), self.by, self.steps)

    def rows(self, made: str, last: Callable, keep: list[str]) -> DataFrame:
        """Rows that ``last(state, facts)`` makes of every raster once all steps are done."""
        steps = self.steps

        def run(y, x, facts):
            state = {"ink": np.zeros((facts["height"], facts["width"]), bool)}
            state["ink"][y, x] = True
            for step in steps:
                step(state, facts)
            return last(state, facts)

        return map_rows(self.frame, run, keep, made)


# ------------------------------------------------------------------------ array steps

def _on_runs(ink: np.ndarray, run: int, thickness: int) -> np.ndarray:
    """Cells on runs of at least ``run`` cells along the rows, each thickened across."""
    fat = np.zeros((ink.shape[0], ink.shape[1] + 1), bool)  # a blank column ends every row
    for d in range(-(thickness // 2), thickness - thickness // 2):
        low, high = max(0, d), ink.shape[0] + min(0, d)
        fat[low:high, :-1] |= ink[low - d:high - d]
    turns = np.flatnonzero(np.diff(np.r_[False, fat.ravel()]))
    begins, ends = turns[::2], turns[1::2]
    long = ends - begins >= run
    marks = np.zeros(fat.size + 1, np.int8)
    marks[begins[long]], marks[ends[long]] = 1, -1
    return np.cumsum(marks[:-1], dtype=np.int8).reshape(fat.shape)[:, :-1] > 0


def on_lines(ink: np.ndarray, run: int, thickness: int = 3) -> np.ndarray:
    """Ink on long horizontal or vertical runs."""
    return ink & (_on_runs(ink, run, thickness) | _on_runs(ink.T, run, thickness).T)


def off_lines(y: np.ndarray, x: np.ndarray, run: int) -> np.ndarray:
    """Which of a crop's pixels lie on no long line."""
    if not len(y):
        return np.zeros(0, bool)
    at_y, at_x = y - y.min(), x - x.min()
    ink = np.zeros((at_y.max() + 1, at_x.max() + 1), bool)
    ink[at_y, at_x] = True
    return ~on_lines(ink, run)[at_y, at_x]


def edges(ink: np.ndarray) -> np.ndarray:
    """Ink beside a blank cell of the raster; outside counts as ink."""
    h, w = ink.shape
    wide = np.pad(ink, 1, constant_values=True)
    inner = np.ones_like(ink)
    for dy in range(3):
        for dx in range(3):
            inner &= wide[dy:dy + h, dx:dx + w]
    return ink & ~inner


def normals(ink: np.ndarray, edge: np.ndarray, kernels: list[tuple[int, float, float]]) -> tuple[np.ndarray, ...]:
    """(y, x, nx, ny) of the edge cells: the unit gradient, outside blank."""
    reach = max(d for d, _, _ in kernels)
    wide = np.pad(ink, reach).astype(np.float64)
    across = ink.shape[1]
    a, b = np.zeros((wide.shape[0], across)), np.zeros((wide.shape[0], across))
    for d, slope, smooth in kernels:
        shifted = wide[:, reach + d:reach + d + across]
        a += slope * shifted
        b += smooth * shifted
    y, x = np.nonzero(edge)
    gx, gy = np.zeros(len(y)), np.zeros(len(y))
    for d, slope, smooth in kernels:
        gx += a[y + reach + d, x] * smooth
        gy += b[y + reach + d, x] * slope
    size = np.maximum(np.sqrt(gx * gx + gy * gy), 1e-6)
    return y, x, gx / size, gy / size


def votes_of(found: tuple[np.ndarray, ...], radius: float, shape: tuple[int, int]) -> np.ndarray:
    """Votes per cell: each edge cell votes at +R and -R along its normal."""
    y, x, nx, ny = found
    total = np.zeros(shape[0] * shape[1], np.int64)
    for reach in (radius, -radius):
        cy, cx = np.rint(y + reach * ny).astype(np.int64), np.rint(x + reach * nx).astype(np.int64)
        inside = (cy >= 0) & (cy < shape[0]) & (cx >= 0) & (cx < shape[1])
        total += np.bincount(cy[inside] * shape[1] + cx[inside], minlength=total.size)
    return total.reshape(shape)


def window_sums(cells: np.ndarray, half: int) -> np.ndarray:
    """Sum of the square window around every cell, inside the raster."""
    for _ in range(2):
        run = np.pad(np.cumsum(cells, axis=1), ((0, 0), (1, 0)))
        at = np.arange(cells.shape[1])
        cells = (run[:, np.minimum(at + half + 1, cells.shape[1])] - run[:, np.maximum(at - half, 0)]).T
    return cells


def window_maxima(cells: np.ndarray, half: int) -> np.ndarray:
    """Maximum of the square window around every cell, by windows of doubling length."""
    length = 2 * half + 1
    for _ in range(2):
        width, held = cells.shape[1], 1
        best = np.pad(cells, ((0, 0), (half, half)))
        while 2 * held <= length:
            best = np.maximum(best[:, :-held], best[:, held:])
            held *= 2
        if held < length:
            best = np.maximum(best[:, :best.shape[1] - (length - held)], best[:, length - held:])
        cells = best[:, :width].T
    return cells
