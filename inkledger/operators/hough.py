"""Ring candidates by gradient voting."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.operators import packed, suppression
from inkledger.operators.raster import box_scatter, spread_runs


def cast_votes(normals: DataFrame, by: list[str], radii: list[float] | None = None) -> DataFrame:
    """Votes per (radius, centre): each edge pixel votes at +R and -R along its normal.

    ``radii`` is a constant list, or the input has an array column ``radii``. Counting
    combines map-side. ``normals`` needs the raster's ``width`` and ``height``.
    """
    listed = F.col("radii") if radii is None else F.array(*[F.lit(float(r)) for r in radii])
    if isinstance(normals, packed.Rasters):
        # One radius at a time is held, so the votes are cast as they are asked for.
        return normals.then(lambda state, facts: state.update(votes=(
            (r, packed.votes_of(state["normals"], r, state["ink"].shape)) for r in facts["radii"])), radii=listed)
    cast = normals.select(
        *by, "y", "x", "nx", "ny", "width", "height", F.explode(listed).alias("radius")
    ).withColumn("_sign", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    reach = F.col("_sign") * F.col("radius")
    hit = cast.select(
        *by, "radius", "width", "height",
        F.rint(F.col("y") + reach * F.col("ny")).cast("int").alias("cy"),
        F.rint(F.col("x") + reach * F.col("nx")).cast("int").alias("cx"),
    ).filter("cx >= 0 and cx < width and cy >= 0 and cy < height")
    return hit.groupBy(*by, "radius", "cy", "cx").agg(
        F.count(F.lit(1)).alias("votes"), F.max("width").alias("width"), F.max("height").alias("height")
    )


def gather_size(radius: float, fraction: float = 0.22) -> int:
    return max(1, max(3, round(fraction * radius)) | 1)


def gather_votes(votes: DataFrame, by: list[str], fraction: float = 0.22) -> DataFrame:
    """Window sum of the vote cloud; the window grows with the radius and is odd.

    Separable: along x, then along y, each by adding up steps (``raster.spread_runs``), so its cost
    does not grow with the radius. Cells outside the raster take no part.
    """
    if isinstance(votes, packed.Rasters):
        def gather(state: dict, facts: dict) -> None:
            cast = state["votes"]
            state["votes"] = ((r, packed.window_sums(v, max(3, round(fraction * r)) // 2)) for r, v in cast)

        return votes.then(gather)
    size = F.greatest(F.lit(3), F.bround(F.lit(fraction) * F.col("radius")).cast("int"))
    half = F.floor(size / 2).cast("int")
    keys = [*by, "radius", "width", "height"]

    def pass_over(rows: DataFrame, axis: str, other: str, extent: str) -> DataFrame:
        runs = rows.select(
            *keys, other, F.greatest(F.lit(0), F.col(axis) - half).alias("_from"),
            F.least(F.col(extent) - 1, F.col(axis) + half).alias("_to"), F.col("votes").alias("v"))
        return spread_runs(runs, [*keys, other], axis).withColumnRenamed("v", "votes")

    gathered = pass_over(pass_over(votes, "cx", "cy", "width"), "cy", "cx", "height")
    return gathered.select(*by, "radius", "cy", "cx", "votes", "width", "height")


def peaks(gathered: DataFrame, by: list[str], min_vote_fraction: float = 0.25, edge_stride: int = 1) -> DataFrame:
    """Cells above the vote threshold that no cell nearby exceeds.

    The threshold comes first, so only the few strong cells are exploded for the
    neighbourhood maximum; a stronger neighbour is above the threshold as well.
    """
    if isinstance(gathered, packed.Rasters):
        def strongest(state: dict, facts: dict):
            rows = []
            for r, v in state["votes"]:
                v = np.where(v >= min_vote_fraction * (2.0 * math.pi * r / max(1, edge_stride)), v, 0)
                if v.any():
                    cy, cx = np.nonzero((v > 0) & (v >= packed.window_maxima(v, max(3, round(r * 0.6)))))
                    rows.append((np.full(len(cy), r), cy, cx, v[cy, cx].astype(float)))
            return [np.concatenate(c) for c in zip(*rows)] if rows else None

        return gathered.rows("radius double, cy int, cx int, votes double", strongest, by)
    expected = F.lit(2.0 * math.pi) * F.col("radius") / F.lit(float(max(1, edge_stride)))
    strong = gathered.filter(F.col("votes") >= F.lit(min_vote_fraction) * expected)
    half = F.greatest(F.lit(3), F.bround(F.col("radius") * 0.6).cast("int"))
    keys = [*by, "radius"]
    rows = strong.select(*keys, "cy", "cx", F.col("votes").alias("best"), F.col("votes").alias("own"))
    for axis in ("cx", "cy"):
        spread = rows.select(*keys, "cy", "cx", "best", "own", F.explode(F.sequence(-half, half)).alias("_d"))
        spread = spread.withColumn("own", F.when(F.col("_d") == 0, F.col("own"))).withColumn(axis, F.col(axis) + F.col("_d"))
        rows = spread.groupBy(*keys, "cy", "cx").agg(F.max("best").alias("best"), F.max("own").alias("own"))
    return rows.filter("own >= best").select(*keys, "cy", "cx", F.col("own").cast("double").alias("votes"))


def greedy_suppression(candidates: DataFrame, by: list[str], min_sep: str, cap: int | None = None) -> DataFrame:
    """Strongest first, drop everything within ``min_sep`` (a column) of a kept one.

    Without ``cap`` all that are left stay; with it only the strongest of a group do.
    """
    kept = suppression.independent(candidates, by, min_sep)
    return kept if cap is None else suppression.strongest(kept, by, cap)


def lift(candidates: DataFrame, factor: str, x0: str, y0: str) -> DataFrame:
    """Band-relative decimated coordinates -> native page pixels."""
    f = F.col(factor)
    return candidates.withColumns({
        "cx": F.col("cx") * f + F.col(x0), "cy": F.col("cy") * f + F.col(y0), "radius": F.col("radius") * f,
    })


def box_sum(cells: DataFrame, by: list[str], size: int) -> DataFrame:
    """Sum of ``v`` over an odd window around every cell."""
    half = (max(1, size | 1)) // 2
    return box_scatter(cells, by, list(range(-half, half + 1)))
