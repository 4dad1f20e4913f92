"""Polar resampling of ink around candidates, as a relational job."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.vocabulary import POLAR_RANGE, STAMP_BANDS


def linspace(lo: float, hi: float, n: int) -> list[float]:
    return [lo] if n == 1 else [lo + (hi - lo) * i / (n - 1) for i in range(n)]


def polar_sample(
    candidates: DataFrame, ink: DataFrame, r_lo: float, r_hi: float, n_r: int, n_theta: int
) -> DataFrame:
    """Bilinear samples ``cand_id, r_i, theta_i, r_frac, ink``; outside the ink reads 0.

    ``candidates``: ``cand_id, page_id, cx, cy, radius``. Every sample looks up four pixels
    by equality. Angles are constants with their cosine and sine, so the grid is an
    explode of literals and costs no join.
    """
    radii = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(r).alias("r")) for i, r in enumerate(linspace(r_lo, r_hi, n_r))
    ])
    turns = [2.0 * math.pi * i / n_theta for i in range(n_theta)]
    angles = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(math.cos(a)).alias("c"), F.lit(math.sin(a)).alias("s"))
        for i, a in enumerate(turns)
    ])
    samples = (
        candidates.select("cand_id", "page_id", "cx", "cy", "radius", F.explode(radii).alias("g"))
        .select("*", F.explode(angles).alias("a"))
        .select(
            "cand_id", "page_id", F.col("g.i").alias("r_i"), F.col("g.r").alias("r_frac"), F.col("a.i").alias("theta_i"),
            (F.col("cx") + F.col("g.r") * F.col("radius") * F.col("a.c")).alias("sx"),
            (F.col("cy") + F.col("g.r") * F.col("radius") * F.col("a.s")).alias("sy"),
        )
        .withColumns({"x0": F.floor("sx").cast("int"), "y0": F.floor("sy").cast("int")})
        .withColumns({"fx": F.col("sx") - F.col("x0"), "fy": F.col("sy") - F.col("y0")})
    )
    one = F.lit(1.0)
    fx, fy = F.col("fx"), F.col("fy")
    corners = F.array(*[
        F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), w.alias("w"))
        for dy, dx, w in (
            (0, 0, (one - fx) * (one - fy)), (0, 1, fx * (one - fy)),
            (1, 0, (one - fx) * fy), (1, 1, fx * fy),
        )
    ])
    looked_up = samples.select(
        "cand_id", "page_id", "r_i", "r_frac", "theta_i", "y0", "x0", F.explode(corners).alias("k")
    ).select(
        "cand_id", "page_id", "r_i", "r_frac", "theta_i", F.col("k.w").alias("w"),
        (F.col("y0") + F.col("k.dy")).alias("y"), (F.col("x0") + F.col("k.dx")).alias("x"),
    )
    hit = looked_up.join(ink.select("page_id", "y", "x", F.lit(1.0).alias("on")), ["page_id", "y", "x"], "left")
    return hit.groupBy("cand_id", "r_i", "theta_i").agg(
        F.max("r_frac").alias("r_frac"), F.sum(F.col("w") * F.coalesce("on", F.lit(0.0))).alias("ink")
    )


def radial_profile(polar: DataFrame) -> DataFrame:
    return polar.groupBy("cand_id", "r_i").agg(F.avg("ink").alias("ink"))


def angular_signature(polar: DataFrame, band: tuple[float, float]) -> DataFrame:
    """Mean ink over a radial band per angle; an empty band falls back on all radii."""
    inside = (F.col("r_frac") >= band[0]) & (F.col("r_frac") <= band[1])
    return polar.groupBy("cand_id", "theta_i").agg(
        F.coalesce(F.avg(F.when(inside, F.col("ink"))), F.avg("ink")).alias("v")
    )


def ring_completeness(
    polar: DataFrame, band: tuple[float, float] = STAMP_BANDS["ring"], min_ink: float = 0.25
) -> DataFrame:
    """Share of angles at which the ring carries ink."""
    return angular_signature(polar, band).groupBy("cand_id").agg(
        F.avg((F.col("v") >= min_ink).cast("int")).alias("ring_completeness")
    )


def stamp_polar(candidates: DataFrame, ink: DataFrame, n_r: int = 56, n_theta: int = 360) -> DataFrame:
    return polar_sample(candidates, ink, *POLAR_RANGE, n_r, n_theta)


def disc(ink: DataFrame, cx: Column, cy: Column, radius: Column) -> DataFrame:
    """Ink inside a disc."""
    dx, dy = F.col("x") - cx, F.col("y") - cy
    return ink.filter(dx * dx + dy * dy <= radius * radius)
