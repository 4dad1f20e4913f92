"""Direction of linear structure and upright rotation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.operators import packed
from inkledger.operators.skew import salted_join
from inkledger.vocabulary import MIN_LINE_STRENGTH


# Groups of at most so many pixels are put in one row each; larger ones stay pixel by pixel.
WHOLE = 1 << 20
# Under so many pixels a group shows no direction.
FEWEST = 20


def angle_table(angles_deg: list[float]) -> list[tuple[float, float, float]]:
    return [(a, math.cos(math.radians(a)), math.sin(math.radians(a))) for a in angles_deg]


def _constant_angles(angles_deg: list[float]) -> Column:
    return F.array(*[
        F.struct(F.lit(float(a)).alias("angle"), F.lit(c).alias("c"), F.lit(s).alias("s"))
        for a, c, s in angle_table(angles_deg)
    ])


def _sharpness(ink: DataFrame, key: str, angles: Column) -> DataFrame:
    """Sharpness per angle of the array column ``angles`` (``angle, c, s``) of ``ink``.

    First the smallest projection per angle, then pixel counts per bin; both combine
    map-side. The minima of one group are an array as long as the angle list, so the way
    back is one salted join on the group. Empty bins between the extremes count as zero.
    """
    def project() -> Column:
        return F.col("y") * F.col("g.c") - F.col("x") * F.col("g.s")

    spread = ink.select(key, "y", "x", F.posexplode(angles).alias("a", "g"))
    lows = (
        spread.groupBy(key, "a").agg(F.min(project()).alias("low"), F.count(F.lit(1)).alias("n"))
        .groupBy(key)
        .agg(
            F.max("n").alias("_n"),
            F.map_from_entries(F.collect_list(F.struct("a", "low"))).alias("_low"),
        )
    )
    joined = salted_join(ink, lows, [key], "inner", weight="_n")
    counts = (
        joined.select(key, "_n", "y", "x", "_low", F.posexplode(angles).alias("a", "g"))
        .groupBy(key, "_n", "a", F.col("g.angle").alias("angle"),
                 F.floor(project() - F.col("_low")[F.col("a")]).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    stats = counts.groupBy(key, "_n", "a", "angle").agg(
        (F.max("bin") + 1).cast("double").alias("bins"), F.sum("n").alias("s1"),
        F.sum(F.col("n") * F.col("n")).alias("s2"),
    )
    mean = F.col("s1") / F.col("bins")
    variance = F.col("s2") / F.col("bins") - mean * mean
    return stats.select(
        key, "angle",
        F.when(F.col("_n") < 20, F.lit(0.0)).otherwise(variance / (mean * mean)).alias("sharpness"),
    )


def sharpness_of(y: np.ndarray, x: np.ndarray, turns: list[tuple[float, float]]) -> np.ndarray:
    """Sharpness of one group's pixels per (cosine, sine)."""
    out = np.zeros(len(turns))
    if len(y) < FEWEST:
        return out
    y, x = y.astype(float), x.astype(float)
    for a, (c, s) in enumerate(turns):
        along = y * c - x * s
        n = np.bincount(np.floor(along - along.min()).astype(np.int64))
        mean = len(y) / len(n)
        out[a] = (float((n * n).sum()) / len(n) - mean * mean) / (mean * mean)
    return out


def _by_size(ink: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Packed groups of at most WHOLE pixels, and the pixels of the others, if there are any."""
    if "px" in ink.columns:
        return ink, None
    ink = ink.select(key, "y", "x")
    large = ink.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > WHOLE).select(key)
    # At most rows / WHOLE keys, so they fit a broadcast.
    keys = [r[0] for r in large.collect()]
    if not keys:
        return packed.pack(ink, [key]), None
    named = F.broadcast(ink.sparkSession.createDataFrame([(k,) for k in keys], large.schema))
    return packed.pack(ink.join(named, key, "left_anti"), [key]), ink.join(named, key, "left_semi")


def projection_sharpness(ink: DataFrame, key: str, angles_deg: list[float]) -> DataFrame:
    """Normalised variance of the projected ink per (key, angle); under 20 pixels it is 0."""
    table = angle_table(angles_deg)
    angles, turns = np.array([float(a) for a, _, _ in table]), [(c, s) for _, c, s in table]
    whole, large = _by_size(ink, key)
    rows = packed.map_rows(whole, lambda y, x, f: (angles, sharpness_of(y, x, turns)), [key], "angle double, sharpness double")
    return rows if large is None else rows.unionByName(_sharpness(large, key, _constant_angles(angles_deg)))


def line_direction(ink: DataFrame, key: str, step_deg: float = 2.0, refine_deg: float = 0.5) -> DataFrame:
    """``angle`` (modulo 180) and ``strength`` (peak over median of the coarse scores).

    ``ink`` is ``key, y, x`` or packed (``key, px``). The fine pass projects each group around its own
    coarse peak. A group of at most WHOLE pixels is one row, projected where it lies.
    """
    coarse = angle_table([i * step_deg for i in range(int(round(180.0 / step_deg)))])
    steps = int(round(step_deg / refine_deg))
    turns = [(c, s) for _, c, s in coarse]

    def direct(y, x, f):
        first = sharpness_of(y, x, turns)
        at = int(first.argmax())  # the first maximum in angle order
        top, median = first[at], float(np.median(first))
        if top <= 0:
            return [[0.0], [0.0]]
        fine = angle_table([coarse[at][0] + i * refine_deg for i in range(-steps, steps + 1)])
        best = int(sharpness_of(y, x, [(c, s) for _, c, s in fine]).argmax())
        return [[fine[best][0] % 180.0], [top / median if median > 0 else 0.0]]

    whole, large = _by_size(ink, key)
    rows = packed.map_rows(whole.select(key, "px"), direct, [key], "angle double, strength double")
    return rows if large is None else rows.unionByName(_large_direction(large, key, step_deg, refine_deg))


def _large_direction(ink: DataFrame, key: str, step_deg: float, refine_deg: float) -> DataFrame:
    """``line_direction`` of groups of any size, pixel by pixel.

    The fine pass projects each group around its own coarse peak, so its angles are data:
    an array column holds the offsets' cosine and sine.
    """
    coarse_angles = [i * step_deg for i in range(int(round(180.0 / step_deg)))]
    coarse = _sharpness(ink.select(key, "y", "x"), key, _constant_angles(coarse_angles))
    # First maximum in angle order.
    picked = coarse.groupBy(key).agg(
        F.max(F.struct(F.col("sharpness"), (-F.col("angle")).alias("neg"))).alias("p"),
        F.median("sharpness").alias("median"),
    ).select(
        key, (-F.col("p.neg")).alias("peak"), F.col("p.sharpness").alias("top"), "median"
    )
    steps = int(round(step_deg / refine_deg))
    shifts = [i * refine_deg for i in range(-steps, steps + 1)]
    fine = fine_sharpness(ink, picked.select(key, "peak"), key, shifts)
    best = fine.groupBy(key).agg(
        F.max(F.struct(F.col("sharpness"), (-F.col("angle")).alias("neg")))["neg"].alias("neg")
    )
    zero = F.col("top") <= 0
    return picked.join(best, key, "left").select(
        key,
        F.when(zero, F.lit(0.0)).otherwise(F.pmod(-F.col("neg"), F.lit(180.0))).alias("angle"),
        F.when(zero | (F.col("median") <= 0), F.lit(0.0)).otherwise(F.col("top") / F.col("median")).alias("strength"),
    )


def fine_sharpness(ink: DataFrame, peaks: DataFrame, key: str, shifts: list[float]) -> DataFrame:
    """Sharpness at ``peak`` + each shift, per group; the angles are data here."""
    counted = peaks.join(ink.groupBy(key).agg(F.count(F.lit(1)).alias("_m")), key)
    pixels = salted_join(ink.select(key, "y", "x"), counted, [key], "inner", weight="_m").drop("_m")

    def turned(shift: float) -> Column:
        angle = F.col("peak") + F.lit(shift)
        return F.struct(
            angle.alias("angle"), F.cos(F.radians(angle)).alias("c"), F.sin(F.radians(angle)).alias("s")
        )

    return _sharpness(pixels, key, F.array(*[turned(s) for s in shifts]))


def upright_rotation(
    angle: Column, strength: Column, dial_angle: Column | None = None, upright_offset: float = 0.0,
    snap_deg: float = 90.0,
) -> Column:
    """Counter-clockwise degrees that stand an element up, or null.

    Text gives the answer modulo 180; the dial only breaks that tie, and serves alone when
    the text shows no direction.
    """
    base = F.bround(angle / snap_deg) * snap_deg if snap_deg > 0 else angle
    one = F.pmod(base, F.lit(360.0))
    other = F.pmod(base + 180.0, F.lit(360.0))
    dial = F.lit(None).cast("double") if dial_angle is None else dial_angle
    implied = F.lit(float(upright_offset)) - dial

    def distance(candidate: Column) -> Column:
        delta = F.pmod(candidate - implied, F.lit(360.0))
        return F.least(delta, F.lit(360.0) - delta)

    chosen = F.when(dial.isNull() | (distance(one) <= distance(other)), one).otherwise(other)
    return F.round(
        F.when(strength >= MIN_LINE_STRENGTH, chosen).otherwise(F.pmod(implied, F.lit(360.0))), 1
    )
