"""Verification of ring candidates on native-resolution crops, as relations of their ink."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions import geometry as geo
from inkledger.operators import orientation, packed, search
from inkledger.session import cut_lineage
from inkledger.vocabulary import POLAR_RANGE, STAMP_BANDS

TILE = 256
DISC = 0.62  # writing stands within this share of the radius
THIN = "crop thinner than the radius"


def boxed_candidates(candidates: DataFrame) -> DataFrame:
    """Add the crop ``box`` (two radii each way, inside the page) and ``skipped``.

    ``candidates``: ``page_id, cand_id, cx, cy, radius, width, height, dpi``. ``skipped`` says why a
    candidate can't be verified, null if it can.
    """
    half = F.bround(F.col("radius") * 2)
    box = geo.clip(geo.centered(F.col("cx"), F.col("cy"), half), F.col("width"), F.col("height"))
    boxed = candidates.withColumn("box", box)
    thick = (geo.width(F.col("box")) >= F.col("radius")) & (geo.height(F.col("box")) >= F.col("radius"))
    return boxed.withColumn("skipped", F.when(~F.coalesce(thick, F.lit(False)), F.lit(THIN)))


def candidate_crops(candidates: DataFrame) -> DataFrame:
    """The candidates that can be verified, with their crop ``box``; see ``skipped_candidates``."""
    return boxed_candidates(candidates).filter("skipped is null").drop("skipped")


def skipped_candidates(candidates: DataFrame) -> DataFrame:
    """The other ones: ``page_id, cand_id, skipped`` (the reason)."""
    return boxed_candidates(candidates).filter("skipped is not null").select("page_id", "cand_id", "skipped")


def crop_ink(boxed: DataFrame, ink: DataFrame) -> DataFrame:
    """Ink of every crop, ``crop_id, iy, ix`` in page pixels: an equality on page tiles, then a cut.

    A tile holds at most ``TILE * TILE`` pixels, so no key is hot even on the largest page.
    """
    b = F.col("box")

    def tiles(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor(b[lo] / TILE).cast("int"), F.floor((b[hi] - 1) / TILE).cast("int")))

    keys = boxed.select("page_id", "crop_id", "box", tiles("y0", "y1").alias("ty")).select(
        "page_id", "crop_id", "box", "ty", tiles("x0", "x1").alias("tx")
    )
    tiled = ink.select(
        "page_id", F.col("y").alias("iy"), F.col("x").alias("ix"),
        F.floor(F.col("y") / TILE).cast("int").alias("ty"), F.floor(F.col("x") / TILE).cast("int").alias("tx"),
    )
    met = keys.join(tiled, ["page_id", "ty", "tx"])
    return met.filter(
        (F.col("iy") >= b["y0"]) & (F.col("iy") < b["y1"]) & (F.col("ix") >= b["x0"]) & (F.col("ix") < b["x1"])
    ).select("crop_id", "iy", "ix")


def without_lines(crop: DataFrame, boxed: DataFrame, line_in: float) -> DataFrame:
    """Crop ink (``packed.crops``) minus long horizontal and vertical runs."""
    run = F.greatest(F.lit(3), F.bround(F.lit(line_in) * F.col("dpi")).cast("int")).alias("run_px")
    sized = packed.crops(crop).select("crop_id", "px").join(boxed.select("crop_id", run), "crop_id")
    return packed.map_pixels(sized, lambda y, x, f: packed.off_lines(y, x, f["run_px"]), ["crop_id"])


def ring_completeness(circles: DataFrame, raw: DataFrame, n_r: int, n_theta: int, min_ink: float = 0.25) -> DataFrame:
    """Share of angles at which the ring carries ink, per crop."""
    lo, hi = STAMP_BANDS["ring"]
    radii = search.polar_radii(*POLAR_RANGE, n_r)
    inside = (radii >= lo) & (radii <= hi) if _has_radius(STAMP_BANDS["ring"], n_r) else np.ones(n_r, bool)
    within = search.band_radii(STAMP_BANDS["ring"], *POLAR_RANGE, n_r)

    def complete(y, x, f):
        v = search.polar_sums(y, x, f, radii[inside], n_theta).sum(0) / within
        return [[np.count_nonzero(v >= min_ink) / n_theta]]

    return packed.map_rows(search.circle_ink(circles, raw), complete, ["crop_id"], "ring_completeness double")


def _has_radius(band: tuple[float, float], n_r: int) -> bool:
    lo, hi = POLAR_RANGE
    return any(band[0] <= lo + (hi - lo) * i / max(1, n_r - 1) <= band[1] for i in range(n_r))


def densities(circles: DataFrame, clean: DataFrame, n_r: int, n_theta: int) -> DataFrame:
    """Mean ink per radial band, per crop: ``d_<band>``."""
    radii = search.polar_radii(*POLAR_RANGE, n_r)

    def means(y, x, f):
        per_radius = search.polar_sums(y, x, f, radii, n_theta).sum(1)
        out = []
        for band in STAMP_BANDS.values():
            inside = (radii >= band[0]) & (radii <= band[1]) if _has_radius(band, n_r) else np.ones(n_r, bool)
            out.append([per_radius[inside].sum() / (search.band_radii(band, *POLAR_RANGE, n_r) * n_theta)])
        return out

    return packed.map_rows(search.circle_ink(circles, clean), means, ["crop_id"],
                           ", ".join(f"d_{name} double" for name in STAMP_BANDS))


def measure(
    boxed: DataFrame, ink: DataFrame, config: dict, template: list[float] | None, rank_only: bool
) -> DataFrame:
    """Refined geometry, dial match and band measures of every candidate.

    ``rank_only`` measures at the given circle. Otherwise the circle is refined, and rows
    with ``matched`` get the dial search when there is a template. Crops without ink have
    zeros. The crops' ink is written once, a row per crop; all steps read it.
    """
    crops = cut_lineage(boxed.select(
        "page_id", "cand_id", "cx", "cy", "radius", "dpi", "matched", "box",
        F.monotonically_increasing_id().alias("crop_id")))
    raw = cut_lineage(packed.crops(crop_ink(crops, ink)))
    clean = cut_lineage(without_lines(raw, crops, config["verify_line_run_in"]))
    n_r, n_theta = config["n_radius"], config["n_theta"]
    given = crops.select("crop_id", "cx", "cy", "radius")
    nothing = F.lit(None)
    if rank_only:
        placed = given.withColumns({
            "ring_strength": F.lit(0.0), "peak": nothing.cast("double"), "shift": nothing.cast("int")})
    else:
        fitted = search.fit_circles(given, raw).select(
            "crop_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("r").alias("radius"),
            F.col("value").alias("ring_strength"))
        placed = cut_lineage(fitted)
        if template is None:
            placed = placed.withColumns({"peak": nothing.cast("double"), "shift": nothing.cast("int")})
        else:
            asked = placed.join(crops.filter("matched").select("crop_id"), "crop_id", "left_semi")
            dial = search.match_dials(asked.select("crop_id", "cx", "cy", "radius"), clean, template).filter("peak > 0")
            placed = cut_lineage(placed.join(dial, "crop_id", "left").select(
                "crop_id", F.coalesce("x", "cx").alias("cx"), F.coalesce("y", "cy").alias("cy"),
                F.coalesce("r", "radius").alias("radius"), "ring_strength", "peak", "shift"))
    circles = placed.select("crop_id", "cx", "cy", "radius")
    complete = ring_completeness(circles, raw, n_r, n_theta)
    bands = densities(circles, clean, n_r, n_theta)
    out = crops.select("crop_id", "page_id", "cand_id").join(placed, "crop_id")
    out = out.join(complete, "crop_id", "left").join(bands, "crop_id", "left")
    if rank_only:
        out = out.withColumns({"text_angle": F.lit(0.0), "text_strength": F.lit(0.0)})
    else:
        # The dial and the outline stay out; what is left is writing.
        disc = packed.map_pixels(
            search.circle_ink(circles, clean),
            lambda y, x, f: np.hypot(x - f["cx"], y - f["cy"]) <= DISC * f["radius"], ["crop_id"])
        lines = orientation.line_direction(disc, "crop_id")
        out = out.join(lines.select(
            "crop_id", F.col("angle").alias("text_angle"), F.col("strength").alias("text_strength")), "crop_id", "left")
    zeros = ["ring_completeness", "text_angle", "text_strength", *[f"d_{b}" for b in STAMP_BANDS]]
    return out.fillna(0.0, zeros).select(
        "page_id", "cand_id", "cx", "cy", "radius", "ring_strength", "peak", "shift", "ring_completeness",
        *[f"d_{b}" for b in STAMP_BANDS], "text_angle", "text_strength")
