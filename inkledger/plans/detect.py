"""Detectors: a registry of ``(ink, pages) -> detections`` and the date stamp detector.

``ink`` is ``(page_id, y, x)``; ``pages`` is ``(page_id, width, height, dpi)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkledger.functions import geometry as geo
from inkledger.functions.scoring import decision
from inkledger.operators import hough, orientation, packed, raster, signatures, suppression, verify
from inkledger.operators.detections import score_evidence
from inkledger.operators.polar import linspace
from inkledger.session import cut_lineage
from inkledger.vocabulary import DATE_STAMP_DEFAULTS, RANKED_PER_KEPT, WORK_DPI

Detector = Callable[[DataFrame, DataFrame], DataFrame]
_FACTORIES: dict[str, tuple[Callable[..., Detector], dict]] = {}


def register(name: str, defaults: dict):
    """Make ``factory(config) -> detector`` addressable by name."""

    def wrap(factory: Callable[[dict], Detector]) -> Callable[[dict], Detector]:
        if name in _FACTORIES and _FACTORIES[name][0] is not factory:
            raise ValueError(f"detector {name!r} is registered already")
        _FACTORIES[name] = (factory, dict(defaults))
        return factory

    return wrap


def available() -> list[str]:
    return sorted(_FACTORIES)


def build(name: str, **config) -> Detector:
    if name not in _FACTORIES:
        raise KeyError(f"unknown detector {name!r}; available: {', '.join(available())}")
    factory, defaults = _FACTORIES[name]
    unknown = sorted(set(config) - set(defaults))
    if unknown:
        raise TypeError(f"{name}: unknown config keys {unknown}")
    return factory({**defaults, **config})


def build_many(names: Iterable[str], config: dict[str, dict] | None = None) -> list[Detector]:
    return [build(name, **(config or {}).get(name, {})) for name in names]


def run_all(detectors: list[Detector], ink: DataFrame, pages: DataFrame) -> DataFrame:
    """All detectors' detections in one table."""
    found = [detector(ink, pages) for detector in detectors]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


# -------------------------------------------------------------------- date stamp

def coarse_pass(ink: DataFrame, pages: DataFrame, config: dict) -> DataFrame:
    """Ring candidates of every page in native pixels: ``page_id, cx, cy, radius, votes``.

    All of them, however many a band or page holds: limits are the detector's (``date_stamp``).
    """
    return page_rings(band_rings(ink, pages, config), config)


def band_rings(ink: DataFrame, pages: DataFrame, config: dict) -> DataFrame:
    """Every band's ring candidates in native pixels, with ``page_id, band_id, dpi``.

    After the band split each band's pixels are put in one row (``packed.Rasters``); pooling,
    line suppression, boundary, gradients, voting, gathering and peaks run over it.
    """
    factor = geo.factor_for_dpi(F.col("dpi"), WORK_DPI)
    layout = raster.band_layout(
        pages.withColumn("factor", factor), config["band_in"], config["overlap_in"], F.col("factor")
    )
    banded = raster.ink_in_bands(ink, layout, "width", "height", "dpi", "factor")
    pooled = _pool(banded, config)
    run_px = F.greatest(F.lit(3), F.bround(F.lit(config["line_run_in"]) * F.col("dpi") / F.col("factor")).cast("int"))
    keys = ["page_id", "band_id", "factor", "dpi"]
    carry = ["width", "height"]
    clean = raster.suppress_long_lines(pooled, keys, run_px, carry=carry)
    normals = raster.edge_normals(raster.boundary_flags(clean, keys, carry), keys, carry=carry)
    scale = F.col("dpi") / F.col("factor")
    radii = F.array(*[
        F.lit(r) * scale
        for r in linspace(config["radius_in_min"], config["radius_in_max"], config["radius_steps"])
    ])
    votes = hough.cast_votes(normals.with_facts(radii=radii), keys)
    found = hough.peaks(hough.gather_votes(votes, keys), keys, config["min_vote_fraction"])
    per_band = hough.greedy_suppression(
        found.withColumn("min_sep", F.bround(F.lit(0.6 * config["radius_in_min"]) * scale)),
        ["page_id", "band_id"], "min_sep",
    )
    return hough.lift(
        per_band.join(layout.select("page_id", "step_px"), "page_id").withColumns(
            {"x0": F.lit(0), "y0": F.col("band_id") * F.col("step_px")}
        ),
        "factor", "x0", "y0",
    )


def page_rings(rings: DataFrame, config: dict) -> DataFrame:
    """The bands' candidates, each once: bands overlap, so one stamp may appear twice."""
    return hough.greedy_suppression(
        rings.select(
            "page_id", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"), "radius", "votes",
            F.bround(F.lit(0.7 * config["radius_in_min"]) * F.col("dpi")).alias("min_sep"),
        ),
        ["page_id"], "min_sep",
    ).drop("min_sep")


def _pool(placed: DataFrame, config: dict) -> packed.Rasters:
    """Any-ink reduction of each band; carries the reduced band's size."""
    band_px = F.greatest(F.col("factor"), geo.inches_to_px(config["band_in"], F.col("dpi")))
    overlap = geo.inches_to_px(config["overlap_in"], F.col("dpi"))
    step = F.greatest(F.col("factor"), band_px - overlap)
    rows = F.least(band_px, F.col("height") - F.col("band_id") * step)
    cells = placed.select(
        "page_id", "band_id", "factor", "dpi",
        F.floor(F.col("y") / F.col("factor")).cast("int").alias("y"), F.floor(F.col("x") / F.col("factor")).cast("int").alias("x"),
        F.floor(F.col("width") / F.col("factor")).cast("int").alias("width"), F.floor(rows / F.col("factor")).cast("int").alias("height"),
    )
    keys = ["page_id", "band_id", "factor", "dpi"]
    inside = cells.filter("x >= 0 and y >= 0 and x < width and y < height")
    return packed.Rasters(packed.pack(inside, keys, keep=["width", "height"]), keys)


def densities() -> dict[str, F.Column]:
    return {name: F.col(f"d_{name}") for name in ("ring", "digits", "gap", "text", "outside")}


def verify_candidates(
    candidates: DataFrame, ink: DataFrame, config: dict, template: list[float] | None = None,
    upright_offset: float = 0.0,
) -> DataFrame:
    """Two passes: rank the strongest on geometry, then refine, match the top few, score.

    ``max_per_page`` and ``match_budget`` limit what is ranked, matched and kept of a page; without
    them all candidates are (``budget_report`` counts what limits cut). The ranking is written out
    once, since both the second pass and its match budget read it. Top-k filters run before
    their shuffle.
    """
    most, budget = config["max_per_page"], config["match_budget"]
    by_votes = Window.partitionBy("page_id").orderBy(F.col("votes").desc(), "cy", "cx")
    first = candidates.withColumn("cand_id", F.row_number().over(by_votes))
    if most is not None:
        first = first.filter(F.col("cand_id") <= most * RANKED_PER_KEPT)
    first = first.withColumn("matched", F.lit(False))
    boxed = verify.candidate_crops(first)
    ranks = verify.measure(boxed, ink, config, None, rank_only=True)
    scored = score_evidence(ranks, F.col("ring_completeness"), densities(), F.lit(0.0), geometry_only=True)
    by_rank = Window.partitionBy("page_id").orderBy(F.col("score").desc(), "cand_id")
    earns = F.lit(template is not None)
    if template is not None and budget is not None:
        earns = F.row_number().over(by_rank) <= budget
    order = scored.select("page_id", "cand_id", earns.alias("matched"))
    ranked = cut_lineage(boxed.drop("matched").join(order, ["page_id", "cand_id"]))
    measured = verify.measure(ranked, ink, config, template, rank_only=False)
    facts = ranked.select("page_id", "cand_id", "width", "height", "dpi", "box")
    full = measured.join(facts, ["page_id", "cand_id"])
    evidence = score_evidence(
        full, F.col("ring_completeness"), densities(), F.coalesce("peak", F.lit(0.0)), geometry_only=template is None
    )
    n_bins = len(template) if template is not None else 1
    angle = signatures.match_angle(F.col("shift"), n_bins)
    known = evidence.withColumns({
        "angle_deg": angle,
        "clipped": geo.clipped_by_page(
            F.col("box"), F.col("cx"), F.col("cy"), F.col("radius"), F.col("width"), F.col("height")
        ),
    }).withColumn(
        "upright_ccw_deg",
        orientation.upright_rotation(F.col("text_angle"), F.col("text_strength"), F.col("angle_deg"), upright_offset),
    ).withColumn("decision", decision(F.col("score"), config["t_hit"], config["t_miss"]))
    by_score = Window.partitionBy("page_id").orderBy(F.col("score").desc(), "cand_id")
    kept = known.withColumn("det_id", F.row_number().over(by_score))
    return detection_record(kept if most is None else kept.filter(F.col("det_id") <= most))


def budget_report(candidates: DataFrame, config: dict) -> DataFrame:
    """Per page: candidates, and how many of them the config's limits leave unranked or drop."""
    n, none, most = F.col("n_candidates"), F.lit(0).cast("long"), config["max_per_page"]
    ranked = n if most is None else F.least(n, F.lit(most * RANKED_PER_KEPT).cast("long"))
    kept = ranked if most is None else F.least(ranked, F.lit(most).cast("long"))
    return candidates.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_candidates")).select(
        "page_id", "n_candidates", (n - ranked).alias("n_unranked"), F.greatest(none, ranked - kept).alias("n_dropped"))


def detection_record(rows: DataFrame) -> DataFrame:
    """The stable detection schema: pixels, inches, score, decision, attributes, evidence."""
    cx, cy, r, dpi = F.col("cx"), F.col("cy"), F.col("radius"), F.col("dpi")
    nothing = F.lit(None).cast("string")
    return rows.select(
        "page_id", "det_id",
        F.lit("date_stamp").alias("element_type"), F.lit("date_stamp").alias("detector_name"),
        F.lit("1.0").alias("detector_version"),
        F.round(cx, 1).alias("center_x"), F.round(cy, 1).alias("center_y"),
        geo.round_int(cx - r).alias("x0"), geo.round_int(cy - r).alias("y0"),
        geo.round_int(cx + r).alias("x1"), geo.round_int(cy + r).alias("y1"),
        F.round(cx / dpi, 3).alias("center_in_x"), F.round(cy / dpi, 3).alias("center_in_y"),
        F.round(r / dpi, 3).alias("radius_in"),
        F.round("score", 4).alias("score"), "decision", F.round("angle_deg", 1).alias("angle_deg"),
        F.struct(
            nothing.alias("month"), nothing.alias("year"), nothing.alias("day"),
            F.col("clipped"), F.col("upright_ccw_deg"),
        ).alias("attrs"),
        "evidence",
    )


def save_template(template: DataFrame, path: str, upright_offset: float = 0.0) -> None:
    """Store the one row of ``signatures.build_template`` as ``load_template`` reads it."""
    import numpy as np

    row = template.first()
    np.savez(
        path, digit_signature=np.array(row["digit_signature"], float), radial_profile=np.array(row["radial_profile"], float),
        radius_in=row["radius_in"], n_sources=row["n_sources"], upright_ccw_deg=upright_offset)


def load_template(path: str) -> tuple[list[float], float]:
    """Signature and upright offset of a stored template (npz with fixed member names)."""
    import numpy as np

    with np.load(path, allow_pickle=False) as data:
        offset = float(data["upright_ccw_deg"]) if "upright_ccw_deg" in data else 0.0
        return [float(v) for v in data["digit_signature"]], offset


@register("date_stamp", DATE_STAMP_DEFAULTS)
def date_stamp(config: dict) -> Detector:
    """Circular date stamps. ``template_npz`` is a path, a ``(signature, offset)`` pair or empty."""
    source = config["template_npz"]
    if not source:
        template, offset = None, 0.0
    elif isinstance(source, str):
        template, offset = load_template(source)
    else:
        template, offset = source

    def detect(ink: DataFrame, pages: DataFrame) -> DataFrame:
        rings, most = band_rings(ink, pages, config), config["max_candidates_per_band"]
        if most is not None:
            rings = suppression.strongest(rings, ["page_id", "band_id"], most)
        found = cut_lineage(page_rings(rings, config))
        placed = found.join(pages.select("page_id", "width", "height", "dpi"), "page_id")
        return verify_candidates(placed, ink, config, template, offset)

    return detect
