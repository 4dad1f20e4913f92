"""Scored detections: evidence, budget, page verdicts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.functions import geometry as geo
from inkledger.functions.scoring import decision, sub_scores, weighted_score
from inkledger.vocabulary import STAMP_BANDS, T_HIT, T_MISS

SCORE_NAMES = ("ring", "contrast", "digits", "gap", "text", "outside", "angular")


def band_densities(polar: DataFrame, key: str, radius_fraction: str = "r_frac", ink: str = "ink") -> DataFrame:
    """Mean ink per radial band of each candidate; a band without samples uses all."""
    r = F.col(radius_fraction)
    aggs = []
    for name, (lo, hi) in STAMP_BANDS.items():
        inside = F.avg(F.when((r >= lo) & (r <= hi), F.col(ink)))
        aggs.append(F.coalesce(inside, F.avg(ink)).alias(name))
    return polar.groupBy(key).agg(*aggs)


def score_evidence(
    measured: DataFrame, ring_completeness: Column, density: dict[str, Column], angular: Column,
    geometry_only: bool = False,
) -> DataFrame:
    """Add the ``evidence`` map (sub-scores and raw values) and the weighted ``score``."""
    scores = sub_scores(ring_completeness, density, angular)
    raws = {
        "raw_ring_completeness": ring_completeness,
        "raw_contrast": density["ring"] - density["outside"],
        "raw_angular": angular,
        **{f"raw_{name}": value for name, value in density.items()},
    }
    staged = measured.withColumns({f"_s_{k}": v for k, v in scores.items()} | {f"_r_{k}": v for k, v in raws.items()})
    parts = []
    for name in scores:
        parts += [F.lit(name), F.col(f"_s_{name}")]
    for name in raws:
        parts += [F.lit(name), F.col(f"_r_{name}")]
    return staged.withColumns({
        "evidence": F.create_map(*parts),
        "score": weighted_score({n: F.col(f"_s_{n}") for n in scores}, geometry_only),
    }).drop(*[f"_s_{n}" for n in scores], *[f"_r_{n}" for n in raws])


def rescore(detections: DataFrame, geometry_only: bool = False, t_hit: float = T_HIT, t_miss: float = T_MISS) -> DataFrame:
    """Score and decide again from stored evidence, without touching pixels."""
    scores = {name: F.col("evidence")[name] for name in SCORE_NAMES}
    return detections.withColumn("score", weighted_score(scores, geometry_only)).withColumn(
        "decision", decision(F.col("score"), t_hit, t_miss)
    )


def within_budget(candidates: DataFrame, page: str, first: str, then: str, ident: str,
                  first_n: int, match_n: int, keep_n: int) -> DataFrame:
    """Two-pass budget: the ``first_n`` of a page by ``first`` are ranked by ``then``.

    ``matched`` marks the few that earn the costly match; only ``keep_n`` stay. Both
    ranks are top-k filters, which Spark applies per task before it shuffles, so a page
    with very many candidates never meets in one task.
    """
    by_first = Window.partitionBy(page).orderBy(F.col(first).desc(), F.col(ident))
    by_then = Window.partitionBy(page).orderBy(F.col(then).desc(), F.col(ident))
    short = candidates.withColumn("first_rank", F.row_number().over(by_first)).filter(
        F.col("first_rank") <= first_n
    )
    return (
        short.withColumn("then_rank", F.row_number().over(by_then))
        .filter(F.col("then_rank") <= keep_n)
        .withColumn("matched", F.col("then_rank") <= match_n)
    )


def clipped_note() -> str:
    return "stamp runs off the page edge"


def page_summary(detections: DataFrame, page: str, ident: str, *carry: str) -> DataFrame:
    """Per page: counts by decision and the best detection that is not a miss.

    Everything is a mergeable aggregate, so a page may hold any number of detections.
    """
    alive = F.col("decision") != "miss"
    best = F.max_by(
        F.struct(F.col(ident), F.col("score"), *carry),
        F.when(alive, F.struct(F.col("score"), (-F.col(ident)).alias("order"))),
    )
    return detections.groupBy(page).agg(
        F.count(F.lit(1)).alias("n_detections"),
        F.count_if(F.col("decision") == "hit").alias("n_hit"),
        F.count_if(F.col("decision") == "uncertain").alias("n_uncertain"),
        best.alias("best"),
    )


def verdict(n_hit: Column, n_uncertain: Column) -> Column:
    return F.when(n_hit > 0, "YES").when(n_uncertain > 0, "MAYBE").otherwise("NO")


def page_verdicts(pages: DataFrame, detections: DataFrame, page: str, ident: str) -> DataFrame:
    """Every page with its verdict; a page without detections is NO."""
    summary = page_summary(detections.select(page, ident, "decision", "score"), page, ident)
    zero = F.lit(0).cast("long")
    return (
        pages.join(summary, page, "left")
        .withColumn("n_detections", F.coalesce("n_detections", zero))
        .withColumn("n_hit", F.coalesce("n_hit", zero))
        .withColumn("n_uncertain", F.coalesce("n_uncertain", zero))
        .withColumn("verdict", verdict(F.col("n_hit"), F.col("n_uncertain")))
    )


def report_rows(pages: DataFrame, detections: DataFrame) -> DataFrame:
    """One report row per page.

    ``pages``: ``page_id, source_file, api14, width, height, dpi, dpi_source, warnings``;
    ``detections``: ``page_id, det_id, score, decision, center_in_x, center_in_y, radius_in,
    evidence, attrs``.
    """
    summary = page_summary(
        detections, "page_id", "det_id", "center_in_x", "center_in_y", "radius_in", "evidence", "attrs"
    )
    joined = pages.join(summary, "page_id", "left")
    best = F.col("best")
    alive = F.coalesce(F.col("n_hit") + F.col("n_uncertain"), F.lit(0).cast("long"))
    note = F.concat_ws(
        "; ",
        F.nullif(F.array_join("warnings", "; "), F.lit("")),
        F.when(F.col("dpi_source") == "default", "resolution tag missing - assumed 400 dpi"),
        F.when(best["attrs"]["clipped"], clipped_note()),
    )
    zero = F.lit(0).cast("long")
    rotation = best["attrs"]["upright_ccw_deg"]
    return joined.select(
        "page_id", "source_file",
        verdict(F.coalesce("n_hit", zero), F.coalesce("n_uncertain", zero)).alias("verdict"),
        F.when(best.isNotNull(), "open at stamp").otherwise("open page").alias("link"),
        F.round(best["score"], 3).alias("score"),
        F.when(best.isNotNull(), F.round(F.coalesce(best["evidence"]["raw_ring_completeness"], F.lit(0.0)), 2)).alias("ring_seen"),
        best["center_in_x"].alias("page_x_in"), best["center_in_y"].alias("page_y_in"),
        F.round(best["radius_in"] * 2, 2).alias("diameter_in"),
        F.when(rotation.isNotNull(), F.concat(rotation.cast("int").cast("string"), F.lit("°"))).alias("rotation"),
        "api14", F.bround("dpi").cast("int").alias("dpi"),
        F.format_string("%.1f x %.1f", F.col("width") / F.col("dpi"), F.col("height") / F.col("dpi")).alias("page_size"),
        F.nullif(F.greatest(alive - 1, zero), zero).alias("other_candidates"),
        F.nullif(note, F.lit("")).alias("notes"),
    )


def run_summary(verdicts: DataFrame, seconds: str | None = None, warnings: str | None = None) -> DataFrame:
    """Pages, verdict counts, scan time and pages with warnings in one row."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("n_pages"),
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in ("YES", "MAYBE", "NO")],
        (F.round(F.sum(seconds), 1) if seconds else F.lit(0.0)).alias("seconds"),
        (F.count_if(F.size(warnings) > 0) if warnings else F.lit(0).cast("long")).alias("n_with_warnings"),
    )


def flatten(detections: DataFrame, evidence_keys: list[str], attr_keys: list[str] = ()) -> DataFrame:
    """Evidence and attributes as ``ev_*`` (4 places) and ``attr_*`` columns."""
    rest = [c for c in detections.columns if c not in ("evidence", "attrs")]
    return detections.select(
        *rest,
        *[F.col("attrs")[k].alias(f"attr_{k}") for k in attr_keys],
        *[F.round(F.col("evidence")[k], 4).alias(f"ev_{k}") for k in evidence_keys],
    )


def evidence_names(detections: DataFrame) -> list[str]:
    """Every key of the ``evidence`` maps, as first seen by page, detection and place in the map.

    First sight is a mergeable minimum per key; the keys alone come to the driver.
    """
    keys = detections.select("page_id", "det_id", F.posexplode(F.map_keys("evidence")).alias("at", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct("page_id", "det_id", "at")).alias("f"))
    return [r["key"] for r in first.orderBy("f").collect()]


def attribute_names(detections: DataFrame) -> list[str]:
    """The fields of ``attrs`` that any detection has a value for, in the struct's order."""
    fields = detections.schema["attrs"].dataType.names
    filled = detections.agg(*[F.max(F.col("attrs")[f].isNotNull()).alias(f) for f in fields]).first()
    return [f for f in fields if filled[f]]


def inventory(pages: DataFrame, detections: DataFrame, evidence_keys: list[str] | None = None,
              attr_keys: list[str] | None = None) -> DataFrame:
    """Flat table: one row per detection, misses too; an empty page gives one row.

    Evidence and attributes become columns: the keys that are named, or without names all that
    the detections have (a detection without one is null there).
    """
    if evidence_keys is None:
        evidence_keys = evidence_names(detections)
    if attr_keys is None:
        attr_keys = attribute_names(detections) if "attrs" in detections.columns else []
    verdicts = page_verdicts(pages, detections, "page_id", "det_id")
    facts = verdicts.select(
        "page_id", "source_file", "api14", "dpi",
        F.round(F.col("width") / F.col("dpi"), 2).alias("page_w_in"),
        F.round(F.col("height") / F.col("dpi"), 2).alias("page_h_in"),
        "verdict",
    )
    return facts.join(flatten(detections, evidence_keys, attr_keys), "page_id", "left")


def read_windows(pages: DataFrame, best: DataFrame, pad: float = 0.35, view_in: float = 6.0,
                 top_in: float = 14.0, bottom_in: float = 10.0) -> DataFrame:
    """Pixel windows to fetch per page: crop and context at the best detection, else both ends.

    ``best``: ``page_id, center_x, center_y, x0, x1``.
    """
    joined = pages.join(best, "page_id", "left")
    radius = F.greatest(F.lit(1.0), (F.col("x1") - F.col("x0")) / F.lit(2.0))
    w, h = F.col("width"), F.col("height")
    crop = geo.clip(geo.centered(F.col("center_x"), F.col("center_y"), F.bround(radius * (1 + pad))), w, h)
    half = F.bround(geo.inches_to_px(view_in, F.col("dpi")) / 2)
    context = geo.clip(geo.centered(F.col("center_x"), F.col("center_y"), half), w, h)
    top_px = F.least(h, geo.inches_to_px(top_in, F.col("dpi")))
    bottom_px = F.least(h - top_px, geo.inches_to_px(bottom_in, F.col("dpi")))
    zero = F.lit(0)
    found = F.col("center_x").isNotNull()

    def tagged(kind: str, box: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), box.alias("box"))

    ends = F.array_compact(F.array(
        tagged("top", geo.make_box(zero, zero, w, top_px)),
        F.when(bottom_px > 0, tagged("bottom", geo.make_box(zero, h - bottom_px, w, h))),
    ))
    windows = F.when(found, F.array(tagged("crop", crop), tagged("context", context))).otherwise(ends)
    return joined.select("page_id", F.explode(windows).alias("v")).select("page_id", "v.kind", "v.box.*")
