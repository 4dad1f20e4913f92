"""Detector queries on stamp pages that Spark paints from the embeddings table.

Every vector becomes one 64 x 64 page at 20 dpi: an outline of 0.7 in radius around a
centre that depends on the id, a dial whose ink follows the vector's signs, and three
lines of text. Every fourth page has no outline. The work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.operators import raster, search, signatures, verify
from inkledger.plans import detect
from inkledger.vocabulary import DATE_STAMP_DEFAULTS, PAGE_BUDGET
from workload.registry import Tables, query

SIDE, RADIUS, DPI = 64, 14.0, 20.0
CONFIG = DATE_STAMP_DEFAULTS | PAGE_BUDGET


def pages_of(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("page_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.lit(DPI).alias("dpi")
    )


def centres(t: Tables) -> DataFrame:
    i = F.col("vec_id")
    return t.embeddings.select(
        i.alias("page_id"), "embedding",
        (F.lit(30.0) + i % 5).alias("cx"), (F.lit(29.0) + i % 7).alias("cy"), (i % 4 != 3).alias("stamped"),
    )


def ink_of(t: Tables) -> DataFrame:
    axis = F.sequence(F.lit(0), F.lit(SIDE - 1))
    cells = raster.co_locate(centres(t), ["page_id"]).withColumn("y", F.explode(axis)).withColumn("x", F.explode(axis))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    shaped = cells.withColumns({
        "r": F.sqrt(dx * dx + dy * dy) / RADIUS,
        "bin": F.floor(F.pmod(F.atan2(dy, dx), F.lit(6.283185307179586)) / F.lit(6.283185307179586 / 64)).cast("int") % 64,
    })
    outline = F.col("stamped") & (F.abs(F.col("r") - 1.0) <= 0.06)
    dial = F.col("r").between(0.78, 0.92) & (F.element_at("embedding", F.col("bin") + 1) > 0)
    text = F.col("r").between(0.30, 0.58) & (F.col("y") % 3 == 0)
    return shaped.filter(outline | dial | text).select("page_id", "y", "x")


def seeds(t: Tables) -> DataFrame:
    """Candidates a little off the true circle."""
    i = F.col("page_id")
    return centres(t).filter("stamped").select(
        "page_id", i.alias("cand_id"), (F.col("cx") + i % 3 - 1).alias("cx"), (F.col("cy") + i % 2).alias("cy"),
        F.lit(RADIUS * 1.06).alias("radius"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"),
        F.lit(DPI).alias("dpi"), F.lit(True).alias("matched"), F.lit(1.0).alias("votes"),
    )


def dial_template(t: Tables) -> list[float]:
    """The vector of page 0 as a 360-bin dial."""
    row = t.embeddings.filter("vec_id = 0").select("embedding").first()
    return [1.0 if row["embedding"][b * 64 // 360] > 0 else 0.0 for b in range(360)]


@query("coarse_ring_pass")
def coarse_ring_pass(t: Tables) -> DataFrame:
    return detect.coarse_pass(ink_of(t), pages_of(t), DATE_STAMP_DEFAULTS)


_PAGES = """centres AS (
  SELECT vec_id AS page_id, CAST(30 + vec_id % 5 AS DOUBLE) AS cx, CAST(29 + vec_id % 7 AS DOUBLE) AS cy
  FROM embeddings WHERE vec_id % 4 <> 3)"""

# The search's radii are 4.5 % of 14.84 pixels apart, halved at each level; 14.01 is the one
# nearest the outline's. Strength is defined there from the outline's own pixels; dial and
# writing lie more than a pixel inside, and nothing is drawn outside.
_REFINED = "WITH " + _PAGES + """, cells AS (
  SELECT page_id, cx, cy, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d
  FROM centres, range(64) a(x), range(64) b(y)
)
SELECT page_id, round(cx, 2) AS cx, round(cy, 2) AS cy, CAST(14.01 AS DOUBLE) AS radius,
       round(sum(greatest(0, 1 - abs(d - 14.0053))) / (2 * pi() * 14.0053)
             - sum(greatest(0, 1 - abs(d - 1.12 * 14.0053))) / (2 * pi() * 1.12 * 14.0053), 3) AS ring_strength
FROM cells WHERE abs(d / 14 - 1) <= 0.06 GROUP BY page_id, cx, cy
"""


@query("circle_refinement", _REFINED)
def circle_refinement(t: Tables) -> DataFrame:
    boxed = verify.candidate_crops(seeds(t))
    return verify.measure(boxed, ink_of(t), CONFIG, None, rank_only=False).select(
        "page_id", F.round("cx", 2).alias("cx"), F.round("cy", 2).alias("cy"), F.round("radius", 2).alias("radius"),
        F.round("ring_strength", 3).alias("ring_strength"),
    )


@query("template_match_search")
def template_match_search(t: Tables) -> DataFrame:
    boxed = verify.candidate_crops(seeds(t))
    rows = verify.measure(boxed, ink_of(t), CONFIG, dial_template(t), rank_only=False)
    return rows.select("page_id", F.round("peak", 3).alias("peak"), "shift").withColumn(
        "angle_deg", F.round(signatures.match_angle(F.col("shift"), 360), 1)
    )


DIAL_SECTORS = 16


def turned_dials(t: Tables) -> DataFrame:
    """Pages whose dial is the first 16 signs of vector 0, turned by the page's number of sectors."""
    signs = t.embeddings.filter("vec_id = 0").select(F.transform(
        F.slice("embedding", 1, DIAL_SECTORS), lambda v: v > 0).alias("signs"))
    axis = F.sequence(F.lit(0), F.lit(SIDE - 1))
    cells = raster.co_locate(centres(t).join(F.broadcast(signs)), ["page_id"]).withColumn("y", F.explode(axis)).withColumn("x", F.explode(axis))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    sector = F.floor(F.pmod(F.atan2(dy, dx), F.lit(6.283185307179586)) / F.lit(6.283185307179586 / DIAL_SECTORS))
    inked = F.element_at("signs", (F.pmod(sector - F.col("page_id") % DIAL_SECTORS, F.lit(DIAL_SECTORS)) + 1).cast("int"))
    away = F.sqrt(dx * dx + dy * dy) / RADIUS
    return cells.filter(away.between(0.78, 0.95) & inked).select("page_id", "y", "x")


def sector_template(t: Tables) -> list[float]:
    row = t.embeddings.filter("vec_id = 0").select("embedding").first()
    return [1.0 if row["embedding"][b * DIAL_SECTORS // 360] > 0 else 0.0 for b in range(360)]


@query(
    "dial_rotation_search",
    """SELECT vec_id AS page_id, CAST(vec_id % 16 AS INTEGER) AS sector, TRUE AS at_centre, TRUE AS agrees
       FROM embeddings WHERE vec_id % 4 <> 3""",
)
def dial_rotation_search(t: Tables) -> DataFrame:
    """Rotation and place of each page's dial, from seeds up to a pixel off in x and y."""
    crops = seeds(t).select("page_id", F.col("cand_id").alias("crop_id"), "cx", "cy", F.lit(RADIUS).alias("radius"))
    ink = turned_dials(t).select(F.col("page_id").alias("crop_id"), F.col("y").alias("iy"), F.col("x").alias("ix"))
    found = search.match_dials(crops.drop("page_id"), ink, sector_template(t))
    true = centres(t).select(F.col("page_id").alias("crop_id"), F.col("cx").alias("tx"), F.col("cy").alias("ty"))
    sector = F.pmod(F.bround(F.col("shift") / (360 / DIAL_SECTORS)).cast("int"), F.lit(DIAL_SECTORS))
    return found.join(true, "crop_id").select(
        F.col("crop_id").alias("page_id"), sector.alias("sector"),
        (F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty")) <= 1.0).alias("at_centre"),
        (F.col("peak") > 0.8).alias("agrees"))


_VERIFIED = "WITH " + _PAGES + """
SELECT page_id, CAST(1 AS INTEGER) AS det_id, 'hit' AS decision, CAST(0.7 AS DOUBLE) AS radius_in,
       round(cx / 20, 3) AS center_in_x, round(cy / 20, 3) AS center_in_y
FROM centres
"""


@query("verified_geometry", _VERIFIED)
def verified_geometry(t: Tables) -> DataFrame:
    """Every drawn outline is a hit at its centre."""
    return candidate_verification(t).drop("score")


@query("candidate_verification")
def candidate_verification(t: Tables) -> DataFrame:
    return detect.verify_candidates(seeds(t).drop("matched", "cand_id"), ink_of(t), CONFIG).select(
        "page_id", "det_id", "decision", "score", "radius_in", "center_in_x", "center_in_y"
    )


@query("detect_date_stamps")
def detect_date_stamps(t: Tables) -> DataFrame:
    detector = detect.build("date_stamp", template_npz=(dial_template(t), 0.0), **PAGE_BUDGET)
    found = detect.run_all([detector], ink_of(t), pages_of(t))
    return found.select("page_id", "det_id", "decision", "score", "radius_in", "angle_deg", "center_in_x", "center_in_y")
