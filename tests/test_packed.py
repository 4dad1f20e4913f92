"""Packed rasters and crops give what the operators give on pixel rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from inkledger.operators import hough, orientation, packed, raster, search

KEYS = ["page_id", "band_id"]


def drawn(spark, seed, side=48):
    draw = np.random.default_rng(seed)
    y, x = np.indices((side, side))
    rows = []
    for page in range(6):
        cy, cx, r = draw.uniform(14, 34, 2).tolist() + [draw.uniform(8, 12)]
        ink = (np.abs(np.hypot(y - cy, x - cx) - r) < 1) | (draw.random((side, side)) < 0.05)
        ink[int(draw.integers(0, side))] = True  # a long line
        rows += [(page, 0, int(a), int(b), side, side) for a, b in zip(*np.nonzero(ink))]
    return spark.createDataFrame(rows, "page_id long, band_id int, y int, x int, width int, height int")


def found(ink, carry):
    clean = raster.suppress_long_lines(ink, KEYS, F.lit(30), carry=carry)
    normals = raster.edge_normals(raster.boundary_flags(clean, KEYS, carry), KEYS, carry=carry)
    votes = hough.cast_votes(normals, KEYS, [8.0, 10.0, 12.0])
    rows = hough.peaks(hough.gather_votes(votes, KEYS), KEYS, 0.25)
    return sorted(tuple(r) for r in rows.select(*KEYS, "radius", "cy", "cx", "votes").collect())


def test_bands_in_one_row_vote_like_pixel_rows(spark):
    ink = drawn(spark, 4)
    bands = packed.Rasters(packed.pack(ink, KEYS, keep=["width", "height"]), KEYS)
    plain = found(ink, ["width", "height"])
    assert len(plain) >= 6 and found(bands, ["width", "height"]) == plain


def test_windows_at_any_length():
    cells = np.random.default_rng(2).integers(0, 9, (13, 17))
    for half in (0, 1, 2, 3, 5, 20):
        sums, most = packed.window_sums(cells, half), packed.window_maxima(cells, half)
        for y in range(13):
            for x in range(17):
                near = cells[max(0, y - half):y + half + 1, max(0, x - half):x + half + 1]
                assert sums[y, x] == near.sum() and most[y, x] == near.max()


def test_large_groups_have_the_direction_of_small_ones(spark, monkeypatch):
    ink = drawn(spark, 9)
    whole = {r["page_id"]: r for r in orientation.line_direction(ink, "page_id").collect()}
    monkeypatch.setattr(orientation, "WHOLE", 160)
    rows = orientation.line_direction(ink, "page_id").collect()
    assert {r["page_id"] for r in rows} == set(whole)
    for r in rows:
        assert r["angle"] == whole[r["page_id"]]["angle"]
        assert abs(r["strength"] - whole[r["page_id"]]["strength"]) < 1e-9


def test_a_search_multiplies_no_rows(spark):
    """No step of a search makes a row per probe or pixel."""
    ink = drawn(spark, 3).select(F.col("page_id").alias("crop_id"), F.col("y").alias("iy"), F.col("x").alias("ix"))
    circles = spark.createDataFrame([(i, 24.0, 24.0, 10.0) for i in range(6)], "crop_id long, cx double, cy double, radius double")
    for made in (search.fit_circles(circles, ink), search.match_dials(circles, ink, [1.0, 0.0, 0.0, 1.0] * 8)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Window" not in plan
        assert made.count() == 6
