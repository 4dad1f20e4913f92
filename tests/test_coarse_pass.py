"""The coarse pass finds every ring of a band, however many there are."""

from __future__ import annotations

import numpy as np

from inkledger.plans import detect
from inkledger.vocabulary import DATE_STAMP_DEFAULTS, PAGE_BUDGET
from workload import stamps

DPI, HEIGHT, WIDTH = 20.0, 200, 280
CENTRES = [(25 + 45 * row, 25 + 45 * col) for row in range(4) for col in range(6)]


def crowded(spark):
    """One page, one band, 24 rings: ink and pages."""
    y, x = np.indices((HEIGHT, WIDTH))
    ink = np.zeros((HEIGHT, WIDTH), bool)
    for cy, cx in CENTRES:
        ink |= np.abs(np.hypot(y - cy, x - cx) - 14.0) <= 0.8
    rows = [(1, int(a), int(b)) for a, b in zip(*np.nonzero(ink))]
    return (spark.createDataFrame(rows, "page_id long, y int, x int"),
            spark.createDataFrame([(1, WIDTH, HEIGHT, DPI)], "page_id long, width int, height int, dpi double"))


def near(found):
    """How many of the drawn centres have a candidate within 2 pixels."""
    return sum(any(np.hypot(r.cy - cy, r.cx - cx) <= 2 for r in found) for cy, cx in CENTRES)


def test_no_ring_of_a_crowded_band_is_dropped(spark, monkeypatch):
    ink, pages = crowded(spark)
    monkeypatch.setattr(stamps, "ink_of", lambda t: ink)
    monkeypatch.setattr(stamps, "pages_of", lambda t: pages)
    found = stamps.coarse_ring_pass(None).collect()
    assert near(found) == len(CENTRES) == 24
    # Limits belong to the detector; the pass is whole also where a config holds them.
    assert len(detect.coarse_pass(ink, pages, DATE_STAMP_DEFAULTS | PAGE_BUDGET).collect()) == len(found)
