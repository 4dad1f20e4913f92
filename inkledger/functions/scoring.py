"""Soft windows, weighted scores and decisions of the stamp detector."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkledger.vocabulary import (
    ANGULAR_FULL_SCORE, RATIOS, T_HIT, T_MISS, TRAPEZOIDS, WEIGHTS,
)


def trapezoid(value: Column, lo: float, full_from: float, full_to: float, hi: float) -> Column:
    """0 outside (lo, hi), 1 on the plateau, linear between."""
    return (
        F.when((value <= lo) | (value >= hi), F.lit(0.0))
        .when(value < full_from, (value - lo) / F.lit(max(1e-9, full_from - lo)))
        .when(value <= full_to, F.lit(1.0))
        .otherwise((F.lit(hi) - value) / F.lit(max(1e-9, hi - full_to)))
    )


def ratio_score(numerator: Column, denominator: Column, good: float, bad: float) -> Column:
    """1 while the ratio is at most ``good``, falling to 0 at ``bad``."""
    ratio = numerator / F.nullif(denominator, F.lit(0.0))
    return (
        F.when(denominator <= 1e-6, F.lit(0.0))
        .when(ratio <= good, F.lit(1.0))
        .when(ratio >= bad, F.lit(0.0))
        .otherwise((F.lit(bad) - ratio) / F.lit(bad - good))
    )


def sub_scores(ring_completeness: Column, density: dict[str, Column], angular: Column) -> dict[str, Column]:
    """The seven named sub-scores from band densities and the dial correlation."""
    contrast = density["ring"] - density["outside"]
    return {
        "ring": trapezoid(ring_completeness, *TRAPEZOIDS["ring"]),
        "contrast": trapezoid(contrast, *TRAPEZOIDS["contrast"]),
        "digits": trapezoid(density["digits"], *TRAPEZOIDS["digits"]),
        "gap": ratio_score(density["gap"], density["digits"], *RATIOS["gap"]),
        "text": trapezoid(density["text"], *TRAPEZOIDS["text"]),
        "outside": ratio_score(density["outside"], density["digits"], *RATIOS["outside"]),
        "angular": F.greatest(F.lit(0.0), F.least(F.lit(1.0), angular / F.lit(ANGULAR_FULL_SCORE))),
    }


def active_weights(geometry_only: bool) -> dict[str, float]:
    """Without a dial template the angular weight is shared out over the rest."""
    if not geometry_only:
        return dict(WEIGHTS)
    rest = {name: w for name, w in WEIGHTS.items() if name != "angular"}
    total = sum(rest.values())
    return {name: w / total for name, w in rest.items()}


def weighted_score(scores: dict[str, Column], geometry_only: bool = False) -> Column:
    weights = active_weights(geometry_only)
    return reduce(
        lambda a, b: a + b, [scores[name] * F.lit(w) for name, w in weights.items() if name in scores]
    )


def decision(score: Column, t_hit: float | Column = T_HIT, t_miss: float | Column = T_MISS) -> Column:
    return (
        F.when(score >= t_hit, F.lit("hit"))
        .when(score < t_miss, F.lit("miss"))
        .otherwise(F.lit("uncertain"))
    )
