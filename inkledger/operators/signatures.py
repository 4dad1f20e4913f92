"""Angular signatures: circular correlation, alignment and template building.

A signature row has ``sig_id`` and ``sig`` (an array of doubles, one per angle bin).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collect_signature(bins: DataFrame, key: str, bin_col: str = "bin", value: str = "v") -> DataFrame:
    """Long ``(key, bin, value)`` rows -> arrays; a group is one signature, so bounded."""
    return bins.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(bin_col, value))), lambda e: e[value]).alias("sig")
    )


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Zero mean and unit norm per row; flat rows become zero."""
    centred = rows - rows.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(centred, axis=1, keepdims=True)
    return np.where(norm < 1e-9, 0.0, centred / np.where(norm < 1e-9, 1.0, norm))


def fit_length(circle: np.ndarray, n: int) -> np.ndarray:
    """A signature around the full turn with ``n`` bins, linear between its own bins."""
    if len(circle) == n:
        return circle
    whole, part = np.divmod(np.arange(n) * len(circle), n)
    ahead = circle[(whole + 1) % len(circle)]
    return circle[whole] + (ahead - circle[whole]) * (part / n)


def correlate_rows(signals: np.ndarray, template: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Peak and first best shift of every row against one template.

    Rows of another length are compared with the template resampled to that length.
    """
    n = signals.shape[1]
    a, b = unit_rows(signals), unit_rows(fit_length(template, n)[None, :])[0]
    corr = np.fft.irfft(np.fft.rfft(a, axis=1) * np.conj(np.fft.rfft(b)), n=n, axis=1)
    shift = np.argmax(corr, axis=1)
    peak = corr[np.arange(len(corr)), shift]
    flat = ~a.any(axis=1) | (not b.any())
    return np.where(flat, 0.0, peak), np.where(flat, 0, shift)


def correlation_udf(template: list[float]):
    """Vectorised ``sig -> struct<peak, shift>`` against a constant template."""
    reference = np.asarray(template, dtype=float)

    @F.pandas_udf("peak double, shift int")
    def against(signatures: pd.Series) -> pd.DataFrame:
        peaks = np.zeros(len(signatures))
        shifts = np.zeros(len(signatures), dtype=int)
        sizes = signatures.map(len).to_numpy()
        for size in np.unique(sizes):
            pick = np.flatnonzero(sizes == size)
            if size:
                stack = np.stack([np.asarray(signatures.iloc[i], dtype=float) for i in pick])
                peaks[pick], shifts[pick] = correlate_rows(stack, reference)
        return pd.DataFrame({"peak": peaks, "shift": shifts})

    return against


def match_angle(shift: Column, n_bins: Column | int) -> Column:
    """Rotation in degrees, counter-clockwise, of a shift."""
    bins = n_bins if isinstance(n_bins, Column) else F.lit(n_bins)
    turned = -(shift / bins) * F.lit(360.0)
    return F.pmod(turned, F.lit(360.0))


def with_correlation(signatures: DataFrame, template: list[float]) -> DataFrame:
    match = correlation_udf(template)(F.col("sig")).alias("m")
    rest = [c for c in signatures.columns]
    return signatures.select(*rest, match).select(*rest, F.col("m.peak"), F.col("m.shift")).withColumn(
        "angle_deg", match_angle(F.col("shift"), F.size("sig"))
    )


def alignment_udf(template: list[float]):
    """Vectorised ``sig -> array``: unit form rolled into the template's frame.

    Signatures of another length are resampled to the template's. Null, empty and flat ones,
    which have no direction, give null.
    """
    reference = np.asarray(template, dtype=float)

    @F.pandas_udf("array<double>")
    def into_frame(signatures: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(signatures), dtype=object)
        pick = [i for i, s in enumerate(signatures) if s is not None and len(s)]
        if pick:
            stack = np.stack([fit_length(np.asarray(signatures.iloc[i], dtype=float), reference.size) for i in pick])
            units, shifts = unit_rows(stack), correlate_rows(stack, reference)[1]
            columns = (np.arange(reference.size)[None, :] + shifts[:, None]) % reference.size
            rolled = np.take_along_axis(units, columns, axis=1)
            for at, row in zip(pick, rolled):
                if row.any():
                    out.iloc[at] = row
        return out

    return into_frame


def exact_median(rows: DataFrame, value: str, few: int = 10_000) -> float | None:
    """The median of a column, exactly, without sorting it in one place.

    Bounds around the middle are narrowed by approximate quantiles and exact counts until ``few``
    values are left between them (or all of those are equal); only those come to the driver.
    Nulls take no part; nothing gives None.
    """
    values = rows.select(F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    count = values.count()
    if not count:
        return None
    ranks, below, inside, size = {(count - 1) // 2, count // 2}, 0, values, count
    while size > few:
        # The heaviest value is told apart first: quantiles can't narrow what ties fill.
        middle = (min(ranks) - below) / size
        pivot = inside.approxQuantile("v", [middle], 0.01)[0]
        parts = inside.agg(F.count_if(F.col("v") < pivot).alias("under"), F.count_if(F.col("v") == pivot).alias("same")).first()
        upto = below + parts["under"]
        if upto <= min(ranks) and max(ranks) < upto + parts["same"]:
            return pivot
        low, high = inside.approxQuantile("v", [max(0.0, middle - 0.03), min(1.0, middle + 0.03)], 0.01)
        near = inside.filter(F.col("v").between(low, high))
        ahead, held = inside.filter(F.col("v") < low).count(), near.count()
        if not below + ahead <= min(ranks) or not max(ranks) < below + ahead + held or held == size:
            # One side of the pivot at least goes.
            if max(ranks) < upto:
                near, ahead, held = inside.filter(F.col("v") < pivot), 0, parts["under"]
            elif min(ranks) >= upto + parts["same"]:
                ahead = parts["under"] + parts["same"]
                near, held = inside.filter(F.col("v") > pivot), size - ahead
            else:  # the two middle ranks lie on either side of the pivot's edge
                after = inside.filter(F.col("v") > pivot).agg(F.min("v")).first()[0]
                before = inside.filter(F.col("v") < pivot).agg(F.max("v")).first()[0]
                return (pivot + after) / 2 if min(ranks) >= upto else (before + pivot) / 2
        inside, below, size = near, below + ahead, held
    held = sorted(r["v"] for r in inside.collect())
    return sum(held[r - below] for r in sorted(ranks)) / len(ranks)


def build_template(sources: DataFrame, first: str = "order") -> DataFrame:
    """One-row template from confirmed elements.

    ``sources``: ``sig_id, sig, profile, radius_in`` and an order column. Signatures are
    aligned to the earliest source's frame by their best shift, normalised, and averaged
    bin by bin; ``upright`` offset is the caller's to add. ``n_sources`` counts the signatures in
    the average; profile and radius are those of all sources. Only the anchor (one array) and the
    values next to the median come to the driver; everything else is a mergeable average.
    """
    anchor = sources.orderBy(first).select("sig").first()
    if anchor is None:
        raise ValueError("no usable elements found")
    aligned = sources.select(alignment_udf(list(anchor["sig"]))(F.col("sig")).alias("unit")).filter("unit is not null")
    mean_bins = aligned.select(F.posexplode("unit").alias("bin", "v")).groupBy("bin").agg(
        F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    facts = mean_bins.agg(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("n_sources")).withColumn(
        "radius_in", F.lit(exact_median(sources, "radius_in")).cast("double"))
    rows = sources.select(F.posexplode("profile").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v"))

    def listed(df: DataFrame, order: str) -> Column:
        return df.agg(
            F.transform(F.sort_array(F.collect_list(F.struct(order, "v"))), lambda e: e["v"])
        ).scalar()

    return facts.select(
        listed(mean_bins.select("bin", "v"), "bin").alias("digit_signature"), listed(rows, "i").alias("radial_profile"),
        "radius_in", "n_sources",
    )
