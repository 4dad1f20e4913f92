"""4-connected components of ink in two levels: inside tiles, then between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.session import cut_lineage

TILE = 256


def part_labels(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For every pixel, sorted by (y, x), the index of the first pixel of its component.

    Runs of a row are joined with runs of the next that share a column; the least number
    spreads over neighbours and then along what it points at until nothing moves.
    """
    n = len(y)
    new_run = np.r_[True, (np.diff(y) != 0) | (np.diff(x) != 1)]
    run = np.cumsum(new_run) - 1
    wide = int(x.max()) - int(x.min()) + 1
    code = (y.astype(np.int64) - y.min()) * wide + (x - x.min())
    below = np.searchsorted(code, code + wide)
    meets = (below < n) & (code[np.minimum(below, n - 1)] == code + wide)
    a, b = run[meets], run[below[meets]]
    label = np.arange(run[-1] + 1)
    while True:
        low = label.copy()
        least = np.minimum(label[a], label[b])
        # The runs and what they point at all learn the least of either side.
        for side in (a, b):
            np.minimum.at(low, side, least)
            np.minimum.at(low, label[side], least)
        low = low[low]
        if (low == label).all():
            break
        label = low
    return np.flatnonzero(new_run)[label][run]


def _parts(by: list[str], tile: int):
    def label(group: pa.Table) -> pa.Table:
        order = group.sort_by([("y", "ascending"), ("x", "ascending")])
        y, x = order["y"].to_numpy(), order["x"].to_numpy()
        first = part_labels(y, x)
        area = np.bincount(first, minlength=len(first))[first]
        rim = np.isin(y % tile, (0, tile - 1)) | np.isin(x % tile, (0, tile - 1))
        columns = [order[c] for c in [*by, "y", "x"]]
        return pa.table(
            [*columns, pa.array(y[first], pa.int32()), pa.array(x[first], pa.int32()),
             pa.array(area, pa.int64()), pa.array(rim)], names=[*by, "y", "x", "py", "px", "area", "rim"])

    return label


def tile_parts(ink: DataFrame, by: list[str], tile: int = TILE) -> DataFrame:
    """Pixels with the part of their tile that they belong to, named by its first pixel.

    Adds ``py, px, area`` (pixels of the part) and ``rim`` (the pixel is at the tile's edge). A group
    is one tile, so it holds ``tile * tile`` pixels at most. Repeated pixels count once.
    """
    kinds = ", ".join(f"`{c}` {ink.schema[c].dataType.simpleString()}" for c in by)
    placed = ink.select(*by, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct().withColumns({
        "ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})
    return placed.groupBy(*by, "ty", "tx").applyInArrow(
        _parts(by, tile), f"{kinds}, y int, x int, py int, px int, area long, rim boolean")


def border_links(pixels: DataFrame, by: list[str], tile: int = TILE) -> DataFrame:
    """Pairs of parts (``node``, ``other``) that touch across a tile's edge, each pair both ways."""
    rim = pixels.filter("rim").select(*by, "y", "x", F.struct("py", "px").alias("node"))
    steps = []
    for axis in ("y", "x"):
        ahead = rim.filter(F.pmod(F.col(axis), F.lit(tile)) == 0).withColumn(axis, F.col(axis) - 1)
        steps.append(rim.filter(F.pmod(F.col(axis), F.lit(tile)) == tile - 1).join(
            ahead.withColumnRenamed("node", "other"), [*by, "y", "x"]).select(*by, "node", "other"))
    one_way = steps[0].unionByName(steps[1]).distinct()
    return one_way.unionByName(one_way.select(*by, F.col("other").alias("node"), F.col("node").alias("other")))


def joined_parts(links: DataFrame, by: list[str]) -> DataFrame:
    """``node, label``: every part of the border graph with the least part it is joined to.

    The least label spreads over neighbours, roots take the least that their followers saw, and
    labels jump to the label of the label, so rounds grow with the logarithm of the longest
    chain. Every round is written to the shared folder.
    """
    labels = links.select(*by, "node").distinct().withColumn("label", F.col("node"))
    while True:
        near = links.join(labels.select(*by, F.col("node").alias("other"), "label"), [*by, "other"])
        best = near.groupBy(*by, "node").agg(F.min("label").alias("near"))
        hooked = labels.join(best, [*by, "node"]).withColumn("new", F.least("label", "near"))
        roots = hooked.groupBy(*by, F.col("label").alias("node")).agg(F.min("new").alias("root"))
        lifted = hooked.join(roots, [*by, "node"], "left").withColumn("new", F.least("new", F.coalesce("root", "new")))
        far = lifted.select(*by, F.col("node").alias("new"), F.col("new").alias("far"))
        after = lifted.join(far, [*by, "new"], "left").select(
            *by, "node", F.least("new", F.coalesce("far", "new")).alias("after"), "label")
        moved = cut_lineage(after.select(*by, "node", F.col("after").alias("label"), (F.col("after") != F.col("label")).alias("moved")))
        labels = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return labels


def despeckle(ink: DataFrame, by: list[str], min_area: int, tile: int = TILE) -> DataFrame:
    """Drop 4-connected components smaller than ``min_area`` pixels.

    Tiles are labelled on their own; only parts that touch another tile's enter the graph of
    parts, which has as many rows as tile edges have ink. Pixels are joined by part, so no key has
    more rows than a tile has pixels, even where one component covers a page.
    """
    if min_area <= 1:
        return ink
    pixels = cut_lineage(tile_parts(ink, by, tile))
    links = cut_lineage(border_links(pixels, by, tile))
    areas = pixels.groupBy(*by, F.struct("py", "px").alias("node")).agg(F.max("area").alias("area"))
    if links.isEmpty():
        kept = areas.filter(F.col("area") >= min_area)
    else:
        rooted = areas.join(joined_parts(links, by), [*by, "node"], "left").withColumn("label", F.coalesce("label", "node"))
        rooted = cut_lineage(rooted)
        sizes = rooted.groupBy(*by, "label").agg(F.sum("area").alias("size")).filter(F.col("size") >= min_area)
        kept = rooted.join(sizes, [*by, "label"], "left_semi")
    named = pixels.withColumn("node", F.struct("py", "px"))
    return named.join(kept.select(*by, "node"), [*by, "node"], "left_semi").select(*by, "y", "x")
