"""Sparse raster operators: one row per ink pixel, grouped by page or page band.

Every neighbourhood step *scatters*: a pixel is exploded over a constant offset list and
the copies meet in a ``groupBy`` on the target pixel. Nothing is a range join. ``by`` names
the columns that hold one independent raster (``page_id``, or ``page_id, band_id``);
``co_locate`` hashes on them once and, because all later groupings contain them, a whole
chain of steps runs without another shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.functions import geometry as geo
from inkledger.operators import packed
from inkledger.operators.skew import salted_join


def co_locate(ink: DataFrame, by: list[str], partitions: int | None = None) -> DataFrame:
    """Hash on ``by`` with a fixed partition count.

    The following steps multiply rows a hundredfold, which the size of this shuffle does
    not show; a fixed count keeps adaptive coalescing from folding it into few tasks.
    """
    if partitions is None:
        partitions = int(ink.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ink.repartition(partitions, *by)


def offsets(values: list, *names: str) -> Column:
    """A constant array of structs to explode."""
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    return F.array(*[F.struct(*[F.lit(c).alias(n) for c, n in zip(row, names)]) for row in rows])


def with_page_facts(ink: DataFrame, pages: DataFrame, *facts: str) -> DataFrame:
    """Attach page columns to pixels.

    A plain join: the planner broadcasts the page table only when its own size estimate
    allows it, and splits the pixels of a crowded page at run time.
    """
    return ink.join(pages.select("page_id", *facts), "page_id")


# ------------------------------------------------------------------ runs and ink

def runs_to_pixels(runs: DataFrame) -> DataFrame:
    """Run-length rows ``(…, y, x0, x1)``, half open -> pixels."""
    rest = [c for c in runs.columns if c not in ("x0", "x1")]
    return runs.filter("x1 > x0").select(*rest, F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))


def pixels_to_runs(ink: DataFrame, by: list[str]) -> DataFrame:
    """Pixels -> maximal horizontal runs. A window covers one raster row at most."""
    w = Window.partitionBy(*by, "y").orderBy("x")
    island = ink.withColumn("_island", F.col("x") - F.row_number().over(w))
    return island.groupBy(*by, "y", "_island").agg(
        F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")
    ).drop("_island")


def ink_from_samples(samples: DataFrame, by: list[str]) -> DataFrame:
    """Raw samples (``y, x, value, min_is_white``) -> ink of either polarity.

    Min-is-white: any value above zero is ink. Otherwise a value below half of the block's
    maximum is ink; the maximum is an aggregate joined back, not a window.
    """
    peak = samples.groupBy(*by).agg(F.max("value").alias("_peak"), F.count(F.lit(1)).alias("_n"))
    joined = salted_join(samples, peak, by, "inner", weight="_n")
    dark = F.col("value") < F.greatest(F.col("_peak"), F.lit(1)) / F.lit(2.0)
    return joined.filter(F.when(F.col("min_is_white"), F.col("value") > 0).otherwise(dark)).select(*by, "y", "x")


# ------------------------------------------------------------------------- bands

def page_bands(pages: DataFrame, band_in: float, overlap_in: float, factor: Column | int = 1) -> DataFrame:
    """Overlapping horizontal bands of every page: ``page_id, band_id, y0, y1``."""
    laid = band_layout(pages, band_in, overlap_in, factor)
    return laid.select(
        "page_id", "height", "band_px", "step_px",
        F.explode(F.sequence(F.lit(0), F.col("last_band"))).alias("band_id"),
    ).select(
        "page_id", "band_id", (F.col("band_id") * F.col("step_px")).alias("y0"),
        F.least("height", F.col("band_id") * F.col("step_px") + F.col("band_px")).alias("y1"),
    )


def band_layout(pages: DataFrame, band_in: float, overlap_in: float, factor: Column | int = 1) -> DataFrame:
    f = factor if isinstance(factor, Column) else F.lit(factor)
    sized = pages.withColumns({
        "band_px": F.greatest(f, geo.inches_to_px(band_in, F.col("dpi"))),
        "_overlap": geo.inches_to_px(overlap_in, F.col("dpi")),
    })
    stepped = sized.withColumn("step_px", F.greatest(f, F.col("band_px") - F.col("_overlap"))).drop("_overlap")
    beyond = F.ceil((F.col("height") - F.col("band_px")) / F.col("step_px")).cast("int")
    return stepped.withColumn("last_band", F.greatest(F.lit(0), beyond))


def ink_in_bands(ink: DataFrame, layout: DataFrame, *facts: str) -> DataFrame:
    """Pixels with their band numbers (one or two each); ``y`` becomes band-relative."""
    placed = with_page_facts(ink, layout, "band_px", "step_px", "last_band", *facts)
    y, step = F.col("y"), F.col("step_px")
    first = F.greatest(F.lit(0), (F.floor((y - F.col("band_px")) / step) + 1).cast("int"))
    last = F.least(F.col("last_band"), F.floor(y / step).cast("int"))
    return (
        placed.withColumn("band_id", F.explode(F.sequence(first, last)))
        .withColumn("y", y - F.col("band_id") * step)
        .drop("band_px", "step_px", "last_band")
    )


# --------------------------------------------------------------------- reductions

def max_pool(ink: DataFrame, by: list[str], factor: Column | int, width: Column, height: Column) -> DataFrame:
    """Any ink in a full factor x factor cell; remainder rows and columns are trimmed."""
    f = factor if isinstance(factor, Column) else F.lit(factor)
    cy, cx = F.floor(F.col("y") / f).cast("int"), F.floor(F.col("x") / f).cast("int")
    inside = (cy < F.floor(height / f)) & (cx < F.floor(width / f))
    return ink.filter(inside).select(*by, cy.alias("y"), cx.alias("x")).distinct()


def cell_grid(pages: DataFrame, factor: int, partial: bool) -> DataFrame:
    """All cells of every page at a reduction; ``partial`` keeps ceil-sized edge cells."""
    f = F.lit(factor)
    if partial:
        rows, cols = F.ceil(F.col("height") / f), F.ceil(F.col("width") / f)
    else:
        rows, cols = F.floor(F.col("height") / f), F.floor(F.col("width") / f)
    listed = pages.filter((rows > 0) & (cols > 0)).select(
        "page_id", "width", "height", cols.cast("int").alias("_cols"),
        F.explode(F.sequence(F.lit(0), (rows - 1).cast("int"))).alias("cy"),
    )
    return listed.select(
        "page_id", "width", "height", "cy", F.explode(F.sequence(F.lit(0), F.col("_cols") - 1)).alias("cx")
    )


def _coverage(ink: DataFrame, grid: DataFrame, factor: int) -> DataFrame:
    """Ink count per grid cell, blank cells included: a union and one aggregation."""
    f = F.lit(factor)
    hits = ink.select(
        "page_id", F.floor(F.col("y") / f).cast("int").alias("cy"), F.floor(F.col("x") / f).cast("int").alias("cx"),
        F.lit(1).alias("n"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
    )
    cells = grid.select("page_id", "cy", "cx", F.lit(0).alias("n"), "width", "height")
    return hits.unionByName(cells).groupBy("page_id", "cy", "cx").agg(
        F.sum("n").alias("n"), F.max("width").alias("width"), F.max("height").alias("height")
    ).filter("width is not null")


def gray_of(ink_count: Column, area: Column) -> Column:
    """Coverage -> 8-bit gray, 255 is blank; half to even."""
    return F.bround(F.lit(255.0) * (F.lit(1.0) - ink_count / area)).cast("int")


def mean_pool(ink: DataFrame, pages: DataFrame, factor: int) -> DataFrame:
    """Gray per full cell; remainder trimmed."""
    cells = _coverage(ink, cell_grid(pages, factor, partial=False), factor)
    return cells.select("page_id", "cy", "cx", gray_of(F.col("n"), F.lit(float(factor * factor))).alias("gray"))


def cell_area(cy: Column, cx: Column, factor: int, width: Column, height: Column) -> Column:
    f = F.lit(factor)
    h = F.least(height, (cy + 1) * f) - cy * f
    w = F.least(width, (cx + 1) * f) - cx * f
    return (h * w).cast("double")


def reduced_read(ink: DataFrame, pages: DataFrame, factor: int, mode: str = "average") -> DataFrame:
    """Display-resolution cells, ceil-sized at the edges; ``max`` keeps any stroke."""
    cells = _coverage(ink, cell_grid(pages, factor, partial=True), factor)
    if mode == "max":
        gray = F.when(F.col("n") > 0, 0).otherwise(255)
    else:
        area = cell_area(F.col("cy"), F.col("cx"), factor, F.col("width"), F.col("height"))
        gray = gray_of(F.col("n"), area)
    return cells.select("page_id", "cy", "cx", gray.alias("gray"))


# ---------------------------------------------------------------------- long lines

def _line_pixels(ink: DataFrame, by: list[str], along: str, run_px: Column | int, thickness: int,
                 carry: list[str]) -> DataFrame:
    """Ink on runs of at least ``run_px`` along one axis after dilating across it."""
    across = "y" if along == "x" else "x"
    run = run_px if isinstance(run_px, Column) else F.lit(run_px)
    reach = list(range(-(thickness // 2), thickness - thickness // 2))
    fat = (
        ink.select(*by, "y", "x", *carry, F.explode(F.array(*[F.lit(d) for d in reach])).alias("_d"))
        .withColumn("_own", F.col("_d") == 0)
        .withColumn(across, F.col(across) + F.col("_d"))
        .groupBy(*by, across, along)
        .agg(F.max("_own").alias("_own"), *[F.max(c).alias(c) for c in carry])
    )
    line = Window.partitionBy(*by, across).orderBy(along)
    islands = fat.withColumn("_island", F.col(along) - F.row_number().over(line))
    length = F.count(F.lit(1)).over(Window.partitionBy(*by, across, "_island"))
    return islands.withColumn("_len", length).filter(F.col("_own")).select(
        *by, "y", "x", *carry, (F.col("_len") >= run).alias("_long")
    )


def long_line_flags(ink: DataFrame, by: list[str], run_px: Column | int, thickness: int = 3,
                    carry: list[str] = ()) -> DataFrame:
    """Every ink pixel with ``on_line``: part of a long horizontal or vertical run."""
    carry = list(carry)
    rows = _line_pixels(ink, by, "x", run_px, thickness, carry)
    cols = _line_pixels(ink, by, "y", run_px, thickness, carry)
    return rows.unionByName(cols).groupBy(*by, "y", "x").agg(
        F.max("_long").alias("on_line"), *[F.max(c).alias(c) for c in carry]
    )


def suppress_long_lines(ink: DataFrame, by: list[str], run_px: Column | int, thickness: int = 3,
                        carry: list[str] = ()) -> DataFrame:
    if isinstance(ink, packed.Rasters):
        run = run_px if isinstance(run_px, Column) else F.lit(run_px)

        def clear(state: dict, facts: dict) -> None:
            state["ink"] &= ~packed.on_lines(state["ink"], facts["_run_px"], thickness)

        return ink.then(clear, _run_px=run)
    return long_line_flags(ink, by, run_px, thickness, carry).filter(~F.col("on_line")).drop("on_line")


# ------------------------------------------------------------------- neighbourhoods

_RING = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def boundary_flags(ink: DataFrame, by: list[str], carry: list[str]) -> DataFrame:
    """Ink pixels with ``edge``: some 8-neighbour inside the raster is blank.

    ``carry`` must hold the raster's ``width`` and ``height``; outside counts as ink.
    """
    if isinstance(ink, packed.Rasters):
        return ink.then(lambda state, facts: state.update(edge=packed.edges(state["ink"])))
    seen = (
        ink.select(*by, "y", "x", *carry, F.explode(offsets(_RING, "dy", "dx")).alias("o"))
        .select(
            *by, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), *carry,
            ((F.col("o.dy") == 0) & (F.col("o.dx") == 0)).alias("_own"),
        )
        .groupBy(*by, "y", "x")
        .agg(F.max("_own").alias("_own"), F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in carry])
        .filter("_own")
    )
    rows = F.lit(1) + (F.col("y") > 0).cast("int") + (F.col("y") < F.col("height") - 1).cast("int")
    cols = F.lit(1) + (F.col("x") > 0).cast("int") + (F.col("x") < F.col("width") - 1).cast("int")
    return seen.withColumn("edge", F.col("_n") < rows * cols).drop("_own", "_n")


def gaussian_kernel(sigma: float = 1.2, truncate: float = 4.0) -> list[float]:
    reach = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    total = sum(weights)
    return [w / total for w in weights]


def _convolve(a: list[float], b: list[float]) -> list[float]:
    out = [0.0] * (len(a) + len(b) - 1)
    for i, u in enumerate(a):
        for j, v in enumerate(b):
            out[i + j] += u * v
    return out


def gradient_kernels(sigma: float = 1.2) -> list[tuple[int, float, float]]:
    """(offset, slope weight, smooth weight) of the Gaussian composed with the Sobel taps."""
    g = gaussian_kernel(sigma)
    slope, smooth = _convolve(g, [-1.0, 0.0, 1.0]), _convolve(g, [1.0, 2.0, 1.0])
    reach = len(slope) // 2
    return [(i - reach, slope[i], smooth[i]) for i in range(len(slope))]


def edge_normals(flagged: DataFrame, by: list[str], sigma: float = 1.2, carry: list[str] = ()) -> DataFrame:
    """Unit gradient ``nx, ny`` at the edge pixels of ``boundary_flags`` output.

    The composed kernel is separable: 13 copies along x, then 13 along y, instead of
    169. Outside the raster is blank. The edge flag rides along on the centre copy.
    """
    carry = list(carry)
    if isinstance(flagged, packed.Rasters):
        kernels = gradient_kernels(sigma)
        return flagged.then(lambda state, facts: state.update(
            normals=packed.normals(state["ink"], state["edge"], kernels)))
    # A pixel at p adds weight k(p - q) to target q, hence the mirrored offset.
    taps = offsets([(-d, s, m) for d, s, m in gradient_kernels(sigma)], "d", "slope", "smooth")
    along_x = (
        flagged.select(*by, "y", "x", "edge", *carry, F.explode(taps).alias("k"))
        .select(
            *by, "y", (F.col("x") + F.col("k.d")).alias("x"), *carry, F.col("k.slope").alias("a"), F.col("k.smooth").alias("b"),
            (F.col("edge") & (F.col("k.d") == 0)).alias("edge"),
        )
        .groupBy(*by, "y", "x")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("edge").alias("edge"), *[F.max(c).alias(c) for c in carry])
    )
    both = (
        along_x.select("*", F.explode(taps).alias("k"))
        .select(
            *by, (F.col("y") + F.col("k.d")).alias("y"), "x", *carry,
            (F.col("a") * F.col("k.smooth")).alias("gx"), (F.col("b") * F.col("k.slope")).alias("gy"),
            (F.col("edge") & (F.col("k.d") == 0)).alias("edge"),
        )
        .groupBy(*by, "y", "x")
        .agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"), F.max("edge").alias("edge"), *[F.max(c).alias(c) for c in carry])
        .filter("edge")
    )
    size = F.greatest(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), F.lit(1e-6))
    return both.select(*by, "y", "x", *carry, (F.col("gx") / size).alias("nx"), (F.col("gy") / size).alias("ny"))


def ink_density(ink: DataFrame, by: list[str], window_px: int) -> DataFrame:
    """Share of ink in a square window; pixels whose window is empty have no row."""
    n = max(1, window_px)
    # The window of a target spans -(n // 2) .. n - n // 2 - 1; scattering mirrors it.
    reach = [-d for d in range(-(n // 2), n - n // 2)]
    return box_scatter(ink.withColumn("v", F.lit(1.0)), by, reach).withColumn(
        "density", F.col("v") / F.lit(float(n * n))
    ).drop("v")


def spread_runs(runs: DataFrame, line: list[str], axis: str) -> DataFrame:
    """Per cell of a line, the sum of ``v`` over the runs ``_from .. _to`` that cover it.

    A run is a step up where it begins and one down behind its end. Steps of a line are
    added up in order, so a run costs two rows however long it is, and the cells between two
    steps come out at once. ``line`` names one raster line (a page's row or column, with a radius
    if there is one); cells that no run covers have no row.
    """
    up = F.struct(F.col("_from").alias("p"), F.col("v").alias("s"), F.lit(1).alias("c"))
    down = F.struct((F.col("_to") + 1).alias("p"), (-F.col("v")).alias("s"), F.lit(-1).alias("c"))
    steps = runs.filter("_from <= _to").select(*line, F.explode(F.array(up, down)).alias("e")).groupBy(
        *line, F.col("e.p").alias("p")).agg(F.sum("e.s").alias("s"), F.sum("e.c").alias("c"))
    along = Window.partitionBy(*line).orderBy("p")
    levels = steps.select(
        *line, "p", F.sum("s").over(along).alias("v"), F.sum("c").over(along).alias("c"), F.lead("p").over(along).alias("q"))
    return levels.filter("c > 0").select(*line, F.explode(F.sequence(F.col("p"), F.col("q") - 1)).alias(axis), "v")


def box_scatter(cells: DataFrame, by: list[str], reach: list[int]) -> DataFrame:
    """Separable window sum of ``v``: along x, then along y. ``reach`` is a range of offsets.

    Each pass adds up steps, so its cost does not depend on the window's size.
    """
    rows = spread_runs(
        cells.select(*by, "y", (F.col("x") + min(reach)).alias("_from"), (F.col("x") + max(reach)).alias("_to"), "v"),
        [*by, "y"], "x")
    return spread_runs(
        rows.select(*by, "x", (F.col("y") + min(reach)).alias("_from"), (F.col("y") + max(reach)).alias("_to"), "v"),
        [*by, "x"], "y").select(*by, "y", "x", "v")


def ring_offsets(radius: float, thickness: float) -> list[tuple[int, int]]:
    outer, inner = radius + thickness, radius - thickness
    span = range(-math.ceil(outer), math.ceil(outer) + 1)
    return [(dy, dx) for dy in span for dx in span if inner <= math.hypot(dy, dx) <= outer]


def ring_runs(radius: float, thickness: float) -> list[tuple[int, int, int]]:
    """The ring's offsets as runs ``(dy, first dx, last dx)``: one or two per row."""
    rows: dict[int, list[int]] = {}
    for dy, dx in ring_offsets(radius, thickness):
        rows.setdefault(dy, []).append(dx)
    runs = []
    for dy, places in rows.items():
        places.sort()
        starts = [i for i, dx in enumerate(places) if i == 0 or dx > places[i - 1] + 1]
        runs += [(dy, places[i], places[j - 1]) for i, j in zip(starts, [*starts[1:], len(places)])]
    return runs


def annulus_response(ink: DataFrame, by: list[str], radius: float, thickness: float = 2.0) -> DataFrame:
    """Mean ink on a thin ring around every pixel that has any.

    A pixel gives one or two runs to each row that the ring crosses.
    """
    size = len(ring_offsets(radius, thickness))
    runs = ink.select(*by, "y", "x", F.explode(offsets(ring_runs(radius, thickness), "dy", "lo", "hi")).alias("o"))
    summed = spread_runs(
        runs.select(*by, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.lo")).alias("_from"),
                    (F.col("x") + F.col("o.hi")).alias("_to"), F.lit(1).cast("long").alias("v")),
        [*by, "y"], "x")
    return summed.select(*by, "y", "x", (F.col("v") / F.lit(float(size))).alias("response"))


# ------------------------------------------------------------------------ pyramid

def pyramid(ink: DataFrame, pages: DataFrame, levels: int, tile_size: int = 512) -> DataFrame:
    """Tile cells at factors 2, 4, 8 … with exact ink counts and gray.

    Each level sums the level below, not pixels again. Pixels are hashed once on the
    block that the coarsest level turns into one cell, so all levels share that shuffle.
    Cells without ink have no row; they read as blank.
    """
    top = 1 << levels
    placed = with_page_facts(ink, pages, "width", "height").withColumns({
        "_by": F.floor(F.col("y") / top).cast("int"), "_bx": F.floor(F.col("x") / top).cast("int"),
    })
    key = ["page_id", "_by", "_bx"]
    level = co_locate(placed, key).select(
        *key, "width", "height", F.col("y").alias("cy"), F.col("x").alias("cx"), F.lit(1).cast("long").alias("ink")
    )
    out = None
    for n in range(1, levels + 1):
        factor = 1 << n
        level = level.groupBy(
            *key, F.shiftright("cy", 1).alias("cy"), F.shiftright("cx", 1).alias("cx")
        ).agg(F.sum("ink").alias("ink"), F.max("width").alias("width"), F.max("height").alias("height"))
        area = cell_area(F.col("cy"), F.col("cx"), factor, F.col("width"), F.col("height"))
        part = level.select(
            "page_id", F.lit(factor).alias("factor"),
            F.floor(F.col("cy") / tile_size).cast("int").alias("ty"), F.floor(F.col("cx") / tile_size).cast("int").alias("tx"),
            "cy", "cx", "ink", gray_of(F.col("ink"), area).alias("gray"),
            F.when(F.col("ink") > 0, 0).otherwise(255).alias("bold"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def write_pyramid(cells: DataFrame, path: str) -> str:
    """Stored by level and tile row, the two columns a window query prunes on."""
    cells.write.partitionBy("factor", "ty").parquet(path)
    return path


def tile_window(cells: DataFrame, windows: DataFrame, tile_size: int = 512, value: str = "gray") -> DataFrame:
    """All cells meeting a native box at a level; missing cells are blank (255).

    ``windows``: ``window_id, page_id, factor, x0, y0, x1, y1`` already clipped to the page.
    The output of a window is its own cell grid, so the join is an equality on cells.
    """
    f = F.col("factor")
    grid = (
        windows.filter("x1 > x0 and y1 > y0")
        .select(
            "window_id", "page_id", "factor",
            F.floor(F.col("x0") / f).cast("int").alias("_x0"), F.ceil(F.col("x1") / f).cast("int").alias("_x1"),
            F.explode(F.sequence(F.floor(F.col("y0") / f).cast("int"), F.ceil(F.col("y1") / f).cast("int") - 1)).alias("cy"),
        )
        .select(
            "window_id", "page_id", "factor", "cy",
            F.explode(F.sequence(F.col("_x0"), F.col("_x1") - 1)).alias("cx"),
        )
        .withColumn("ty", F.floor(F.col("cy") / tile_size).cast("int"))
    )
    have = cells.select("page_id", "factor", "ty", "cy", "cx", F.col(value).alias("_v"))
    return grid.join(have, ["page_id", "factor", "ty", "cy", "cx"], "left").select(
        "window_id", "page_id", "factor", "cy", "cx", F.coalesce("_v", F.lit(255)).alias(value)
    )


def stale_sources(catalog: DataFrame, stored: DataFrame) -> DataFrame:
    """Sources whose current revision has no stored tiles."""
    return catalog.join(stored.select("source_id", "revision").distinct(), ["source_id", "revision"], "left_anti")
