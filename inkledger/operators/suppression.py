"""Suppression of weaker neighbours among ring candidates, in rounds over grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.session import cut_lineage

# The cell of a place and the eight around it.
NINE = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def _around(cells: DataFrame) -> DataFrame:
    """Rows of ``_gy, _gx`` once for their own cell and each of the eight beside it."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in NINE])
    return cells.withColumn("_s", F.explode(steps)).withColumns({
        "_gy": F.col("_gy") + F.col("_s.dy"), "_gx": F.col("_gx") + F.col("_s.dx"),
    }).drop("_s")


def _apart2(y: Column, x: Column) -> Column:
    dy, dx = F.col("_cy") - y, F.col("_cx") - x
    return dy * dy + dx * dx


def independent(candidates: DataFrame, by: list[str], min_sep: str) -> DataFrame:
    """The candidates that are kept when the strongest is taken first and those near it go.

    ``candidates`` has ``votes, cy, cx, radius`` and the column ``min_sep``, which is the same for
    all of a group (``by``); a null distance is 0. Order is by falling votes, then cy, cx, radius
    and the other columns. A candidate goes if a kept one is within ``min_sep``; of rows equal
    in everything one stays. Nulls in ``by`` make a group of their own.

    Groups are cut into square cells of ``min_sep``. In a round each cell names its strongest
    open candidate; it is kept if no stronger open candidate is near it, and all open ones near
    it are closed. Whoever is kept in a round would also be kept in sequence, as nothing
    stronger is left around. A round is two equi-joins on cells in which an open candidate meets
    the named ones of nine cells, so its cost grows with the candidates however many share a
    cell, and no group is ever put together in one row or task. There are as many rounds as
    the longest chain of candidates that wait for each other across cells.
    """
    spark = candidates.sparkSession
    names = [F.col(f"`{c}`") for c in candidates.columns]
    others = [F.col(f"`{c}`") for c in candidates.columns if c not in (*by, "votes", "cy", "cx", "radius")]
    sep = F.coalesce(F.col(f"`{min_sep}`").cast("double"), F.lit(0.0))
    side = F.greatest(sep, F.lit(1.0))
    cy, cx = F.col("cy").cast("double"), F.col("cx").cast("double")
    rows = cut_lineage(candidates.select(
        F.struct(*by).alias("_of"), F.floor(cy / side).alias("_gy"), F.floor(cx / side).alias("_gx"),
        cy.alias("_cy"), cx.alias("_cx"), sep.alias("_sep"),
        F.struct((-F.col("votes")).alias("weak"), "cy", "cx", "radius", F.xxhash64(*others).alias("rest"),
                 F.monotonically_increasing_id().alias("id")).alias("_rank"),
        F.struct(*names).alias("_row")))
    cell = ["_of", "_gy", "_gx"]
    open_, kept = rows.drop("_row"), None
    while not open_.isEmpty():
        first = open_.groupBy(*cell).agg(F.min(F.struct("_rank", "_cy", "_cx", "_sep")).alias("_first"))
        named = _around(first.withColumn("_at", F.struct("_gy", "_gx")))
        lead = F.col("_first")
        blocked = open_.join(named, cell).filter(
            (F.col("_rank") < lead["_rank"])
            & (_apart2(lead["_cy"], lead["_cx"]) <= lead["_sep"] * lead["_sep"])
        ).select(lead["_rank"]["id"].alias("_id")).distinct()
        chosen = cut_lineage(
            first.withColumn("_id", lead["_rank"]["id"]).join(blocked, "_id", "left_anti")
            .select("_id", *cell, lead["_cy"].alias("_ky"), lead["_cx"].alias("_kx")))
        near = _around(chosen.select(*cell, "_ky", "_kx"))
        same = [open_[c] == near[c] for c in cell]
        open_ = cut_lineage(open_.join(
            near, [*same, _apart2(near["_ky"], near["_kx"]) <= F.col("_sep") * F.col("_sep")], "left_anti"))
        ids = chosen.select("_id")
        kept = ids if kept is None else kept.unionByName(ids)
    if kept is None:
        return candidates
    taken = rows.withColumn("_id", F.col("_rank.id")).join(kept, "_id", "left_semi")
    return taken.select(*[F.col(f"_row.`{c}`").alias(c) for c in candidates.columns])


def strongest(candidates: DataFrame, by: list[str], cap: int) -> DataFrame:
    """The ``cap`` strongest of each group, chosen per task before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col("votes").desc(), "cy", "cx", "radius")
    return candidates.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap).drop("_n")
