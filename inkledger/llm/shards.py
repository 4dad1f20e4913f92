"""K-d tree sharding of pages: near-equal bytes, cut along the widest metadata dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkledger.session import cut_lineage

# A group of equal pages stays whole up to this part of a shard; the rest are cut if need be.
WHOLE_PART = 256
# Rows numbered by one task.
SLOT_ROWS = 2_000


def order_code(text: Column) -> Column:
    """Strings on a number line, in the order of their first six bytes; null comes first."""
    head = F.rpad(F.hex(F.substring(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def _splits(shards: int) -> list[list[tuple[int, int]]]:
    """Per level, the open cells as (first shard, end); a leaf has one shard."""
    levels, cells = [], [(0, shards)]
    while any(b - a > 1 for a, b in cells):
        levels.append(cells)
        cells = [half for a, b in cells for half in
                 ([(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > 1 else [(a, b)])]
    return levels


def _by_number(values: dict[int, float], key: Column, kind: str) -> Column:
    pairs = [F.lit(x) for k, v in values.items() for x in (int(k), v)]
    return F.element_at(F.create_map(*pairs), key).cast(kind)


def shard_pages(
    pages: DataFrame, shards: int, dims: dict[str, Column], size: Column, same: Column,
    key: str = "page_id", keep: dict[str, Column] | None = None,
) -> DataFrame:
    """Put all pages into shards 0 .. ``shards`` - 1 of near-equal total ``size``.

    A k-d tree over ``dims`` (numbers such as width, height and dpi; null counts as 0): each
    cell is cut along the dimension in which it is widest, as a share of the whole table's
    width, at the weighted median, or at the matching quantile when it holds an odd number of
    shards, until every leaf is one shard. Medians are exact: rows are range-sorted and their
    sizes summed up across partitions.

    Pages with equal ``same`` are one group with one place (its least coordinates). Small
    groups stay in one shard; a group beyond 1/256 of a shard is cut only where a median falls
    into it. Ties are ordered by the group's and the key's hash. Returns key, size, shard, slot
    (gapless from 0 in a shard) and the ``keep`` columns; null and repeated keys are rows like
    others; null sizes count as 0; an empty table gives no rows.
    """
    keep = keep or {}
    names = [f"d{i}" for i in range(len(dims))]
    rows = cut_lineage(pages.select(
        F.col(key).cast("long").alias("key"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
        F.xxhash64(same).alias("same"),
        *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in zip(names, dims.values())],
        *[c.alias(f"keep_{n}") for n, c in keep.items()]))
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    least = {n: F.min(n).alias(n) for n in names}
    # At most shards * WHOLE_PART groups can be heavy.
    heavy = cut_lineage(rows.groupBy("same").agg(F.sum("size").alias("w"), *least.values()).filter(
        F.col("w") * shards * WHOLE_PART > total)).select(
        "same", F.lit(True).alias("heavy"), *[F.col(n).alias(f"h_{n}") for n in names])
    marked = rows.join(F.broadcast(heavy), "same", "left").withColumn(
        "part", F.when(F.col("heavy"), F.xxhash64("key")).otherwise(0))
    units = marked.groupBy("same", "part").agg(
        F.sum("size").alias("w"), *[F.coalesce(F.min(f"h_{n}"), F.min(n)).alias(n) for n in names])
    units = cut_lineage(units.withColumn("cell", F.lit(0)))
    whole = units.agg(*[F.max(n) - F.min(n) for n in names]).first()
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for cells in _splits(shards) if n_rows else []:
        ends = dict(cells)
        # One row per cell: at most as many as shards.
        stats = units.groupBy("cell").agg(
            F.sum("w").alias("w"), *[(F.max(n) - F.min(n)).alias(n) for n in names]).collect()
        axis, goal, middle = {}, {}, {}
        for s in stats:
            a, b = s["cell"], ends[s["cell"]]
            shares = [(s[n] or 0) / (r or 1) for n, r in zip(names, whole)]
            axis[a] = shares.index(max(shares))
            middle[a] = (a + b) // 2 if b - a > 1 else a
            goal[a] = s["w"] * ((middle[a] - a) / (b - a)) if b - a > 1 else -1.0
        along = _by_number(axis, F.col("cell"), "int")
        value = F.coalesce(*[F.when(along == i, F.col(n)) for i, n in enumerate(names)])
        dealt = cut_lineage(
            units.withColumn("_v", value).repartitionByRange(tasks, "cell", "_v", "same", "part")
            .withColumn("_p", F.spark_partition_id()))
        # One row per range partition and cell.
        sums = dealt.groupBy("cell", "_p").agg(F.sum("w").alias("_sum"))
        before = Window.partitionBy("cell").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        base = sums.select("cell", "_p", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
        inside = Window.partitionBy("cell", "_p").orderBy("_v", "same", "part").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        summed = dealt.join(F.broadcast(base), ["cell", "_p"]).withColumn(
            "_half", F.col("_base") + F.sum("w").over(inside) - F.col("w") / 2)
        right = F.col("_half") >= _by_number(goal, F.col("cell"), "double")
        units = summed.withColumn(
            "cell", F.when(right, _by_number(middle, F.col("cell"), "int")).otherwise(F.col("cell"))
        ).select("same", "part", "w", *names, "cell")
    placed = cut_lineage(marked.join(units.select("same", "part", F.col("cell").alias("shard")),
                                     ["same", "part"]).drop("heavy", "part", *[f"h_{n}" for n in names]))
    lots = max(1, -(-n_rows // (shards * SLOT_ROWS)))
    lotted = placed.withColumn("_lot", F.pmod(F.xxhash64("key"), F.lit(lots)))
    earlier = Window.partitionBy("shard").orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lotted.groupBy("shard", "_lot").count().select(
        "shard", "_lot", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_first"))
    slot = F.row_number().over(Window.partitionBy("shard", "_lot").orderBy("key", "same")) - 1
    # A row per shard and lot of about SLOT_ROWS rows.
    return lotted.withColumn("_n", slot).join(offsets, ["shard", "_lot"]).select(
        F.col("key").alias(key), "size", F.col("shard").cast("int").alias("shard"),
        (F.col("_first") + F.col("_n")).cast("long").alias("slot"),
        *[F.col(f"keep_{n}").alias(n) for n in keep])
