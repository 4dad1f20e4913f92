"""Mixing sources of review records to target weights, with a cap on repetition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.session import cut_lineage

# Rows of one bucket of a source's seeded order, about; rows of one run of equal records.
BUCKET_ROWS, RUN_ROWS = 50_000, 65_536


def n_words(notes: Column) -> Column:
    """Runs of anything but blanks, tabs and line ends; a null note has none."""
    return F.coalesce(F.regexp_count(notes, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_level(sources: DataFrame, total: int) -> float:
    """The level at which weights times level, capped, fill ``total``.

    ``sources`` has ``weight`` and ``cap``. A round spreads what the clamped sources leave over
    the others by weight; sources that this raises above their cap are clamped from then on.
    Clamped are the sources whose cap is below weight times the last level, which only rises, so
    a round is one aggregate and its state one number. Infinite if all caps together hold less.
    """
    level = 0.0
    if total <= 0:
        return level
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        left = sources.filter("weight > 0").agg(
            F.sum(F.when(over, F.col("cap"))).alias("clamped"),
            F.sum(F.when(~over, F.col("weight").cast("decimal(38,12)"))).alias("weight")).first()
        if not left["weight"]:
            return math.inf
        raised = (total - float(left["clamped"] or 0)) / float(left["weight"])
        if raised <= level:
            return level
        level = raised


def source_targets(sources: DataFrame, total: int, most_epochs: int) -> DataFrame:
    """Add ``target``: weight times the water level, at most ``most_epochs`` times the size.

    ``sources`` has ``source, weight, source_size``.
    """
    capped = sources.withColumn("cap", F.lit(most_epochs) * F.col("source_size"))
    level = water_level(capped, total)
    filled = F.col("weight") * F.lit(level)
    full = (F.col("cap") < filled) if math.isfinite(level) else (F.col("weight") > 0)
    return capped.withColumn(
        "target", F.when(full, F.col("cap").cast("double")).otherwise(
            filled if math.isfinite(level) else F.lit(0.0))).drop("cap")


def mix_sources(
    records: DataFrame, weights: DataFrame, share: float = 1.5, most_epochs: int = 2, seed: int = 13,
    source: str = "reviewed_by", notes: str = "notes", position: str = "position",
) -> DataFrame:
    """How often every review record goes into a mixture of sources.

    ``records`` are rows of the review ledger with a ``position``; ``source`` is the column that
    tells where a record is from (its reviewer, stamp type, folder, ...), ``weights`` has
    ``source, weight``, one row per source, null included; a source without a row has weight 0.
    A record's size is the number of words of its notes. The mixture's size, ``share`` of all
    sizes, is dealt to the sources by weight; none gets more than ``most_epochs`` times its size,
    and what that leaves is dealt to the others until none is above (``water_level``).

    A source's target is met in whole repetitions of all its records, then one more of those that
    come first in a seeded order (SHA-256 of seed, position and notes) until the target, rounded
    down, is reached; the record at that point gives only as many of its words as are left. So a
    source's taken words are its target but for less than one, and runs agree.

    Returns one row per record: position, source, size, source_size, target, taken (words,
    repetitions counted). Null or empty notes have size 0 and are not taken. Null and repeated
    positions are told apart by their notes, and equal records are interchangeable; columns
    besides the three named take no part; an empty table gives no rows.

    The seeded order is cut into buckets by the hash's first digits. Bucket sizes are added up
    per source; only the rows of the bucket in which a target is reached are sorted. Equal
    records are counted in runs of bounded length, so no group of copies is one task's work.
    """
    note, at = F.col(f"`{notes}`").cast("string"), F.col(f"`{position}`").cast("long")
    spelled = F.concat_ws(":", F.lit(str(seed)), F.coalesce(at.cast("string"), F.lit("")), note)
    rows = cut_lineage(records.select(
        at.alias("position"), F.col(f"`{source}`").cast("string").alias("source"),
        n_words(note).alias("size"), F.sha2(spelled.cast("binary"), 256).substr(1, 32).alias("place"),
        (F.monotonically_increasing_id() / RUN_ROWS).cast("long").alias("run")))
    digits = max(1, math.ceil(math.log(max(1, rows.count() / BUCKET_ROWS), 16)))
    rows = rows.withColumn("bucket", F.substring("place", 1, digits))
    named = F.struct("source").alias("of")  # a struct compares null as a value

    buckets = cut_lineage(rows.groupBy(named, "bucket").agg(F.sum("size").alias("bucket_size")))
    sizes = buckets.groupBy("of").agg(F.sum("bucket_size").alias("source_size"))
    listed = F.struct(F.col("source").cast("string").alias("source")).alias("of")
    weighed = sizes.join(weights.select(listed, F.col("weight").cast("double").alias("weight")), "of", "left")
    weighed = cut_lineage(weighed.fillna(0.0, ["weight"]))
    whole = weighed.agg(F.sum("source_size")).first()[0] or 0
    targets = source_targets(weighed, share * whole, most_epochs)

    goal = F.floor("target").cast("long")
    epochs = F.coalesce((goal / F.nullif("source_size", F.lit(0))).cast("long"), F.lit(0))
    before = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = buckets.join(
        targets.select("of", "source_size", "target", epochs.alias("epochs"),
                       (goal - epochs * F.col("source_size")).alias("more")), "of"
    ).withColumn("more", F.col("more") - F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    planned = rows.withColumn("of", F.struct("source")).join(plan, ["of", "bucket"])
    size, more = F.col("size"), F.col("more")
    inside = (more > 0) & (more < F.col("bucket_size"))
    easy = planned.filter(~inside).withColumn("extra", F.when(more > 0, size).otherwise(F.lit(0)))

    # The buckets in which a target is reached: runs of equal records in order, then their rows.
    run = ["of", "bucket", "place", "size", "run"]
    edge = planned.filter(inside)
    runs = edge.groupBy(*run).agg((F.count("*") * size).alias("run_size"))
    earlier = Window.partitionBy("of", "bucket").orderBy("place", "size", "run").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = runs.withColumn("start", F.coalesce(F.sum("run_size").over(earlier), F.lit(0))).drop("run_size")
    within = F.row_number().over(Window.partitionBy(*run).orderBy("position")) - 1
    left = more - F.col("start") - within * size
    hard = edge.join(starts, run).withColumn("extra", F.greatest(F.lit(0), F.least(size, left)))
    return easy.unionByName(hard.drop("start")).select(
        "position", "source", "size", "source_size", "target",
        (F.col("epochs") * size + F.col("extra")).cast("long").alias("taken"))
