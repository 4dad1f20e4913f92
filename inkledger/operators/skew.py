"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
SALTS = 64


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    weight: str,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
    max_weight: int | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, which holds one row per key.

    ``right[weight]`` says how many left rows carry the key; it comes from the
    aggregation that made ``right``, so finding the hot keys costs no extra pass
    over the left side. The hot-key list is broadcast: it cannot exceed
    ``rows(left) / hot_rows`` keys. Left rows of a hot key are spread over
    ``salts`` partitions and its single right row is repeated as often; all other
    keys join as usual. The result is clustered by key *and* salt, so a following
    aggregation on the key combines before it shuffles.

    A caller that knows the largest weight passes ``max_weight``; when it rules out hot
    keys the plain join is planned.
    """
    if max_weight is not None and max_weight < hot_rows:
        return left.join(right, on, how)
    hot = right.filter(F.col(weight) >= hot_rows).select(*on).withColumn("_hot", F.lit(True))
    spread = [c for c in left.columns if c not in on]
    salted_left = left.join(F.broadcast(hot), on, "left").withColumn(
        "_salt",
        F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0),
    )
    copies = F.when(
        F.col(weight) >= hot_rows, F.sequence(F.lit(0), F.lit(salts - 1))
    ).otherwise(F.array(F.lit(0)))
    salted_right = right.withColumn("_salt", F.explode(copies))
    return salted_left.drop("_hot").join(salted_right, [*on, "_salt"], how).drop("_salt")


def spread_few_splits(rows: DataFrame, by: str) -> DataFrame:
    """Hash rows over all cores when the input is too small to have a split per core.

    One unsplittable file would otherwise run every expression in one task. Inputs of at
    least a split per core, that is all large ones, are left alone and gain no shuffle.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) >= cores * split:
        return rows
    return rows.repartition(cores, by)
