"""Detector inventory against the human review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.functions.scoring import decision


def verdict_against_truth(verdicts: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Full outer join on ``key`` -> counts per (verdict, has_stamp)."""
    joined = verdicts.select(key, "verdict").join(truth.select(key, "has_stamp"), key, "full_outer")
    return joined.groupBy("verdict", "has_stamp").agg(F.count(F.lit(1)).alias("n"))


def threshold_sweep(scores: DataFrame, truth: DataFrame, key: str, thresholds: list[float]) -> DataFrame:
    """Precision and recall of ``score >= t`` for each of a short list of thresholds.

    One pass counts score buckets between the thresholds; sums over the bucket table
    give every threshold, so rows are never repeated per threshold.
    """
    cuts = sorted(set(float(t) for t in thresholds))
    level = F.lit(0)
    for t in cuts:
        level = level + F.when(F.col("score") >= t, 1).otherwise(0)
    buckets = (
        scores.select(key, "score").join(truth.select(key, "has_stamp"), key)
        .groupBy(level.alias("level"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("has_stamp").alias("n_true"))
    )
    rows = buckets.select(
        "n", "n_true", "level",
        F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(cuts)])).alias("c"),
    )
    reached = F.col("level") >= F.col("c.i")
    zero = F.lit(0)
    return (
        rows.groupBy(F.col("c.t").alias("threshold"))
        .agg(
            F.sum(F.when(reached, F.col("n_true")).otherwise(zero)).alias("true_positive"),
            F.sum(F.when(reached, F.col("n") - F.col("n_true")).otherwise(zero)).alias("false_positive"),
            F.sum(F.when(~reached, F.col("n_true")).otherwise(zero)).alias("false_negative"),
        )
        .withColumn("precision", F.col("true_positive") / F.nullif(F.col("true_positive") + F.col("false_positive"), zero))
        .withColumn("recall", F.col("true_positive") / F.nullif(F.col("true_positive") + F.col("false_negative"), zero))
    )


def rethreshold(scores: DataFrame, t_hit: float, t_miss: float) -> DataFrame:
    return scores.withColumn("decision", decision(F.col("score"), t_hit, t_miss))
