"""Connected components of a link table, in rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node reachable, for every node of a link to another node.

    Large-star and small-star rounds: every node hangs its larger neighbours, then its smaller
    ones, under the least node it knows, until all that hangs together is one star. Sums are
    combined before they are shuffled; no node's neighbours are ever collected.
    """
    edges = cut_lineage(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).distinct()
    )
    while not _are_stars(edges):
        # Larger neighbours hang under the least of a node's neighbourhood.
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("low"))
        large = both.filter("root > node").join(least, "node").select(
            F.col("root").alias("node"), F.col("low").alias("root")).distinct()
        # Smaller neighbours, and the node itself, hang under the least of them.
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = (
            large.join(low, "node").select(F.col("root").alias("node"), F.col("low").alias("root"))
            .unionByName(low.select("node", F.col("low").alias("root")))
            .filter("node <> root").distinct()
        )
        edges = cut_lineage(small)
    return edges


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node hangs under two roots or is a root itself."""
    ends = edges.select("node", F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("root").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter(
        F.col("hangs") * (1 + F.col("holds")) > 1).isEmpty()
