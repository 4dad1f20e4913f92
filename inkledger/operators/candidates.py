"""Logical image candidates of a manifest: one per (identifier, base name)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.functions import text as tx
from inkledger.operators.skew import salted_join


def catalog_names(catalog: DataFrame) -> DataFrame:
    """The catalog reduced to one file per base name; the last duplicate wins."""
    return (
        catalog.select(
            tx.basename_key(F.col("path")).alias("basename_key"),
            F.col("folder_seq").cast("long").alias("folder_seq"),
            F.col("path").alias("path"),
        )
        .groupBy("basename_key")
        .agg(
            F.min("folder_seq").alias("folder_seq"),
            F.max(F.struct("folder_seq", "path"))["path"].alias("folder_path"),
        )
        .withColumn("lead", tx.leading_digits(F.col("basename_key")))
    )


def listed_references(tagged: DataFrame) -> DataFrame:
    """Eligible listed rows at the grain of distinct paths, combined map-side."""
    return (
        tagged.filter(F.col("eligible") & F.col("listed"))
        .groupBy("identifier", "basename_key", "listed_key")
        .agg(
            F.min(F.struct("import_row", "listed_path")).alias("_first"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        .select(
            "*",
            F.col("_first.import_row").alias("first_row"),
            F.col("_first.listed_path").alias("listed_path"),
        )
        .drop("_first")
    )


def folder_matches(identifiers: DataFrame, names: DataFrame) -> DataFrame:
    """Catalog files whose leading digit run is a spelling of an eligible identifier.

    An equality on the digit run replaces a prefix test against every file name, so
    this is a hash join. A digit run has at most two identifiers (with and without
    the closing 00), so no group multiplies.
    """
    spellings = identifiers.filter(F.col("n_eligible") > 0).select(
        "identifier", "id_rank", F.explode(tx.identifier_variants(F.col("identifier"))).alias("lead")
    )
    return names.filter(F.col("lead") != "").join(spellings, "lead").select(
        "identifier", "id_rank", "basename_key", "folder_seq", "folder_path"
    )


def candidate_union(
    identifiers: DataFrame, references: DataFrame, names: DataFrame | None
) -> DataFrame:
    """Folder matches first, then listed rows; ``rank`` carries the insertion order."""
    def rank(phase: int, seq: str) -> F.Column:
        return F.struct(
            F.lit(phase).alias("phase"), F.col("id_rank"), F.col(seq).alias("seq")
        ).alias("rank")

    listed = (
        references.groupBy("identifier", "basename_key")
        .agg(
            F.min("first_row").alias("first_row"),
            F.sum("n_rows").alias("n_rows"),
            F.count(F.lit(1)).alias("n_refs"),
        )
        .join(identifiers.select("identifier", "id_rank"), "identifier")
        .select(
            "identifier", "basename_key", rank(1, "first_row"), "n_rows", "n_refs"
        )
    )
    if names is None:
        return listed
    matched = folder_matches(identifiers, names).select(
        "identifier", "basename_key", rank(0, "folder_seq"),
        F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("n_refs"),
    )
    return (
        matched.unionByName(listed)
        .groupBy("identifier", "basename_key")
        .agg(
            F.min("rank").alias("rank"),
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_refs").alias("n_refs"),
        )
    )


def claim_names(candidates: DataFrame, names: DataFrame | None, max_weight: int | None = None) -> DataFrame:
    """Owner of every base name and the folder copy, joined back to the candidates.

    The first candidate by rank owns a name; other identifiers conflict. The owner is
    a mergeable minimum, not a window, so a name claimed by very many identifiers is
    combined before the shuffle and salted on the way back. ``max_weight`` bounds the
    claims per name when the caller knows it.
    """
    owners = (
        candidates.groupBy("basename_key")
        .agg(
            F.min(F.struct("rank", "identifier"))["identifier"].alias("owner"),
            F.count(F.lit(1)).alias("n_claims"),
        )
    )
    if names is None:
        owners = owners.withColumn("folder_path", F.lit(None).cast("string"))
    else:
        owners = owners.join(names.select("basename_key", "folder_path"), "basename_key", "left")
    claimed = salted_join(candidates, owners, ["basename_key"], "inner", weight="n_claims", max_weight=max_weight)
    return claimed.withColumn("conflict", F.col("owner") != F.col("identifier")).drop("n_claims")
