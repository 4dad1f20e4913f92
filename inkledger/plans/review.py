"""Review workflows: commit and progress, and a subset taken from an import."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.operators import commits, ledger, subsets
from inkledger.plans.manifest_import import ManifestImport
from inkledger.sources import sinks, versions


def commit_and_count(stored: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply a commit log to a stored ledger; returns the new ledger and its progress."""
    baseline = stored.select("file_key", "has_stamp", "stamp_type", "log_types", "notes")
    after = commits.apply_edits(stored, commits.latest_edits(edits, baseline))
    return after, ledger.progress(after)


def import_files(plan: ManifestImport) -> DataFrame:
    """Resolved files in the form ``merge_files`` takes."""
    return plan.files.withColumn("from_manifest", F.lit(True))


def replace_subset(plan: ManifestImport, stored: DataFrame, root: str) -> bool:
    """Make the loaded identifiers of an import the new subset, all or nothing.

    Nothing changes unless at least one path resolved. The ledger with the import's new files and
    the subset become the tables ``ledger`` and ``subset`` of one new version of the store ``root``
    (``sources.versions``): readers see both or neither, and a failing write leaves both old ones.
    """
    if not plan.resolved.filter("resolved_path is not null").take(1):
        return False
    members, rejected = subsets.define(
        plan.loaded_identifiers.select(F.col("id_rank").alias("position"), F.col("identifier").alias("value"))
    )
    if rejected.take(1):
        raise ValueError("a subset identifier must contain 1 to 14 digits")
    merged = ledger.merge_files(stored, import_files(plan))
    rows = sinks.ledger_rows(merged, declared=list(plan.roles.metadata()))
    versions.write_tables(stored.sparkSession, root, {"ledger": rows, "subset": members})
    return True
