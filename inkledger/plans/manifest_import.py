"""Manifest import: rows + catalog + probes -> audit, files, statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.functions.depth import DepthFilter
from inkledger.operators import audit, candidates, manifest, resolution
from inkledger.operators.skew import spread_few_splits
from inkledger.session import cut_lineage


@dataclass(frozen=True)
class ManifestImport:
    """An import plan. Each property is a DataFrame.

    Four tables are written once to the shared checkpoint folder because several later
    steps read them: ``identifiers``, ``references``, ``candidate_ranks`` and ``resolved``.
    They are at the grain of identifiers, distinct listed paths and candidates; manifest
    rows are never copied.

    ``rows`` carries ``import_row`` and the source columns. ``catalog`` has ``path`` and
    ``folder_seq``; ``probe`` has ``path, path_exists, readable[, detail]``; ``roots``
    has ``root, available, detail``.
    """

    rows: DataFrame
    roles: manifest.ManifestRoles
    catalog: DataFrame | None = None
    probe: DataFrame | None = None
    roots: DataFrame | None = None
    depth_filter: DepthFilter | None = None
    source_dir: str = ""

    def __post_init__(self) -> None:
        if self.depth_filter and self.depth_filter.column not in self.rows.columns:
            raise manifest.ManifestError(f"unknown depth column: {self.depth_filter.column}")

    @cached_property
    def tagged(self) -> DataFrame:
        rows = spread_few_splits(self.rows, "import_row")
        return manifest.tag_rows(rows, self.roles, self.source_dir, self.depth_filter)

    @cached_property
    def identifiers(self) -> DataFrame:
        return cut_lineage(manifest.identifier_table(self.tagged))

    @cached_property
    def references(self) -> DataFrame:
        return cut_lineage(candidates.listed_references(self.tagged))

    @cached_property
    def names(self) -> DataFrame | None:
        return None if self.catalog is None else candidates.catalog_names(self.catalog)

    @cached_property
    def candidate_ranks(self) -> DataFrame:
        return cut_lineage(
            candidates.candidate_union(self.identifiers, self.references, self.names)
        )

    @cached_property
    def candidates(self) -> DataFrame:
        return candidates.claim_names(self.candidate_ranks, self.names, self.candidate_ranks.count())

    @cached_property
    def choices(self) -> DataFrame:
        listed = resolution.choice_list(self.candidates, self.references, self.references.count())
        return resolution.join_root_status(listed, self.roots)

    @cached_property
    def judged(self) -> DataFrame:
        return resolution.judge_choices(
            self.choices, resolution.probe_table(self.probe, self.catalog)
        )

    @cached_property
    def resolved(self) -> DataFrame:
        return cut_lineage(resolution.resolve_candidates(self.candidates, self.judged))

    @cached_property
    def wells(self) -> DataFrame:
        return audit.well_status(self.identifiers, self.resolved)

    @cached_property
    def audit(self) -> DataFrame:
        outcomes = audit.outcome_table(self.wells, self.resolved, self.identifiers)
        return audit.classify_rows(self.tagged, outcomes, self._largest_key)

    @cached_property
    def _largest_key(self) -> int:
        """Most manifest rows that any audit key holds, from the two written tables."""
        rows = self.identifiers.select(F.col("n_without_candidate").alias("n")).unionByName(
            self.resolved.select(F.col("n_rows").alias("n"))
        )
        return rows.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]

    @cached_property
    def files(self) -> DataFrame:
        return audit.resolved_files(self.tagged, self.resolved)

    @cached_property
    def loaded_identifiers(self) -> DataFrame:
        return self.wells.filter("loaded").select("identifier", "id_rank")

    @cached_property
    def statistics(self) -> DataFrame:
        return audit.import_statistics(
            self.tagged, self.identifiers, self.wells, self.resolved, self.choices,
            self.depth_filter,
        )

    def status_summary(self) -> DataFrame:
        return self.audit.groupBy("load_status").agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("row_image_loaded")).alias("n_loaded_rows"),
            F.count_if(F.col("well_loaded")).alias("n_well_rows"),
        )
