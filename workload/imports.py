"""Manifest resolution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.functions.depth import DepthFilter
from inkledger.operators import audit, candidates, resolution
from inkledger.operators.manifest import ManifestRoles
from inkledger.plans.manifest_import import ManifestImport
from workload.registry import Tables, query
from workload.views import ctes

DEPTH = DepthFilter("raw_depth", "less_than", 2500.0, include_blank=True)
ROLES = ManifestRoles(
    "raw_identifier", "raw_path", latitude="raw_path", depth="raw_depth",
    log_top_depth="raw_depth",
)


def plan(t: Tables, depth: DepthFilter | None = DEPTH) -> ManifestImport:
    return ManifestImport(t.manifest_v, ROLES, t.catalog_v, t.probe_v, depth_filter=depth)


def network_plan(t: Tables) -> ManifestImport:
    probe = t.network_v.filter("raw_path like '%.tif'").select(
        F.col("raw_path").alias("path"), F.lit(True).alias("path_exists"),
        F.lit(True).alias("readable"),
    ).distinct()
    return ManifestImport(t.network_v, ROLES, t.catalog_v, probe, t.roots_v, DEPTH)


# One statement of the whole import in plain SQL, written row-wise with windows.
_CHAIN = r"""
tagged AS (
  SELECT *, CASE WHEN regexp_full_match(raw_identifier, '[0-9]{1,14}') THEN raw_identifier END AS identifier,
         lower(split_part(raw_path, '/', -1)) AS bn
  FROM manifest_in
), rows_t AS (
  SELECT import_row, raw_identifier, raw_path, raw_depth, identifier, bn,
         CASE WHEN identifier IS NULL THEN 'invalid_identifier'
              WHEN raw_depth = '' THEN NULL
              WHEN try_cast(raw_depth AS DOUBLE) IS NULL THEN 'filtered_invalid_depth'
              WHEN NOT (CAST(raw_depth AS DOUBLE) < 2500) THEN 'filtered_depth' END AS rejected,
         CASE WHEN raw_path = '' THEN 'blank' WHEN lower(raw_path) = 'ihs assoc image' THEN 'placeholder'
              ELSE 'listed' END AS kind
  FROM tagged
), ids AS (
  SELECT identifier, min(CASE WHEN rejected IS NULL THEN import_row END) AS id_rank,
         count(CASE WHEN rejected IS NULL THEN 1 END) AS n_eligible,
         min_by(raw_depth, import_row) FILTER (rejected IS NULL AND raw_depth <> '') AS id_depth,
         min_by(raw_path, import_row) FILTER (rejected IS NULL AND raw_path <> '') AS id_lat
  FROM rows_t WHERE identifier IS NOT NULL GROUP BY identifier
), cat AS (
  SELECT min(folder_seq) AS folder_seq, arg_max(path, folder_seq) AS folder_path,
         lower(split_part(path, '/', -1)) AS bn,
         regexp_extract(lower(split_part(path, '/', -1)), '^[0-9]+') AS lead
  FROM catalog_v GROUP BY 3, 4
), spellings AS (
  SELECT identifier, id_rank, identifier AS lead FROM ids WHERE n_eligible > 0
  UNION ALL
  SELECT identifier, id_rank, identifier || '00' FROM ids WHERE n_eligible > 0 AND length(identifier) = 12
), proto AS (
  SELECT s.identifier, c.bn, 0 AS phase, s.id_rank, c.folder_seq AS seq
  FROM spellings s JOIN cat c USING (lead)
  UNION ALL
  SELECT r.identifier, r.bn, 1, i.id_rank, r.import_row
  FROM rows_t r JOIN ids i USING (identifier) WHERE r.rejected IS NULL AND r.kind = 'listed'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY identifier, bn ORDER BY phase, id_rank, seq) AS k FROM proto
), cand AS (
  SELECT identifier, r.bn, phase, id_rank, seq, c.folder_path,
         first_value(identifier) OVER (PARTITION BY r.bn ORDER BY phase, id_rank, seq, identifier) AS owner
  FROM ranked r LEFT JOIN cat c ON c.bn = r.bn WHERE k = 1
), refs AS (
  SELECT identifier, bn, raw_path, min(import_row) AS first_row, count(*) AS n_rows
  FROM rows_t WHERE rejected IS NULL AND kind = 'listed' GROUP BY ALL
), choices AS (
  SELECT identifier, bn, owner, -1 AS priority, folder_path AS path, 'selected_folder' AS source
  FROM cand WHERE folder_path IS NOT NULL
  UNION ALL
  SELECT r.identifier, r.bn, c.owner, r.first_row, r.raw_path, 'listed_path'
  FROM refs r JOIN cand c ON c.identifier = r.identifier AND c.bn = r.bn
), judged AS (
  SELECT c.*, ROOT_EXPR AS root,
         CASE WHEN ROOT_DEAD THEN 'network_unavailable'
              WHEN NOT regexp_matches(lower(c.path), '[.](tif|tiff|png|jpg|jpeg|bmp|gif)$') THEN 'unsupported_image_path'
              WHEN c.source = 'selected_folder' THEN ''
              WHEN p.path IS NULL OR NOT p.path_exists THEN 'path_missing'
              WHEN NOT p.readable THEN 'unreadable_image' ELSE '' END AS status
  FROM choices c LEFT JOIN probe_in p ON p.path = c.path ROOT_JOIN
), tried AS (
  SELECT identifier, bn,
         arg_min(path, priority) FILTER (status = '') AS resolved_path,
         arg_min(source, priority) FILTER (status = '') AS source,
         arg_max(status, priority) FILTER (status <> '') AS last_failure
  FROM judged WHERE owner = identifier GROUP BY identifier, bn
), resolved AS (
  SELECT c.*, t.resolved_path, t.source,
         CASE WHEN c.owner <> c.identifier THEN 'basename_conflict'
              WHEN t.resolved_path IS NULL THEN t.last_failure END AS failure
  FROM cand c LEFT JOIN tried t ON t.identifier = c.identifier AND t.bn = c.bn
), wells AS (
  SELECT i.identifier, i.id_rank, count(r.resolved_path) AS n_resolved,
         count(r.identifier) - count(r.resolved_path) AS n_failed,
         string_agg(r.resolved_path, '; ' ORDER BY r.phase, r.seq) AS all_paths
  FROM ids i LEFT JOIN resolved r USING (identifier) WHERE i.n_eligible > 0
  GROUP BY i.identifier, i.id_rank
), audit AS (
  SELECT r.import_row, r.raw_identifier, r.raw_path, r.raw_depth, r.identifier, r.rejected, r.kind,
         coalesce(w.n_resolved, 0) > 0 AS well_loaded, coalesce(w.n_resolved, 0) AS n_resolved,
         CASE WHEN r.rejected IS NOT NULL THEN ''
              WHEN r.kind = 'blank' THEN coalesce(w.all_paths, '')
              WHEN r.kind = 'listed' THEN coalesce(c.resolved_path, '') ELSE '' END AS resolved_tif_path,
         CASE WHEN r.rejected IS NOT NULL THEN r.rejected
              WHEN r.kind = 'placeholder' THEN CASE WHEN w.n_resolved > 0 THEN 'placeholder_covered' ELSE 'placeholder_unresolved' END
              WHEN r.kind = 'blank' THEN CASE WHEN w.n_resolved > 0 THEN 'loaded_from_selected_folder' ELSE 'no_path_unresolved' END
              WHEN c.resolved_path IS NOT NULL THEN
                   CASE WHEN c.source = 'selected_folder' THEN 'loaded_from_selected_folder'
                        WHEN c.resolved_path = r.raw_path THEN 'recovered_from_listed_path'
                        ELSE 'duplicate_reference_loaded' END
              ELSE c.failure || CASE WHEN w.n_resolved > 0 THEN '_well_covered' ELSE '_unresolved' END
         END AS load_status,
         CASE WHEN r.rejected IS NOT NULL THEN ''
              WHEN r.kind = 'blank' AND w.n_resolved > 0 THEN 'selected_folder'
              WHEN r.kind = 'listed' THEN coalesce(c.source, '') ELSE '' END AS resolution_source
  FROM rows_t r
  LEFT JOIN wells w ON w.identifier = r.identifier
  LEFT JOIN resolved c ON c.identifier = r.identifier AND c.bn = r.bn AND r.kind = 'listed'
)
"""


def _chain(network: bool) -> str:
    if not network:
        head = ctes("manifest_v", "catalog_v", "probe_v") + (
            ",\nmanifest_in AS (SELECT * FROM manifest_v), probe_in AS (SELECT * FROM probe_v),"
        )
        body = _CHAIN.replace("ROOT_EXPR", "''").replace("ROOT_DEAD", "FALSE").replace("ROOT_JOIN", "")
    else:
        head = ctes("network_v", "catalog_v", "roots_v") + (
            ",\nmanifest_in AS (SELECT * FROM network_v), probe_in AS (SELECT DISTINCT raw_path AS path,"
            " TRUE AS path_exists, TRUE AS readable FROM network_v WHERE raw_path LIKE '%.tif'),"
        )
        root = r"regexp_extract(c.path, '^\\\\[^\\]+\\[^\\]+')"
        body = (
            _CHAIN.replace("ROOT_EXPR", root)
            .replace("ROOT_DEAD", f"{root} <> '' AND NOT coalesce(n.available, FALSE)")
            .replace("ROOT_JOIN", f"LEFT JOIN roots_v n ON n.root = {root}")
            .replace("lower(split_part(raw_path, '/', -1))",
                     r"lower(split_part(replace(raw_path, chr(92), '/'), '/', -1))")
        )
    return "WITH " + head + body


def chain(select: str, network: bool = False) -> str:
    return _chain(network) + select


# --------------------------------------------------------------------- queries

@query(
    "manifest_status_summary",
    chain(
        "SELECT load_status, count(*) AS n_rows, "
        "count(CASE WHEN resolved_tif_path <> '' THEN 1 END) AS n_loaded_rows, "
        "count(CASE WHEN well_loaded THEN 1 END) AS n_well_rows FROM audit GROUP BY load_status"
    ),
)
def manifest_status_summary(t: Tables) -> DataFrame:
    return plan(t).status_summary()


@query(
    "row_numbering",
    "WITH " + ctes("manifest_v") + """
    SELECT raw_identifier, min(import_row) AS first_row, max(import_row) AS last_row, count(*) AS n
    FROM manifest_v GROUP BY raw_identifier""",
)
def row_numbering(t: Tables) -> DataFrame:
    # The view numbers rows by o_orderkey + 2; rows stay in their given order.
    return t.manifest_v.groupBy("raw_identifier").agg(
        F.min("import_row").alias("first_row"), F.max("import_row").alias("last_row"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "eligible_identifiers",
    chain("SELECT identifier, id_rank, n_eligible FROM ids"),
)
def eligible_identifiers(t: Tables) -> DataFrame:
    return plan(t).identifiers.select("identifier", "id_rank", "n_eligible")


@query(
    "folder_match_join",
    chain(
        "SELECT identifier, bn AS basename_key, id_rank, folder_seq FROM spellings JOIN cat USING (lead)"
    ),
)
def folder_match_join(t: Tables) -> DataFrame:
    p = plan(t)
    return candidates.folder_matches(p.identifiers, p.names).select(
        "identifier", "basename_key", "id_rank", "folder_seq"
    )


@query(
    "listed_candidates",
    chain(
        "SELECT identifier, bn AS basename_key, raw_path AS listed_path, first_row, n_rows FROM refs"
    ),
)
def listed_candidates(t: Tables) -> DataFrame:
    return plan(t).references.select(
        "identifier", "basename_key", "listed_path", "first_row", "n_rows"
    )


@query(
    "candidate_union",
    chain("SELECT identifier, bn AS basename_key, phase, id_rank, seq FROM cand"),
)
def candidate_union(t: Tables) -> DataFrame:
    p = plan(t)
    return candidates.candidate_union(p.identifiers, p.references, p.names).select(
        "identifier", "basename_key", "rank.phase", "rank.id_rank", "rank.seq"
    )


@query(
    "folder_lookup_by_basename",
    chain(
        "SELECT identifier, bn AS basename_key, folder_path FROM cand "
        "WHERE phase = 1 AND folder_path IS NOT NULL"
    ),
)
def folder_lookup_by_basename(t: Tables) -> DataFrame:
    return (
        plan(t).candidates.filter("rank.phase = 1 and folder_path is not null")
        .select("identifier", "basename_key", "folder_path")
    )


@query(
    "duplicate_references",
    chain(
        "SELECT identifier, CAST(sum(n_rows) - count(DISTINCT bn) AS BIGINT) AS duplicate_references "
        "FROM refs GROUP BY identifier"
    ),
)
def duplicate_references(t: Tables) -> DataFrame:
    per_candidate = plan(t).references.groupBy("identifier", "basename_key").agg(
        (F.sum("n_rows") - 1).alias("extra")
    )
    return per_candidate.groupBy("identifier").agg(F.sum("extra").alias("duplicate_references"))


@query(
    "basename_conflicts",
    chain("SELECT identifier, bn AS basename_key, owner FROM cand WHERE owner <> identifier"),
)
def basename_conflicts(t: Tables) -> DataFrame:
    return plan(t).candidates.filter("conflict").select("identifier", "basename_key", "owner")


@query(
    "share_availability",
    chain(
        "SELECT root, status = 'network_unavailable' AS dead, count(*) AS n_choices, "
        "count(DISTINCT path) AS n_paths FROM judged WHERE root <> '' GROUP BY ALL",
        network=True,
    ),
)
def share_availability(t: Tables) -> DataFrame:
    choices = network_plan(t).choices.filter("root <> ''")
    per_path = choices.groupBy("root", (~F.col("root_available")).alias("dead"), "path_key").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_path.groupBy("root", "dead").agg(
        F.sum("n").alias("n_choices"), F.count(F.lit(1)).alias("n_paths")
    )


@query(
    "choice_list",
    chain(
        "SELECT identifier, bn AS basename_key, priority, path, source, owner <> identifier AS conflict "
        "FROM choices"
    ),
)
def choice_list(t: Tables) -> DataFrame:
    return plan(t).choices.select(
        "identifier", "basename_key", "priority", "path", "source", "conflict"
    )


@query(
    "first_readable_choice",
    chain(
        "SELECT identifier, bn AS basename_key, resolved_path, source AS resolution_source, "
        "failure AS failure_status FROM resolved"
    ),
)
def first_readable_choice(t: Tables) -> DataFrame:
    return plan(t).resolved.select(
        "identifier", "basename_key", "resolved_path", "resolution_source", "failure_status"
    )


@query(
    "distinct_path_probe",
    chain(
        "SELECT status, count(DISTINCT path) AS n_paths FROM judged WHERE owner = identifier GROUP BY status"
    ),
)
def distinct_path_probe(t: Tables) -> DataFrame:
    judged = plan(t).judged.filter("not conflict")
    return judged.groupBy("path_key").agg(F.min("status").alias("status")).groupBy("status").agg(
        F.count(F.lit(1)).alias("n_paths")
    )


@query(
    "well_loaded",
    chain("SELECT identifier, n_resolved, n_failed, n_resolved > 0 AS loaded FROM wells"),
)
def well_loaded(t: Tables) -> DataFrame:
    return plan(t).wells.select("identifier", "n_resolved", "n_failed", "loaded")


@query(
    "row_status_audit",
    chain(
        "SELECT import_row, raw_identifier AS source_identifier, raw_path AS source_tif_path, "
        "CASE WHEN length(identifier) = 12 THEN identifier || '00' ELSE coalesce(identifier, '') END AS match_identifier, "
        "resolved_tif_path, well_loaded, resolved_tif_path <> '' AS row_image_loaded, load_status, "
        "resolution_source FROM audit"
    ),
)
def row_status_audit(t: Tables) -> DataFrame:
    return plan(t).audit.drop("src", "detail")


@query(
    "network_row_status",
    chain(
        "SELECT load_status, well_loaded, count(*) AS n_rows FROM audit GROUP BY ALL", network=True
    ),
)
def network_row_status(t: Tables) -> DataFrame:
    return network_plan(t).audit.groupBy("load_status", "well_loaded").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query(
    "audit_details",
    chain(
        """SELECT import_row, CASE
             WHEN rejected = 'invalid_identifier' THEN 'Identifier must contain 1 to 14 digits.'
             WHEN rejected = 'filtered_invalid_depth' THEN 'raw_depth is not a numeric depth: ''' || raw_depth || '''.'
             WHEN rejected = 'filtered_depth' THEN 'Depth ' || raw_depth || ' ft does not satisfy < 2500 ft.'
             WHEN kind = 'placeholder' AND well_loaded THEN 'Another TIFF loaded for this identifier.'
             WHEN kind = 'placeholder' THEN 'No TIFF was available for this identifier.'
             WHEN kind = 'blank' AND well_loaded THEN 'Matched ' || n_resolved || ' image(s) by identifier in the selected image collection.'
             WHEN kind = 'blank' THEN 'No TIFF path was supplied or matched.' ELSE '' END AS detail
           FROM audit WHERE rejected IS NOT NULL OR kind <> 'listed'"""
    ),
)
def audit_details(t: Tables) -> DataFrame:
    return plan(t).audit.filter(
        "load_status like 'filtered%' or load_status = 'invalid_identifier' or source_tif_path = '' "
        "or lower(source_tif_path) = 'ihs assoc image'"
    ).select("import_row", "detail")


@query(
    "pathless_row_fill",
    chain(
        "SELECT import_row, resolved_tif_path, load_status FROM audit WHERE kind = 'blank' AND rejected IS NULL"
    ),
)
def pathless_row_fill(t: Tables) -> DataFrame:
    rows = plan(t).audit
    return rows.filter(
        "source_tif_path = '' and load_status in ('loaded_from_selected_folder', 'no_path_unresolved')"
    ).select("import_row", "resolved_tif_path", "load_status")


@query(
    "filtered_row_well_flag",
    chain("SELECT import_row, load_status, well_loaded FROM audit WHERE load_status LIKE 'filtered%'"),
)
def filtered_row_well_flag(t: Tables) -> DataFrame:
    return plan(t).audit.filter("load_status like 'filtered%'").select(
        "import_row", "load_status", "well_loaded"
    )


@query(
    "metadata_fill",
    chain(
        """SELECT r.resolved_path AS path, r.identifier,
             coalesce(s.top, i.id_depth, '') AS log_top_depth, coalesce(s.lat, i.id_lat, '') AS latitude
           FROM resolved r JOIN ids i USING (identifier)
           LEFT JOIN (SELECT identifier, bn, min_by(raw_depth, import_row) FILTER (raw_depth <> '') AS top,
                             min_by(raw_path, import_row) AS lat
                      FROM rows_t WHERE rejected IS NULL AND kind = 'listed' GROUP BY ALL) s
             ON s.identifier = r.identifier AND s.bn = r.bn
           WHERE r.resolved_path IS NOT NULL"""
    ),
)
def metadata_fill(t: Tables) -> DataFrame:
    return plan(t).files.select("path", "identifier", "log_top_depth", "latitude")


@query(
    "ordered_resolved_paths",
    chain(
        "SELECT resolved_path AS path, identifier, id_rank, phase, seq FROM resolved WHERE resolved_path IS NOT NULL"
    ),
)
def ordered_resolved_paths(t: Tables) -> DataFrame:
    return audit.ordered_paths(plan(t).files).select("path", "identifier", "id_rank", "phase", "seq")


_STATS = """SELECT
  (SELECT count(*) FROM rows_t) AS input_rows,
  (SELECT count(*) FROM ids) AS valid_unique_identifiers,
  (SELECT count(DISTINCT raw_identifier) FROM rows_t WHERE identifier IS NULL) AS invalid_unique_identifiers,
  (SELECT count(*) FROM cand) AS unique_tiff_candidates,
  (SELECT count(resolved_path) FROM resolved) AS loaded_tiffs,
  (SELECT count(*) FROM resolved WHERE source = 'selected_folder') AS loaded_from_folder,
  (SELECT count(*) FROM resolved WHERE source = 'listed_path') AS recovered_from_paths,
  (SELECT CAST(sum(n_rows) AS BIGINT) FROM refs) - (SELECT count(DISTINCT (identifier, bn)) FROM refs) AS duplicate_references,
  (SELECT count(*) FROM wells WHERE n_resolved > 0) AS loaded_identifiers,
  (SELECT count(*) FROM wells WHERE n_resolved > 0 AND n_failed > 0) AS partially_loaded_identifiers,
  (SELECT count(*) FROM wells WHERE n_resolved = 0) AS unrecovered_identifiers,
  (SELECT count(*) FROM audit WHERE load_status LIKE 'placeholder%') AS placeholder_rows,
  (SELECT count(*) FROM audit WHERE load_status = 'placeholder_covered') AS placeholder_covered,
  (SELECT count(*) FROM audit WHERE load_status = 'placeholder_unresolved') AS placeholder_unresolved,
  (SELECT count(*) FROM ids WHERE n_eligible > 0) AS eligible_unique_identifiers,
  (SELECT count(*) FROM rows_t WHERE rejected = 'filtered_depth') AS depth_filtered_rows,
  (SELECT count(*) FROM ids WHERE n_eligible = 0) AS depth_filtered_identifiers,
  (SELECT count(*) FROM rows_t WHERE rejected = 'filtered_invalid_depth') AS invalid_depth_rows,
  (SELECT count(DISTINCT root) FROM judged WHERE status = 'network_unavailable') AS unavailable_network_shares,
  (SELECT count(DISTINCT path) FROM judged WHERE status = 'network_unavailable') AS network_paths_skipped,
  'raw_depth < 2500 ft, including blank depths' AS depth_filter_description"""


@query("import_statistics", chain(_STATS))
def import_statistics(t: Tables) -> DataFrame:
    return plan(t).statistics


@query("network_import_statistics", chain(_STATS, network=True))
def network_import_statistics(t: Tables) -> DataFrame:
    return network_plan(t).statistics


@query(
    "identifier_line_list",
    "WITH " + ctes("manifest_v") + """
    SELECT raw_identifier AS value, min(import_row) AS line_no, count(*) AS n_lines,
           regexp_full_match(raw_identifier, '[0-9]{1,14}') AS valid
    FROM manifest_v GROUP BY raw_identifier""",
)
def identifier_line_list(t: Tables) -> DataFrame:
    lines = t.manifest_v.select(F.col("import_row").alias("line_no"), F.col("raw_identifier").alias("value"))
    wanted, _, invalid = audit.line_list(lines)
    bad = invalid.groupBy("value").agg(
        F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n_lines")
    )
    return wanted.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


@query(
    "identifier_line_counts",
    "WITH " + ctes("manifest_v") + """
    SELECT count(DISTINCT raw_identifier) AS n_identifiers,
           count(*) - count(DISTINCT raw_identifier) AS n_duplicates
    FROM manifest_v WHERE regexp_full_match(raw_identifier, '[0-9]{1,14}')""",
)
def identifier_line_counts(t: Tables) -> DataFrame:
    lines = t.manifest_v.select(F.col("import_row").alias("line_no"), F.col("raw_identifier").alias("value"))
    return audit.line_list(lines)[1]
