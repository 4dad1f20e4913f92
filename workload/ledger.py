"""Review ledger queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.functions import state
from inkledger.functions import text as tx
from inkledger.operators import commits as cm
from inkledger.operators import labels, ledger, subsets
from workload.registry import Tables, query
from workload.views import ctes


def duck_split(cell: str) -> str:
    kept = f"list_filter(list_transform(string_split(coalesce({cell}, ''), ','), lambda v: trim(v)), lambda v: v <> '')"
    keys = f"list_transform({kept}, lambda w: lower(w))"
    return f"list_filter({kept}, lambda v, i: list_position({keys}, lower(v)) = i)"


def duck_join(cell: str) -> str:
    return f"array_to_string({duck_split(cell)}, ', ')"


DUCK_BOOL = """CASE WHEN lower(trim(has_stamp_raw)) IN ('true', 'yes', 'y', '1', 't') THEN TRUE
                    WHEN lower(trim(has_stamp_raw)) IN ('false', 'no', 'n', '0', 'f') THEN FALSE END"""

RAW = f"""raw_v AS (
  SELECT commit_id, file_name, lower(file_name) AS file_key, {DUCK_BOOL} AS has_stamp, has_stamp_raw,
         trim(stamp_types_raw) AS stamp_type, strftime(reviewed_at, '%Y-%m-%d %H:%M:%S') AS reviewed_at,
         reviewed_by, regexp_extract(file_name, '[0-9]+') AS log_api, reviewed_at AS ts, stamp_types_raw
  FROM commits_v
)"""
LEDGER = f"""ledger_v AS (
  SELECT *, commit_id AS position, len({duck_split('stamp_type')}) AS n_types
  FROM raw_v WHERE commit_id IN (SELECT max(commit_id) FROM raw_v GROUP BY file_key)
), state_v AS (
  SELECT *, (has_stamp IS FALSE OR (has_stamp IS TRUE AND n_types > 0)) IS TRUE AS reviewed,
         has_stamp IS NOT NULL OR stamp_type <> '' AS has_entry
  FROM ledger_v
)"""


def sql(select: str) -> str:
    return "WITH " + ctes("commits_v") + ", " + RAW + ", " + LEDGER + " " + select


def raw_rows(t: Tables) -> DataFrame:
    """The commits as rows of an old review table."""
    return t.commits_v.select(
        F.col("file_name").alias("FILE_LINK"),
        F.col("has_stamp_raw").alias("Has_Stamp"),
        F.col("stamp_types_raw").alias("type_of_stamp"),
        F.date_format("reviewed_at", "yyyy-MM-dd HH:mm:ss").alias("reviewed_at"),
        "reviewed_by",
        F.regexp_extract("file_name", "[0-9]+", 0).alias("api14"),
        F.col("commit_id").alias("position"),
    )


def ledger_of(t: Tables) -> DataFrame:
    return ledger.conform(raw_rows(t))


def drafts_of(t: Tables) -> DataFrame:
    return t.commits_v.select(
        "commit_id", "file_name",
        tx.parse_bool("has_stamp_raw").alias("has_stamp"),
        F.transform(F.split("stamp_types_raw", ","), tx.strip).alias("stamp_types"),
        F.array().cast("array<string>").alias("log_types"),
        F.lit("").alias("notes"), "reviewed_at", "reviewed_by",
    )


# ------------------------------------------------------------ scalar functions

@query(
    "split_and_join_values",
    "WITH " + ctes("commits_v") + f" SELECT commit_id, {duck_join('stamp_types_raw')} AS types, "
    f"CAST(len({duck_split('stamp_types_raw')}) AS INTEGER) AS n_types FROM commits_v",
)
def split_and_join_values(t: Tables) -> DataFrame:
    values = tx.split_values("stamp_types_raw")
    return t.commits_v.select(
        "commit_id", F.array_join(values, ", ").alias("types"), F.size(values).alias("n_types")
    )


@query("parse_bool", "WITH " + ctes("commits_v") + f" SELECT commit_id, {DUCK_BOOL} AS has_stamp FROM commits_v")
def parse_bool(t: Tables) -> DataFrame:
    return t.commits_v.select("commit_id", tx.parse_bool("has_stamp_raw").alias("has_stamp"))


@query(
    "record_state",
    sql("""SELECT file_key, reviewed, has_entry, has_entry AND NOT reviewed AS incomplete,
           CASE WHEN NOT has_entry THEN 'todo' WHEN reviewed THEN 'done' ELSE 'warn' END AS tag FROM state_v"""),
)
def record_state(t: Tables) -> DataFrame:
    cells = (F.col("has_stamp"), F.col("stamp_type"), F.col("log_types"), F.col("notes"))
    return ledger.with_state(ledger_of(t)).select(
        "file_key", "reviewed", "has_entry", "incomplete", state.tag(*cells).alias("tag")
    )


@query(
    "review_list_rows",
    sql("""SELECT file_key, file_name, '' AS log_top_depth, '' AS log_bottom_depth, '' AS notes,
           CASE WHEN NOT has_entry THEN '' WHEN reviewed THEN 'check' ELSE 'warn' END AS mark,
           CASE WHEN has_entry AND has_stamp THEN 'yes' WHEN has_entry AND NOT has_stamp THEN 'no' ELSE '' END AS stamp,
           CASE WHEN has_entry THEN stamp_type ELSE '' END AS stamp_type,
           CASE WHEN NOT has_entry THEN 'todo' WHEN reviewed THEN 'done' ELSE 'warn' END AS tag FROM state_v"""),
)
def review_list_rows(t: Tables) -> DataFrame:
    return ledger.list_rows(ledger_of(t))


@query(
    "set_verdict",
    sql(f"""SELECT commit_id, CASE WHEN has_stamp THEN {duck_join('stamp_types_raw')} ELSE '' END AS stamp_type,
            CASE WHEN has_stamp IS NULL THEN '' ELSE reviewed_at END AS reviewed_at FROM raw_v"""),
)
def set_verdict(t: Tables) -> DataFrame:
    rows = t.commits_v.withColumn("has_stamp", tx.parse_bool("has_stamp_raw"))
    return rows.select(
        "commit_id",
        state.verdict_types(F.col("has_stamp"), F.col("stamp_types_raw")).alias("stamp_type"),
        F.when(F.col("has_stamp").isNull(), F.lit("")).otherwise(
            F.date_format("reviewed_at", "yyyy-MM-dd HH:mm:ss")
        ).alias("reviewed_at"),
    )


_DRAFTS = f"""drafts_v AS (
  SELECT *, list_transform(string_split(stamp_types_raw, ','), lambda v: trim(v)) AS vals FROM raw_v
), valid_v AS (
  SELECT *, has_stamp IS NOT TRUE OR (NOT list_contains(vals, '')
            AND len(list_distinct(list_transform(vals, lambda v: lower(v)))) = len(vals)) AS valid FROM drafts_v
)"""


@query("draft_validity", sql("SELECT 1").replace(" SELECT 1", ", " + _DRAFTS + " SELECT commit_id, valid FROM valid_v"))
def draft_validity(t: Tables) -> DataFrame:
    return drafts_of(t).select(
        "commit_id", state.draft_valid(F.col("has_stamp"), F.col("stamp_types")).alias("valid")
    )


# ------------------------------------------------------------------ load, check

@query(
    "review_table_load",
    sql("""SELECT file_key, file_name, log_api, has_stamp, stamp_type, reviewed_at, reviewed_by,
           '' AS log_types, '' AS notes, '' AS file_path FROM ledger_v"""),
)
def review_table_load(t: Tables) -> DataFrame:
    return ledger_of(t).select(
        "file_key", "file_name", "log_api", "has_stamp", "stamp_type", "reviewed_at", "reviewed_by",
        "log_types", "notes", "file_path",
    )


_ISSUES = """issues_v AS (
  SELECT commit_id AS row_number, '2_duplicate' AS rule,
         'Duplicate file name at row ' || commit_id || ': ' || file_name AS message
  FROM (SELECT *, row_number() OVER (PARTITION BY file_key ORDER BY commit_id) AS k FROM raw_v) WHERE k > 1
  UNION ALL
  SELECT commit_id, '3_verdict', 'Row ' || commit_id || ' has an invalid has_stamp value: ''' || has_stamp_raw || ''''
  FROM raw_v WHERE has_stamp_raw <> '' AND has_stamp IS NULL
  UNION ALL
  SELECT commit_id, '4_no_with_type', 'Row ' || commit_id || ' says no stamp but also supplies a stamp type.'
  FROM raw_v WHERE has_stamp IS FALSE AND stamp_type <> ''
)"""


def issue_sql(select: str) -> str:
    return sql("SELECT 1").replace(" SELECT 1", ", " + _ISSUES + " " + select)


def raw_for_check(t: Tables) -> DataFrame:
    return t.commits_v.select(
        F.col("commit_id").alias("row_number"), F.col("file_name").alias("file_link"),
        F.col("has_stamp_raw").alias("has_stamp"), F.col("stamp_types_raw").alias("type_of_stamp"),
    )


@query("review_validation", issue_sql("SELECT * FROM issues_v"))
def review_validation(t: Tables) -> DataFrame:
    return ledger.row_issues(raw_for_check(t))


@query(
    "review_first_issues",
    issue_sql("SELECT * FROM issues_v ORDER BY row_number, rule LIMIT 12"),
)
def review_first_issues(t: Tables) -> DataFrame:
    return ledger.first_issues(ledger.row_issues(raw_for_check(t)))


@query(
    "reconcile_names",
    sql("""SELECT CASE WHEN l.k IS NULL THEN 'missing' ELSE 'extra' END AS kind, coalesce(c.name, l.name) AS name
           FROM (SELECT 'log_' || c_custkey || '.tif' AS name, 'log_' || c_custkey || '.tif' AS k FROM customer) c
           FULL JOIN (SELECT file_key AS k, file_name AS name FROM ledger_v) l ON l.k = c.k
           WHERE l.k IS NULL OR c.k IS NULL"""),
)
def reconcile_names(t: Tables) -> DataFrame:
    folder = t.customer.select(F.concat(F.lit("log_"), F.col("c_custkey"), F.lit(".tif")).alias("name"))
    return ledger.reconcile(ledger_of(t).select(F.col("file_name").alias("name")), folder)


@query(
    "remove_rows",
    sql("""SELECT file_key, file_key IN (SELECT 'log_' || s_suppkey || '.tif' FROM supplier) AS removed FROM ledger_v"""),
)
def remove_rows(t: Tables) -> DataFrame:
    names = t.supplier.select(F.concat(F.lit("LOG_"), F.col("s_suppkey"), F.lit(".TIF")).alias("name"))
    kept, removed = ledger.remove_rows(ledger_of(t), names)
    return kept.select("file_key", F.lit(False).alias("removed")).unionByName(
        removed.select("file_key", F.lit(True).alias("removed"))
    )


@query(
    "keep_extras_order",
    sql("""SELECT file_key, CASE WHEN p.k IS NULL THEN 1 ELSE 0 END AS save_phase,
           coalesce(p.pos, position) AS save_position
           FROM ledger_v LEFT JOIN (SELECT 'log_' || p_partkey || '.tif' AS k, p_partkey AS pos FROM part) p ON p.k = file_key"""),
)
def keep_extras_order(t: Tables) -> DataFrame:
    order = t.part.select(
        F.concat(F.lit("log_"), F.col("p_partkey"), F.lit(".tif")).alias("name"),
        F.col("p_partkey").alias("position"),
    )
    return ledger.keep_extras(ledger_of(t), order).select("file_key", "save_phase", "save_position")


@query(
    "merge_files",
    sql("""SELECT coalesce(l.file_key, c.k) AS file_key, coalesce(c.name, l.file_name) AS file_name,
           coalesce(c.path, '') AS file_path,
           CASE WHEN c.k IS NOT NULL AND c.from_manifest THEN c.ident
                ELSE coalesce(nullif(l.log_api, ''), c.ident, '') END AS log_api,
           l.has_stamp, coalesce(l.stamp_type, '') AS stamp_type, coalesce(c.top, '') AS log_top_depth
           FROM ledger_v l FULL JOIN (
             SELECT 'log_' || c_custkey || '.tif' AS k, 'log_' || c_custkey || '.tif' AS name,
                    '/new/log_' || c_custkey || '.tif' AS path, 'M' || c_custkey AS ident,
                    c_custkey % 3 = 0 AS from_manifest,
                    CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS STRING) ELSE '' END AS top
             FROM customer) c ON c.k = l.file_key"""),
)
def merge_files(t: Tables) -> DataFrame:
    files = t.customer.select(
        F.concat(F.lit("/new/log_"), F.col("c_custkey"), F.lit(".tif")).alias("path"),
        F.concat(F.lit("M"), F.col("c_custkey")).alias("identifier"),
        (F.col("c_custkey") % 3 == 0).alias("from_manifest"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise("").alias("log_top_depth"),
    )
    return ledger.merge_files(ledger_of(t), files).select(
        "file_key", "file_name", "file_path", "log_api", "has_stamp", "stamp_type", "log_top_depth"
    )


# --------------------------------------------------------------------- progress

_COUNTS = """SELECT count(CASE WHEN reviewed THEN 1 END) AS n_reviewed, count(CASE WHEN has_stamp THEN 1 END) AS n_with_stamp,
             count(CASE WHEN has_entry AND NOT reviewed THEN 1 END) AS n_incomplete FROM state_v"""


@query("progress_counts", sql(_COUNTS))
def progress_counts(t: Tables) -> DataFrame:
    return ledger.progress(ledger_of(t))


@query("progress_counts_in_scope", sql(_COUNTS + " WHERE file_key IN (SELECT 'log_' || s_suppkey || '.tif' FROM supplier)"))
def progress_counts_in_scope(t: Tables) -> DataFrame:
    names = t.supplier.select(F.concat(F.lit("LOG_"), F.col("s_suppkey"), F.lit(".tif")).alias("name"))
    return ledger.progress(ledger_of(t), names)


@query(
    "status_filter",
    sql("""SELECT 'todo' AS mode, file_key FROM state_v WHERE NOT reviewed
           UNION ALL SELECT 'done', file_key FROM state_v WHERE reviewed
           UNION ALL SELECT 'all', file_key FROM state_v"""),
)
def status_filter(t: Tables) -> DataFrame:
    rows = ledger_of(t)
    parts = [
        ledger.status_filter(rows, mode).select(F.lit(mode).alias("mode"), "file_key")
        for mode in ("todo", "done", "all")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "next_unreviewed",
    sql("""SELECT 'first' AS kind, min(position) AS position FROM state_v WHERE NOT reviewed
           UNION ALL SELECT 'cyclic', coalesce(min(CASE WHEN position > 9900 THEN position END), min(position))
           FROM state_v WHERE NOT reviewed"""),
)
def next_unreviewed(t: Tables) -> DataFrame:
    rows = ledger_of(t)
    return ledger.next_unreviewed(rows).select(F.lit("first").alias("kind"), "position").unionByName(
        ledger.next_unreviewed(rows, 9900).select(F.lit("cyclic").alias("kind"), "position")
    )


@query(
    "most_recent_reviewer",
    sql("SELECT reviewed_by FROM ledger_v WHERE reviewed_by <> '' ORDER BY reviewed_at DESC, position LIMIT 1"),
)
def most_recent_reviewer(t: Tables) -> DataFrame:
    return ledger.most_recent_reviewer(ledger_of(t))


# ------------------------------------------------------------------------ labels

_USED = f"""used_v AS (
  SELECT lower(label) AS label_key, arg_min(label, (position, nth)) AS label
  FROM (SELECT position, unnest({duck_split('stamp_type')}) AS label,
               generate_subscripts({duck_split('stamp_type')}, 1) AS nth FROM ledger_v) GROUP BY 1
)"""


def used_sql(select: str) -> str:
    return sql("SELECT 1").replace(" SELECT 1", ", " + _USED + " " + select)


@query("types_in_use", used_sql("SELECT label_key, label FROM used_v"))
def types_in_use(t: Tables) -> DataFrame:
    return labels.labels_in_use(ledger_of(t)).select("label_key", "label")


def _offered(t: Tables) -> DataFrame:
    return t.region.select(
        F.col("r_regionkey").cast("long").alias("position"),
        F.when(F.col("r_regionkey") == 1, "ihs").otherwise(F.col("r_name")).alias("label"),
    )


_OFFERED = "(SELECT CAST(r_regionkey AS BIGINT) AS position, CASE WHEN r_regionkey = 1 THEN 'ihs' ELSE r_name END AS label FROM region)"


@query(
    "catalog_merge",
    used_sql(f"""SELECT 0 AS phase, position, label FROM {_OFFERED}
                 UNION ALL SELECT 1, row_number() OVER (ORDER BY label_key) - 1, label FROM used_v
                 WHERE label_key NOT IN (SELECT lower(label) FROM {_OFFERED})"""),
)
def catalog_merge(t: Tables) -> DataFrame:
    return labels.merge_catalog(_offered(t), labels.labels_in_use(ledger_of(t)))


_REPLACED = f"""replaced_v AS (
  SELECT *, list_contains(list_transform({duck_split('stamp_type')}, lambda v: lower(v)), 'twdb') AS changed,
         list_filter(list_transform({duck_split('stamp_type')}, lambda v: CASE WHEN lower(v) = 'twdb' THEN 'IHS' ELSE v END), lambda v: TRUE) AS vals
  FROM state_v
), merged_v AS (
  SELECT *, array_to_string(list_filter(vals, lambda v, i: list_position(list_transform(vals, lambda w: lower(w)), lower(v)) = i), ', ') AS new_type
  FROM replaced_v
)"""


def replaced_sql(select: str) -> str:
    return sql("SELECT 1").replace(" SELECT 1", ", " + _REPLACED + " " + select)


@query(
    "replace_type",
    replaced_sql("""SELECT file_key, CASE WHEN changed THEN new_type ELSE stamp_type END AS stamp_type, changed,
                    CASE WHEN changed THEN 'editor' ELSE reviewed_by END AS reviewed_by FROM merged_v"""),
)
def replace_type(t: Tables) -> DataFrame:
    return labels.replace_label(ledger_of(t), "TWDB", "IHS", F.lit("2030-01-01 00:00:00"), "editor").select(
        "file_key", "stamp_type", "changed", "reviewed_by"
    )


@query(
    "remove_type_counts",
    sql(f"""SELECT count(*) AS n_changed, count(CASE WHEN reviewed AND has_stamp IS TRUE AND n_types = 1 THEN 1 END) AS n_made_incomplete
            FROM state_v WHERE list_contains(list_transform({duck_split('stamp_type')}, lambda v: lower(v)), 'twdb')"""),
)
def remove_type_counts(t: Tables) -> DataFrame:
    return labels.change_counts(labels.replace_label(ledger_of(t), "twdb"))


@query(
    "catalog_rename",
    f"""SELECT min(position) AS position, arg_min(label, position) AS label FROM (
          SELECT position, CASE WHEN label = 'ASIA' THEN 'EUROPE' ELSE label END AS label FROM {_OFFERED})
        GROUP BY lower(label)""",
)
def catalog_rename(t: Tables) -> DataFrame:
    return labels.rename_in_catalog(_offered(t), "asia", "europe")


@query(
    "label_catalog_load",
    "WITH " + ctes("commits_v") + f""", cells AS (
          SELECT commit_id AS position, unnest({duck_split('stamp_types_raw')}) AS label,
                 generate_subscripts({duck_split('stamp_types_raw')}, 1) - 1 AS nth FROM commits_v)
        SELECT lower(label) AS label_key, arg_min(label, (position, nth)) AS label, min(position) AS position
        FROM cells GROUP BY 1""",
)
def label_catalog_load(t: Tables) -> DataFrame:
    cells = t.commits_v.select(
        F.col("commit_id").alias("position"),
        F.posexplode(tx.split_values("stamp_types_raw")).alias("at", "label"),
    )
    return labels.distinct_labels(cells, ["position", "at"]).select("label_key", "label", "position")


# ----------------------------------------------------------------------- commits

_EDITS = _DRAFTS + """, effective_v AS (
  SELECT * FROM (
    SELECT *, lag(state) OVER (PARTITION BY file_key ORDER BY ts, commit_id) AS before FROM (
      SELECT *, coalesce(CAST(has_stamp AS STRING), '~') || '|' || CASE WHEN has_stamp THEN array_to_string(vals, ', ') ELSE '' END AS state
      FROM valid_v WHERE valid AND reviewed_by <> ''))
  WHERE state <> coalesce(before, '~|')
), edits_v AS (
  SELECT * FROM effective_v WHERE commit_id IN (
    SELECT arg_max(commit_id, (ts, commit_id)) FROM effective_v GROUP BY file_key)
)"""


def edits_sql(select: str) -> str:
    return sql("SELECT 1").replace(" SELECT 1", ", " + _EDITS + " " + select)


_EDIT_ROWS = """SELECT file_key, file_name, has_stamp, CASE WHEN has_stamp THEN array_to_string(vals, ', ') ELSE '' END AS stamp_type,
                commit_id, reviewed_by FROM edits_v"""


@query("commit_upsert", edits_sql(_EDIT_ROWS))
def commit_upsert(t: Tables) -> DataFrame:
    return cm.latest_edits(drafts_of(t)).select(
        "file_key", "file_name", "has_stamp", "stamp_type", "commit_id", "reviewed_by"
    )


# ----------------------------------------------------------------------- subsets

@query(
    "subset_define",
    "WITH " + ctes("manifest_v") + """
    SELECT raw_identifier AS identifier, min(import_row) AS position,
           regexp_full_match(raw_identifier, '[0-9]{1,14}') AS accepted FROM manifest_v GROUP BY raw_identifier""",
)
def subset_define(t: Tables) -> DataFrame:
    rows = t.manifest_v.select(F.col("import_row").alias("position"), F.col("raw_identifier").alias("value"))
    members, rejected = subsets.define(rows)
    bad = rejected.groupBy("identifier").agg(F.min("position").alias("position"))
    return members.select("identifier", "position", F.lit(True).alias("accepted")).unionByName(
        bad.select("identifier", "position", F.lit(False).alias("accepted"))
    )


@query(
    "subset_scope",
    sql("""SELECT file_key, log_api, position FROM ledger_v WHERE log_api IN (SELECT CAST(s_suppkey AS STRING) FROM supplier)"""),
)
def subset_scope(t: Tables) -> DataFrame:
    members = t.supplier.select(F.col("s_suppkey").cast("string").alias("identifier"))
    return subsets.scope(ledger_of(t), members).select("file_key", "log_api", "position")


@query(
    "subset_scope_of_files",
    "WITH " + ctes("catalog_v") + """
    SELECT path, lead AS identifier FROM (
      SELECT DISTINCT path, regexp_extract(split_part(path, '/', -1), '^[0-9]+') AS lead FROM catalog_v)
    WHERE length(lead) = 14 AND lead IN (SELECT '4444444444' || lpad(CAST(c_custkey AS STRING), 2, '4') || '00' FROM customer)""",
)
def subset_scope_of_files(t: Tables) -> DataFrame:
    members = t.customer.select(
        F.concat(F.lit("4444444444"), F.lpad(F.col("c_custkey").cast("string"), 2, "4"), F.lit("00")).alias("identifier")
    )
    return subsets.scope(ledger_of(t), members, t.catalog_v.select("path").distinct()).select("path", "identifier")


@query(
    "subset_mirror_read",
    sql("""SELECT 'issue' AS kind, 'Subset row ' || commit_id || ' duplicates file name ''' || file_name || '''.' AS item, commit_id AS row_number
           FROM (SELECT *, row_number() OVER (PARTITION BY file_key ORDER BY commit_id) AS k FROM raw_v) WHERE k > 1
           UNION ALL SELECT 'member', log_api, min(commit_id) FROM raw_v GROUP BY log_api"""),
)
def subset_mirror_read(t: Tables) -> DataFrame:
    rows = raw_rows(t).select(
        F.col("position").alias("row_number"), F.col("api14").alias("log_api"), F.col("FILE_LINK").alias("file_link")
    )
    return subsets.mirror_issues(rows).select(
        F.lit("issue").alias("kind"), F.col("message").alias("item"), "row_number"
    ).unionByName(
        subsets.mirror_members(rows).select(
            F.lit("member").alias("kind"), F.col("identifier").alias("item"), F.col("position").alias("row_number")
        )
    )


@query(
    "subset_legacy_read",
    """WITH r AS (SELECT c_custkey AS row_number, c_custkey % 1000 - 1 AS position, 'W' AS w,
                         CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE CAST(c_custkey % 900 AS STRING) END AS api FROM customer),
       v AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY row_number) AS kp,
                       row_number() OVER (PARTITION BY api ORDER BY row_number) AS ka FROM r)
       SELECT row_number, 'Subset row ' || row_number || ' has a duplicate or invalid position.' AS message FROM v WHERE position < 1 OR kp > 1
       UNION ALL
       SELECT row_number, 'Subset row ' || row_number || ' must contain a unique 1-14 digit log_api.' FROM v WHERE api = 'x' OR ka > 1""",
)
def subset_legacy_read(t: Tables) -> DataFrame:
    rows = t.customer.select(
        F.col("c_custkey").alias("row_number"), (F.col("c_custkey") % 1000 - 1).alias("position"),
        F.when(F.col("c_custkey") % 7 == 0, "x").otherwise((F.col("c_custkey") % 900).cast("string")).alias("log_api"),
    )
    return subsets.legacy_issues(rows)
