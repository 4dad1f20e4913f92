"""Domain views over the shared tables, as SQL both engines accept.

``TABLES`` in braces are replaced by a parquet path for Spark and left as view names
for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

MANIFEST = """
SELECT o_orderkey + 2 AS import_row,
       raw_identifier,
       CASE WHEN o_orderpriority LIKE '5%' THEN 'IHS ASSOC IMAGE'
            WHEN o_orderpriority LIKE '4%' THEN ''
            WHEN o_orderkey % 29 = 0 THEN '/scans/v0/shared.tif'
            WHEN o_orderkey % 31 = 0 THEN '/scans/v0/notes.pdf'
            ELSE '/scans/v' || CAST(o_orderkey % 3 AS STRING) || '/' || raw_identifier || '_'
                 || CAST(o_orderkey % 4 AS STRING) || '.tif' END AS raw_path,
       CASE WHEN o_orderkey % 11 = 0 THEN ''
            WHEN o_orderkey % 13 = 0 THEN 'unknown'
            ELSE CAST(CAST(floor(o_totalprice / 100) AS BIGINT) AS STRING) END AS raw_depth
FROM (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice,
             CASE WHEN o_orderkey % 97 = 0 THEN 'ABC' || CAST(o_custkey AS STRING)
                  WHEN o_custkey % 10 = 3 THEN lpad(CAST(o_custkey AS STRING), 12, '4')
                  ELSE CAST(o_custkey AS STRING) END AS raw_identifier
      FROM {orders}) t
"""

CATALOG = """
SELECT c_custkey AS folder_seq,
       '/folder/' || CASE WHEN c_custkey % 10 = 3 THEN lpad(CAST(c_custkey AS STRING), 12, '4') || '00'
                          ELSE CAST(c_custkey AS STRING) END || '_0.TIF' AS path
FROM {customer} WHERE c_custkey % 4 IN (1, 3)
"""

PROBE = """
SELECT raw_path AS path, min(import_row) % 5 <> 0 AS path_exists, min(import_row) % 7 <> 0 AS readable
FROM {manifest_v} WHERE raw_path LIKE '%.tif' GROUP BY raw_path
"""

# Network form of the manifest: three shares, one of them dead, one unknown.
NETWORK = """
SELECT import_row, raw_identifier,
       CASE WHEN raw_path LIKE '/scans/v%' THEN replace('//server/share' || substr(raw_path, 9, 1)
                 || substr(raw_path, 10), '/', chr(92)) ELSE raw_path END AS raw_path,
       raw_depth
FROM {manifest_v}
"""

ROOTS = r"""
SELECT '\\server\share0' AS root, TRUE AS available, '' AS detail
UNION ALL SELECT '\\server\share1', FALSE, 'share is off line'
"""

COMMITS = """
SELECT event_id AS commit_id,
       CASE WHEN event_id % 2 = 0 THEN 'log_' || CAST(user_id AS STRING) || '.tif'
            ELSE 'LOG_' || CAST(user_id AS STRING) || '.TIF' END AS file_name,
       CASE event_type WHEN 'click' THEN 'yes' WHEN 'view' THEN 'NO' WHEN 'purchase' THEN '1' ELSE '' END AS has_stamp_raw,
       CASE event_id % 4 WHEN 0 THEN 'IHS, TWDB, ihs' WHEN 1 THEN 'twdb' WHEN 2 THEN '' ELSE ' Riley ,IHS' END AS stamp_types_raw,
       ts AS reviewed_at,
       CASE WHEN event_id % 9 = 0 THEN '' ELSE 'R' || CAST(event_id % 5 AS STRING) END AS reviewed_by
FROM {events}
"""

DETECTIONS = """
SELECT event_id AS det_id, user_id AS page_id,
       least(CAST(1 AS DOUBLE), value / 100) AS ring,
       CAST(event_id % 101 AS DOUBLE) / 100 AS contrast,
       CAST(event_id % 37 AS DOUBLE) / 36 AS outside, CAST(event_id % 53 AS DOUBLE) / 52 AS dial
FROM {events}
"""

SIGNATURE_SPARK = """
SELECT vec_id, bin, CAST(v AS DOUBLE) AS v
FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS bin, v
"""
SIGNATURE_DUCK = """
SELECT vec_id, CAST(bin - 1 AS INTEGER) AS bin, CAST(embedding[bin] AS DOUBLE) AS v
FROM embeddings, range(1, 65) r(bin)
"""
INK_SPARK = """
SELECT vec_id AS page_id, CAST(bin div 8 AS INT) AS y, CAST(bin % 8 AS INT) AS x
FROM {signature_v} WHERE v > 0
"""
INK_DUCK = """
SELECT vec_id AS page_id, CAST(bin // 8 AS INTEGER) AS y, CAST(bin % 8 AS INTEGER) AS x
FROM signature_v WHERE v > 0
"""

_SPARK = {
    "manifest_v": MANIFEST, "catalog_v": CATALOG, "probe_v": PROBE, "network_v": NETWORK,
    "roots_v": ROOTS, "commits_v": COMMITS, "detections_v": DETECTIONS,
    "signature_v": SIGNATURE_SPARK, "ink_v": INK_SPARK,
}
_DUCK = {**_SPARK, "signature_v": SIGNATURE_DUCK, "ink_v": INK_DUCK}
_NEEDS = {"probe_v": ["manifest_v"], "network_v": ["manifest_v"], "ink_v": ["signature_v"]}


def _spark_body(name: str, sf_dir: str) -> str:
    if name in TABLES:
        return f"parquet.`{sf_dir}/{name}.parquet`"
    body = _SPARK[name]
    for other in [*TABLES, *_NEEDS.get(name, [])]:
        if "{" + other + "}" in body:
            inner = _spark_body(other, sf_dir)
            inner = inner if other in TABLES else f"({inner})"
            body = body.replace("{" + other + "}", inner)
    return body


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table or a domain view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    body = _spark_body(name, sf_dir)
    if name == "roots_v":
        body = body.replace("\\", "\\\\")
    return spark.sql(body)


def ctes(*names: str) -> str:
    """``name AS (...)`` list, dependencies first, for a WITH clause."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in ordered:
        body = _DUCK[name]
        for other in [*TABLES, *_SPARK]:
            body = body.replace("{" + other + "}", other)
        parts.append(f"{name} AS ({body.strip()})")
    return ",\n".join(parts)
