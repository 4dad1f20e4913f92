"""Scalar function queries over file-like text, units and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.functions import geometry as geo
from inkledger.functions import identity, scoring
from inkledger.functions import text as tx
from inkledger.functions.depth import DepthFilter, depth_value
from workload.registry import Tables, query
from workload.views import ctes

MANIFEST = "WITH " + ctes("manifest_v") + " "


@query(
    "header_key",
    "SELECT DISTINCT source, regexp_replace(lower(trim(source)), '[^a-z0-9]', '', 'g') AS header_key FROM documents",
)
def header_key(t: Tables) -> DataFrame:
    return t.documents.select("source", tx.header_key("source").alias("header_key")).distinct()


@query(
    "normalize_identifier",
    MANIFEST + """SELECT import_row, CASE WHEN ok THEN raw_identifier END AS identifier,
      CASE WHEN NOT ok THEN '' WHEN length(raw_identifier) = 12 THEN raw_identifier || '00' ELSE raw_identifier END AS match_identifier,
      CASE WHEN NOT ok THEN 0 WHEN length(raw_identifier) = 12 THEN 2 ELSE 1 END AS n_variants, ok AS valid
      FROM (SELECT *, regexp_full_match(raw_identifier, '[0-9]{1,14}') AS ok FROM manifest_v)""",
)
def normalize_identifier(t: Tables) -> DataFrame:
    rows = t.manifest_v.withColumn("identifier", tx.identifier("raw_identifier"))
    return rows.select(
        "import_row", "identifier", tx.match_identifier("identifier").alias("match_identifier"),
        F.when(F.col("identifier").isNull(), 0).otherwise(F.size(tx.identifier_variants("identifier"))).alias("n_variants"),
        tx.is_identifier("raw_identifier").alias("valid"),
    )


@query(
    "api_from_name",
    "WITH " + ctes("catalog_v", "manifest_v") + """, p AS (
      SELECT path FROM catalog_v UNION ALL SELECT replace(raw_path, '_', '00_') FROM manifest_v)
      SELECT path, regexp_extract(split_part(path, '/', -1), '([0-9]{14})', 1) AS api14,
             CASE WHEN regexp_matches(split_part(path, '/', -1), '^[0-9]{14}([^0-9]|$)') THEN substr(split_part(path, '/', -1), 1, 14) ELSE '' END AS leading_api
      FROM p""",
)
def api_from_name(t: Tables) -> DataFrame:
    paths = t.catalog_v.select("path").unionByName(
        t.manifest_v.select(F.replace("raw_path", F.lit("_"), F.lit("00_")).alias("path"))
    )
    return paths.select("path", tx.api14("path").alias("api14"), tx.leading_api("path").alias("leading_api"))


@query(
    "name_matches_identifier",
    MANIFEST + """SELECT import_row, regexp_full_match(raw_identifier, '[0-9]{1,14}')
      AND starts_with(split_part(raw_path, '/', -1), raw_identifier)
      AND NOT regexp_matches(substr(split_part(raw_path, '/', -1), length(raw_identifier) + 1, 1), '[0-9]') AS matches FROM manifest_v""",
)
def name_matches_identifier(t: Tables) -> DataFrame:
    variants = tx.identifier_variants(tx.identifier("raw_identifier"))
    return t.manifest_v.select(
        "import_row",
        F.coalesce(tx.name_matches_identifier("raw_path", variants), F.lit(False)).alias("matches"),
    )


@query(
    "share_root",
    "WITH " + ctes("network_v") + r""" SELECT import_row, regexp_extract(raw_path, '^\\\\[^\\]+\\[^\\]+') AS root FROM network_v""",
)
def share_root(t: Tables) -> DataFrame:
    return t.network_v.select("import_row", tx.share_root("raw_path").alias("root"))


@query(
    "basename_and_extension",
    """SELECT page_id, lower(split_part(url, '/', -1)) AS basename_key,
       regexp_matches(lower(url), '[.](tif|tiff|png|jpg|jpeg|bmp|gif)$') AS is_image FROM pages
       UNION ALL SELECT o_orderkey, lower(o_orderkey || '_a.' || CASE o_orderkey % 5 WHEN 0 THEN 'TIF' WHEN 1 THEN 'pdf' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'tif.bak' ELSE 'Png' END),
       o_orderkey % 5 IN (0, 2, 4) FROM orders""",
)
def basename_and_extension(t: Tables) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in ("TIF", "pdf", "jpeg", "tif.bak", "Png")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    files = t.orders.select(
        F.col("o_orderkey").alias("page_id"),
        F.concat(F.lit("C:\\logs/"), F.col("o_orderkey"), F.lit("_a."), ext).alias("url"),
    )
    rows = t.pages.select("page_id", "url").unionByName(files)
    return rows.select("page_id", tx.basename_key("url").alias("basename_key"), tx.is_image("url").alias("is_image"))


@query("placeholder", MANIFEST + "SELECT import_row, lower(trim(raw_path)) = 'ihs assoc image' AS placeholder FROM manifest_v")
def placeholder(t: Tables) -> DataFrame:
    return t.manifest_v.select("import_row", tx.is_placeholder("raw_path").alias("placeholder"))


@query(
    "depth_predicate",
    MANIFEST + """SELECT import_row, CASE WHEN raw_depth = '' THEN 'filtered_blank_depth' WHEN try_cast(raw_depth AS DOUBLE) IS NULL THEN 'filtered_invalid_depth'
      WHEN NOT CAST(raw_depth AS DOUBLE) > 1500 THEN 'filtered_depth' END AS outcome FROM manifest_v""",
)
def depth_predicate(t: Tables) -> DataFrame:
    rule = DepthFilter("raw_depth", "greater_than", 1500.0)
    text = tx.text_or_blank("raw_depth")
    return t.manifest_v.select("import_row", rule.outcome(text, depth_value(text)).alias("outcome"))


@query(
    "unit_conversion",
    """SELECT o_orderkey, greatest(1, CAST(round_even(o_totalprice / 100000 * dpi, 0) AS INTEGER)) AS px,
       greatest(1, CAST(round_even(dpi / 100, 0) AS INTEGER)) AS factor,
       round(dpi / greatest(1, CAST(round_even(dpi / 100, 0) AS INTEGER)), 6) AS work_dpi
       FROM (SELECT *, CAST(50 * (o_orderkey % 9 + 1) AS DOUBLE) AS dpi FROM orders)""",
)
def unit_conversion(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("dpi", (F.lit(50) * (F.col("o_orderkey") % 9 + 1)).cast("double"))
    factor = geo.factor_for_dpi(F.col("dpi"), 100.0)
    return rows.select(
        "o_orderkey", geo.inches_to_px(F.col("o_totalprice") / 100000, F.col("dpi")).alias("px"),
        factor.alias("factor"), F.round(geo.effective_dpi(F.col("dpi"), factor), 6).alias("work_dpi"),
    )


@query(
    "box_algebra",
    """WITH b AS (SELECT event_id, CAST(round_even(user_id - value, 0) AS INTEGER) AS x0, CAST(round_even(event_id % 90 - value, 0) AS INTEGER) AS y0,
                  CAST(round_even(user_id + value, 0) AS INTEGER) AS x1, CAST(round_even(event_id % 90 + value, 0) AS INTEGER) AS y1 FROM events),
       e AS (SELECT event_id, x0 - 3 + 5 AS x0, y0 - 3 - 2 AS y0, x1 + 3 + 5 AS x1, y1 + 3 - 2 AS y1 FROM b),
       c AS (SELECT event_id, greatest(0, least(x0, 100)) AS x0, greatest(0, least(y0, 80)) AS y0, greatest(0, least(x1, 100)) AS x1, greatest(0, least(y1, 80)) AS y1 FROM e)
       SELECT *, x1 - x0 AS w, y1 - y0 AS h, (x0 + x1) / 2 AS mid_x, (y0 + y1) / 2 AS mid_y, x1 - x0 <= 0 OR y1 - y0 <= 0 AS is_empty FROM c""",
)
def box_algebra(t: Tables) -> DataFrame:
    box = geo.centered(F.col("user_id").cast("double"), (F.col("event_id") % 90).cast("double"), F.col("value"))
    rows = t.events.select("event_id", box.alias("b"))
    rows = rows.select("event_id", geo.clip(geo.shift(geo.expand(F.col("b"), 3), 5, -2), 100, 80).alias("b"))
    b = F.col("b")
    return rows.select(
        "event_id", "b.*", geo.width(b).alias("w"), geo.height(b).alias("h"),
        geo.center_x(b).alias("mid_x"), geo.center_y(b).alias("mid_y"), geo.is_empty(b).alias("is_empty"),
    )


@query(
    "viewport_level",
    """WITH v AS (SELECT event_id, CAST(event_id % 37 + 1 AS DOUBLE) / 32 AS scale, value - 30 AS vx, value * 2 AS vy FROM events),
       s AS (SELECT *, CASE WHEN scale >= 1 THEN 1 ELSE CAST(power(2, floor(log2(greatest(1, floor(1 / scale))))) AS INTEGER) END AS factor FROM v)
       SELECT event_id, factor,
              greatest(0, least(CAST(floor(vx) AS INTEGER), 900)) AS x0, greatest(0, least(CAST(floor(vy) AS INTEGER), 700)) AS y0,
              greatest(0, least(CAST(ceil(vx + 320 * (1 / scale)) AS INTEGER), 900)) AS x1, greatest(0, least(CAST(ceil(vy + 200 * (1 / scale)) AS INTEGER), 700)) AS y1 FROM s""",
)
def viewport_level(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id", ((F.col("event_id") % 37 + 1).cast("double") / F.lit(32)).alias("scale"),
        (F.col("value") - 30).alias("vx"), (F.col("value") * 2).alias("vy"),
    )
    box = geo.viewport_box(F.col("vx"), F.col("vy"), F.col("scale"), F.lit(320), F.lit(200), F.lit(900), F.lit(700))
    return rows.select("event_id", geo.factor_for_scale(F.col("scale")).alias("factor"), box.alias("b")).select(
        "event_id", "factor", "b.*"
    )


@query(
    "soft_windows",
    """WITH v AS (SELECT event_id, value / 300 AS v, CAST(event_id % 50 AS DOUBLE) / 50 AS d FROM events)
       SELECT event_id, round(CASE WHEN v <= 0.06 OR v >= 0.55 THEN 0 WHEN v < 0.14 THEN (v - 0.06) / 0.08 WHEN v <= 0.35 THEN 1 ELSE (0.55 - v) / 0.2 END, 6) AS window_score,
              round(CASE WHEN d <= 1e-6 THEN 0 WHEN v / d <= 0.3 THEN 1 WHEN v / d >= 0.85 THEN 0 ELSE (0.85 - v / d) / 0.55 END, 6) AS ratio_score FROM v""",
)
def soft_windows(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id", (F.col("value") / 300).alias("v"), ((F.col("event_id") % 50).cast("double") / 50).alias("d")
    )
    return rows.select(
        "event_id", F.round(scoring.trapezoid(F.col("v"), 0.06, 0.14, 0.35, 0.55), 6).alias("window_score"),
        F.round(scoring.ratio_score(F.col("v"), F.col("d"), 0.30, 0.85), 6).alias("ratio_score"),
    )


@query(
    "clipped_flag",
    """WITH d AS (SELECT event_id, CAST(user_id AS DOUBLE) AS cx, CAST(event_id % 90 AS DOUBLE) AS cy, value / 5 AS r FROM events),
       b AS (SELECT *, greatest(0, least(CAST(round_even(cx - 2 * r, 0) AS INTEGER), 150)) AS x0, greatest(0, least(CAST(round_even(cy - 2 * r, 0) AS INTEGER), 90)) AS y0,
                       greatest(0, least(CAST(round_even(cx + 2 * r, 0) AS INTEGER), 150)) AS x1, greatest(0, least(CAST(round_even(cy + 2 * r, 0) AS INTEGER), 90)) AS y1 FROM d)
       SELECT event_id, (x0 = 0 AND cx - r < 0) OR (x1 = 150 AND cx + r > 150) OR (y0 = 0 AND cy - r < 0) OR (y1 = 90 AND cy + r > 90) AS clipped FROM b""",
)
def clipped_flag(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id", F.col("user_id").cast("double").alias("cx"), (F.col("event_id") % 90).cast("double").alias("cy"),
        (F.col("value") / 5).alias("r"),
    )
    cx, cy, r = F.col("cx"), F.col("cy"), F.col("r")
    box = geo.clip(geo.centered(cx, cy, r * 2), 150, 90)
    return rows.withColumn("b", box).select(
        "event_id", geo.clipped_by_page(F.col("b"), cx, cy, r, F.lit(150), F.lit(90)).alias("clipped")
    )


@query(
    "source_and_revision_id",
    """SELECT page_id, substr(sha256(url), 1, 16) AS source_id,
       substr(sha256(length(html) || ':' || page_id * 1000000007 || ':512:1'), 1, 16) AS revision FROM pages""",
)
def source_and_revision_id(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id", identity.source_id(F.col("url")).alias("source_id"),
        identity.revision(F.length("html"), F.col("page_id") * 1000000007).alias("revision"),
    )


@query(
    "page_metadata",
    """WITH raw AS (SELECT o_orderkey AS page_id, CAST(o_custkey % 5 + 1 AS INTEGER) * 1000 AS width,
                  CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '200' WHEN 2 THEN 'abc' WHEN 3 THEN '157.48' ELSE '10' END AS xres,
                  CASE WHEN o_orderkey % 5 = 3 THEN '3 (pixels/cm)' ELSE '2' END AS unit,
                  CASE WHEN o_orderkey % 3 = 0 THEN CAST(300 AS DOUBLE) END AS second,
                  CASE WHEN o_orderkey % 11 = 0 THEN CAST(150 AS DOUBLE) END AS override FROM orders),
       v AS (SELECT *, try_cast(xres AS DOUBLE) * CASE WHEN unit LIKE '3%' THEN CAST(2.54 AS DOUBLE) ELSE 1 END AS tag FROM raw),
       d AS (SELECT *, CASE WHEN override IS NOT NULL THEN override WHEN tag > 20 THEN tag WHEN second > 20 THEN second ELSE 400 END AS dpi,
                  CASE WHEN override IS NOT NULL THEN 'override' WHEN tag > 20 THEN 'tiff_tag' WHEN second > 20 THEN 'pil_tag' ELSE 'default' END AS dpi_source FROM v)
       SELECT page_id, round(dpi, 6) AS dpi, dpi_source, width / dpi < 4 OR width / dpi > 20 AS implausible FROM d""",
)
def page_metadata(t: Tables) -> DataFrame:
    from inkledger.sources.images import page_facts

    k = F.col("o_orderkey") % 5
    raw = t.orders.select(
        F.col("o_orderkey").alias("page_id"),
        ((F.col("o_custkey") % 5 + 1).cast("int") * 1000).alias("width"),
        F.lit(9000).alias("height"),
        F.when(k == 0, "").when(k == 1, "200").when(k == 2, "abc").when(k == 3, "157.48").otherwise("10").alias("x_resolution"),
        F.when(k == 3, "3 (pixels/cm)").otherwise("2").alias("resolution_unit"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(300.0)).alias("second_dpi"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(150.0)).alias("dpi_override"),
    )
    return page_facts(raw).select(
        "page_id", F.round("dpi", 6).alias("dpi"), "dpi_source", (F.size("warnings") > 0).alias("implausible")
    )


@query(
    "image_catalog",
    "WITH " + ctes("manifest_v") + """ SELECT DISTINCT raw_path AS path FROM manifest_v
      WHERE regexp_matches(lower(raw_path), '[.](tif|tiff|png|jpg|jpeg|bmp|gif)$')""",
)
def image_catalog(t: Tables) -> DataFrame:
    from inkledger.sources.images import list_images

    return list_images(t.manifest_v.select(F.col("raw_path").alias("path")).distinct()).select("path")
