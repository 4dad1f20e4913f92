"""Detection, verdict and comparison queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.functions.scoring import decision, sub_scores
from inkledger.operators import compare
from inkledger.operators import detections as det
from workload.registry import Tables, query
from workload.views import ctes

# The view's four numbers stand in for band densities and the dial correlation.
_SCORED = """measured_v AS (
  SELECT *, CAST(det_id % 29 AS DOUBLE) / 60 AS digits, CAST(det_id % 23 AS DOUBLE) / 60 AS gap,
         CAST(det_id % 19 AS DOUBLE) / 40 AS text, contrast + outside * 0.2 AS ring_d, outside * 0.2 AS out_d FROM detections_v
), subs_v AS (
  SELECT *,
    CASE WHEN ring <= 0.4 OR ring >= 1.01 THEN 0 WHEN ring < 0.7 THEN (ring - 0.4) / (0.7 - 0.4) ELSE 1 END AS s_ring,
    CASE WHEN ring_d - out_d <= 0.05 OR ring_d - out_d >= 1.01 THEN 0 WHEN ring_d - out_d < 0.3 THEN (ring_d - out_d - 0.05) / (0.3 - 0.05) ELSE 1 END AS s_contrast,
    CASE WHEN digits <= 0.06 OR digits >= 0.55 THEN 0 WHEN digits < 0.14 THEN (digits - 0.06) / (0.14 - 0.06) WHEN digits <= 0.35 THEN 1 ELSE (0.55 - digits) / (0.55 - 0.35) END AS s_digits,
    CASE WHEN digits <= 1e-6 THEN 0 WHEN gap / digits <= 0.4 THEN 1 WHEN gap / digits >= 0.9 THEN 0 ELSE (0.9 - gap / digits) / (0.9 - 0.4) END AS s_gap,
    CASE WHEN text <= 0.03 OR text >= 0.5 THEN 0 WHEN text < 0.08 THEN (text - 0.03) / (0.08 - 0.03) WHEN text <= 0.3 THEN 1 ELSE (0.5 - text) / (0.5 - 0.3) END AS s_text,
    CASE WHEN digits <= 1e-6 THEN 0 WHEN out_d / digits <= 0.3 THEN 1 WHEN out_d / digits >= 0.85 THEN 0 ELSE (0.85 - out_d / digits) / (0.85 - 0.3) END AS s_outside,
    greatest(0, least(1, dial / 0.75)) AS s_angular
  FROM measured_v
), scored_v AS (
  SELECT *, 0.14 * s_ring + 0.20 * s_contrast + 0.08 * s_digits + 0.10 * s_gap + 0.07 * s_text + 0.16 * s_outside + 0.25 * s_angular AS score,
         (0.14 * s_ring + 0.20 * s_contrast + 0.08 * s_digits + 0.10 * s_gap + 0.07 * s_text + 0.16 * s_outside) / 0.75 AS geometry
  FROM subs_v
), decided_v AS (
  SELECT *, CASE WHEN score >= 0.62 THEN 'hit' WHEN score < 0.38 THEN 'miss' ELSE 'uncertain' END AS decision FROM scored_v
), pages_v AS (
  SELECT c_custkey AS page_id, 'log_' || c_custkey || '.tif' AS source_file, lpad(CAST(c_custkey AS STRING), 14, '4') AS api14,
         CAST(2000 + c_custkey % 37 * 40 AS INTEGER) AS width, CAST(9000 + c_custkey % 125 * 40 AS INTEGER) AS height,
         CAST(CASE WHEN c_custkey % 4 = 0 THEN 200 ELSE 400 END AS DOUBLE) AS dpi,
         CASE WHEN c_custkey % 6 = 0 THEN 'default' ELSE 'tiff_tag' END AS dpi_source, c_custkey % 5 = 0 AS warned
  FROM customer
)"""


def sql(select: str) -> str:
    return "WITH " + ctes("detections_v") + ", " + _SCORED + " " + select


def measured(t: Tables) -> DataFrame:
    i = F.col("det_id")
    return t.detections_v.select(
        "*", ((i % 29).cast("double") / 60).alias("digits"), ((i % 23).cast("double") / 60).alias("gap"),
        ((i % 19).cast("double") / 40).alias("text"),
        (F.col("contrast") + F.col("outside") * 0.2).alias("ring_d"), (F.col("outside") * 0.2).alias("out_d"),
    )


def density() -> dict:
    return {"ring": F.col("ring_d"), "digits": F.col("digits"), "gap": F.col("gap"),
            "text": F.col("text"), "outside": F.col("out_d")}


def scored(t: Tables, geometry_only: bool = False) -> DataFrame:
    rows = det.score_evidence(measured(t), F.col("ring"), density(), F.col("dial"), geometry_only)
    return rows.withColumn("decision", decision(F.col("score")))


def placed(t: Tables) -> DataFrame:
    """Detections with geometry and attributes on top of the scores."""
    i = F.col("det_id")
    return scored(t).select(
        "det_id", "page_id", "score", "decision", "evidence",
        ((i % 400).cast("double") / 100).alias("center_in_x"), ((i % 900).cast("double") / 100).alias("center_in_y"),
        (F.lit(0.55) + (i % 30).cast("double") / 100).alias("radius_in"),
        F.struct(
            F.lit(None).cast("string").alias("month"), F.lit(None).cast("string").alias("year"),
            F.lit(None).cast("string").alias("day"), (i % 10 == 0).alias("clipped"),
            F.when(i % 3 == 0, (i % 4).cast("double") * 90).alias("upright_ccw_deg"),
        ).alias("attrs"),
    )


def pages_of(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("page_id"), F.concat(F.lit("log_"), k, F.lit(".tif")).alias("source_file"),
        F.lpad(k.cast("string"), 14, "4").alias("api14"),
        (F.lit(2000) + k % 37 * 40).cast("int").alias("width"), (F.lit(9000) + k % 125 * 40).cast("int").alias("height"),
        F.when(k % 4 == 0, F.lit(200.0)).otherwise(F.lit(400.0)).alias("dpi"),
        F.when(k % 6 == 0, "default").otherwise("tiff_tag").alias("dpi_source"),
        F.when(k % 5 == 0, F.array(F.lit("odd width"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


@query(
    "sub_scores",
    sql("""SELECT det_id, round(s_ring, 6) AS ring, round(s_contrast, 6) AS contrast, round(s_digits, 6) AS digits, round(s_gap, 6) AS gap,
           round(s_text, 6) AS text, round(s_outside, 6) AS outside, round(s_angular, 6) AS angular FROM subs_v"""),
)
def evidence_sub_scores(t: Tables) -> DataFrame:
    scores = sub_scores(F.col("ring"), density(), F.col("dial"))
    return measured(t).select("det_id", *[F.round(v, 6).alias(k) for k, v in scores.items()])


@query(
    "weighted_score",
    sql("""SELECT det_id, round(score, 6) AS score, decision FROM decided_v"""),
)
def weighted_score(t: Tables) -> DataFrame:
    return scored(t).select("det_id", F.round("score", 6).alias("score"), "decision")


@query("geometry_score", sql("SELECT det_id, round(geometry, 6) AS score FROM scored_v"))
def geometry_score(t: Tables) -> DataFrame:
    return scored(t, geometry_only=True).select("det_id", F.round("score", 6).alias("score"))


@query(
    "decision_summary",
    sql("SELECT page_id, decision, count(*) AS n, round(max(score), 6) AS top_score FROM decided_v GROUP BY ALL"),
)
def decision_summary(t: Tables) -> DataFrame:
    return scored(t).groupBy("page_id", "decision").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("top_score")
    )


@query(
    "two_pass_budget",
    sql("""SELECT page_id, det_id, then_rank <= 3 AS matched, CAST(then_rank AS INTEGER) AS then_rank FROM (
             SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY g DESC, det_id) AS then_rank FROM (
               SELECT *, round(geometry, 9) AS g, row_number() OVER (PARTITION BY page_id ORDER BY contrast DESC, det_id) AS k FROM scored_v)
             WHERE k <= 18) WHERE then_rank <= 6"""),
)
def two_pass_budget(t: Tables) -> DataFrame:
    rows = scored(t, geometry_only=True).withColumn("g", F.round("score", 9))
    return det.within_budget(rows, "page_id", "contrast", "g", "det_id", first_n=18, match_n=3, keep_n=6).select(
        "page_id", "det_id", "matched", "then_rank"
    )


@query(
    "detection_record",
    sql("""SELECT det_id, 'date_stamp' AS element_type, CAST(round_even(cx - r, 0) AS INTEGER) AS x0, CAST(round_even(cy - r, 0) AS INTEGER) AS y0,
             CAST(round_even(cx + r, 0) AS INTEGER) AS x1, CAST(round_even(cy + r, 0) AS INTEGER) AS y1, round(score + 1e-7, 4) AS score, decision
           FROM (SELECT *, CAST(det_id % 1000 AS DOUBLE) + 0.25 AS cx, CAST(det_id % 700 AS DOUBLE) + 0.75 AS cy, CAST(det_id % 60 + 200 AS DOUBLE) + 0.125 AS r FROM decided_v)"""),
)
def detection_record(t: Tables) -> DataFrame:
    from inkledger.plans.detect import detection_record as record

    i = F.col("det_id")
    rows = scored(t).withColumn("score", F.col("score") + 1e-7).select(
        "*", ((i % 1000).cast("double") + 0.25).alias("cx"), ((i % 700).cast("double") + 0.75).alias("cy"),
        ((i % 60 + 200).cast("double") + 0.125).alias("radius"), F.lit(400.0).alias("dpi"),
        F.lit(None).cast("double").alias("angle_deg"), F.lit(None).cast("double").alias("upright_ccw_deg"),
        F.lit(False).alias("clipped"),
    )
    return record(rows).select("det_id", "element_type", "x0", "y0", "x1", "y1", "score", "decision")


@query(
    "best_detection",
    sql("""SELECT page_id, det_id, round(score, 6) AS score FROM (
             SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, det_id) AS k FROM decided_v WHERE decision <> 'miss') WHERE k = 1"""),
)
def best_detection(t: Tables) -> DataFrame:
    return det.page_summary(scored(t), "page_id", "det_id").filter("best is not null").select(
        "page_id", "best.det_id", F.round("best.score", 6).alias("score")
    )


_VERDICTS = """(SELECT p.*, coalesce(d.h, 0) AS n_hit, coalesce(d.u, 0) AS n_uncertain, coalesce(d.n, 0) AS n_detections,
   CASE WHEN d.h > 0 THEN 'YES' WHEN d.u > 0 THEN 'MAYBE' ELSE 'NO' END AS verdict
   FROM pages_v p LEFT JOIN (SELECT page_id, count(*) AS n, count(CASE WHEN decision = 'hit' THEN 1 END) AS h,
        count(CASE WHEN decision = 'uncertain' THEN 1 END) AS u FROM decided_v GROUP BY page_id) d USING (page_id))"""


@query("page_verdict", sql(f"SELECT page_id, verdict, n_hit, n_uncertain, n_detections FROM {_VERDICTS}"))
def page_verdict(t: Tables) -> DataFrame:
    return det.page_verdicts(pages_of(t).select("page_id"), scored(t), "page_id", "det_id").select(
        "page_id", "verdict", "n_hit", "n_uncertain", "n_detections"
    )


_BEST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, det_id) AS k FROM decided_v WHERE decision <> 'miss') WHERE k = 1)"""


@query(
    "page_report_row",
    sql(f"""SELECT v.page_id, source_file, verdict, CASE WHEN b.det_id IS NULL THEN 'open page' ELSE 'open at stamp' END AS link,
              round(b.score, 3) AS score, round(b.ring, 2) AS ring_seen,
              CAST(b.det_id % 400 AS DOUBLE) / 100 AS page_x_in, CAST(b.det_id % 900 AS DOUBLE) / 100 AS page_y_in,
              round((0.55 + CAST(b.det_id % 30 AS DOUBLE) / 100) * 2, 2) AS diameter_in,
              CASE WHEN b.det_id % 3 = 0 THEN CAST(b.det_id % 4 * 90 AS STRING) || '°' END AS rotation,
              api14, CAST(dpi AS INTEGER) AS dpi, printf('%.1f x %.1f', width / dpi, height / dpi) AS page_size,
              nullif(greatest(n_hit + n_uncertain - 1, 0), 0) AS other_candidates,
              nullif(concat_ws('; ', CASE WHEN warned THEN 'odd width' END, CASE WHEN dpi_source = 'default' THEN 'resolution tag missing - assumed 400 dpi' END,
                     CASE WHEN b.det_id % 10 = 0 THEN 'stamp runs off the page edge' END), '') AS notes
            FROM {_VERDICTS} v LEFT JOIN {_BEST} b ON b.page_id = v.page_id"""),
)
def page_report_row(t: Tables) -> DataFrame:
    return det.report_rows(pages_of(t), placed(t))


@query(
    "run_summary",
    sql(f"""SELECT count(*) AS n_pages, count(CASE WHEN verdict = 'YES' THEN 1 END) AS n_yes, count(CASE WHEN verdict = 'MAYBE' THEN 1 END) AS n_maybe,
            count(CASE WHEN verdict = 'NO' THEN 1 END) AS n_no, CAST(0 AS DOUBLE) AS seconds, count(CASE WHEN warned THEN 1 END) AS n_with_warnings FROM {_VERDICTS}"""),
)
def run_summary(t: Tables) -> DataFrame:
    return det.run_summary(det.page_verdicts(pages_of(t), scored(t), "page_id", "det_id"), warnings="warnings")


@query(
    "flatten_detection",
    sql("""SELECT det_id, page_id, decision, det_id % 10 = 0 AS attr_clipped, round(s_ring, 4) AS ev_ring, round(ring, 4) AS ev_raw_ring_completeness FROM decided_v"""),
)
def flatten_detection(t: Tables) -> DataFrame:
    rows = placed(t).select("det_id", "page_id", "decision", "evidence", "attrs")
    return det.flatten(rows, ["ring", "raw_ring_completeness"], ["clipped"])


@query(
    "detection_inventory",
    sql(f"""SELECT source_file, api14, dpi, round(width / dpi, 2) AS page_w_in, round(height / dpi, 2) AS page_h_in, verdict,
              d.det_id, d.decision, round(d.s_ring, 4) AS ev_ring, round(d.s_angular, 4) AS ev_angular
            FROM {_VERDICTS} v LEFT JOIN decided_v d ON d.page_id = v.page_id"""),
)
def detection_inventory(t: Tables) -> DataFrame:
    rows = placed(t).select("det_id", "page_id", "score", "decision", "evidence")
    return det.inventory(pages_of(t), rows, ["ring", "angular"]).drop("page_id", "score")


@query(
    "inventory_all_columns",
    sql("""SELECT v.page_id, d.det_id, round(CASE WHEN d.det_id % 2 = 0 THEN d.s_ring END, 4) AS ev_ring,
              round(CASE WHEN d.det_id % 2 = 1 THEN d.s_angular END, 4) AS ev_angular,
              CASE WHEN d.det_id % 5 = 0 THEN CAST(d.det_id AS DOUBLE) END AS ev_extra, d.det_id % 10 = 0 AS attr_clipped,
              CASE WHEN d.det_id % 3 = 0 THEN CAST(d.det_id % 4 AS DOUBLE) * 90 END AS attr_upright_ccw_deg
            FROM pages_v v LEFT JOIN decided_v d ON d.page_id = v.page_id"""),
)
def inventory_all_columns(t: Tables) -> DataFrame:
    """Columns from the data: evidence keys differ between detections, three attributes are never filled."""
    i = F.col("det_id")
    some = F.map_filter(
        F.map_concat(
            F.map_filter("evidence", lambda k, _: k.isin("ring", "angular")),
            F.create_map(F.lit("extra"), i.cast("double"))),
        lambda k, _: ((k == "ring") & (i % 2 == 0)) | ((k == "angular") & (i % 2 == 1)) | ((k == "extra") & (i % 5 == 0)))
    rows = placed(t).select("det_id", "page_id", "score", "decision", some.alias("evidence"), "attrs")
    made = det.inventory(pages_of(t), rows)
    return made.select("page_id", "det_id", *[c for c in made.columns if c.startswith(("ev_", "attr_"))])


@query(
    "evidence_windows",
    sql(f"""WITH b AS (SELECT p.*, b.det_id, CAST(b.det_id % 2000 AS DOUBLE) AS cx, CAST(b.det_id * 3 % 9000 AS DOUBLE) AS cy, CAST(b.det_id % 60 + 200 AS INTEGER) AS r
                       FROM pages_v p LEFT JOIN {_BEST} b ON b.page_id = p.page_id),
            h AS (SELECT *, round_even(r * (1 + CAST(0.35 AS DOUBLE)), 0) AS ch, round_even(6 * dpi / 2, 0) AS vh, least(height, CAST(14 * dpi AS INTEGER)) AS top FROM b),
            e AS (SELECT *, least(height - top, CAST(10 * dpi AS INTEGER)) AS bot FROM h),
            w AS (SELECT page_id, 'crop' AS kind, cx - ch AS x0, cy - ch AS y0, cx + ch AS x1, cy + ch AS y1, width, height FROM e WHERE det_id IS NOT NULL
                  UNION ALL SELECT page_id, 'context', cx - vh, cy - vh, cx + vh, cy + vh, width, height FROM e WHERE det_id IS NOT NULL
                  UNION ALL SELECT page_id, 'top', 0, 0, width, top, width, height FROM e WHERE det_id IS NULL
                  UNION ALL SELECT page_id, 'bottom', 0, height - bot, width, height, width, height FROM e WHERE det_id IS NULL AND bot > 0)
            SELECT page_id, kind, CAST(greatest(0, least(x0, width)) AS INTEGER) AS x0, CAST(greatest(0, least(y0, height)) AS INTEGER) AS y0,
                   CAST(greatest(0, least(x1, width)) AS INTEGER) AS x1, CAST(greatest(0, least(y1, height)) AS INTEGER) AS y1 FROM w""").replace(") WITH b AS", "), b AS"),
)
def evidence_windows(t: Tables) -> DataFrame:
    best = det.page_summary(scored(t), "page_id", "det_id").filter("best is not null").select("page_id", "best.det_id")
    i = F.col("det_id")
    placed_best = best.select(
        "page_id", (i % 2000).cast("double").alias("center_x"), (i * 3 % 9000).cast("double").alias("center_y"),
        (i % 2000 - (i % 60 + 200)).alias("x0"), (i % 2000 + (i % 60 + 200)).alias("x1"),
    )
    return det.read_windows(pages_of(t), placed_best)


@query(
    "rethreshold",
    sql("""SELECT decision, count(*) AS n FROM (SELECT CASE WHEN geometry >= 0.7 THEN 'hit' WHEN geometry < 0.5 THEN 'miss' ELSE 'uncertain' END AS decision FROM scored_v) GROUP BY decision"""),
)
def rethreshold(t: Tables) -> DataFrame:
    again = det.rescore(scored(t).select("det_id", "evidence"), geometry_only=True, t_hit=0.7, t_miss=0.5)
    return again.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query(
    "page_json",
    sql(f"""SELECT v.page_id, source_file, width, n_detections, coalesce(d.ids, '') AS ids FROM {_VERDICTS} v
            LEFT JOIN (SELECT page_id, string_agg(CAST(det_id AS STRING), ',' ORDER BY score DESC, det_id) AS ids FROM decided_v GROUP BY page_id) d ON d.page_id = v.page_id"""),
)
def page_json(t: Tables) -> DataFrame:
    from inkledger.sources.sinks import page_documents

    docs = page_documents(pages_of(t), placed(t).withColumn("det_order", F.col("det_id")))
    schema = "struct<page_id:bigint,source_file:string,width:int,detections:array<struct<det_id:bigint>>>"
    parsed = docs.select(F.from_json("document", schema).alias("j"))
    return parsed.select(
        "j.page_id", "j.source_file", "j.width", F.size("j.detections").cast("long").alias("n_detections"),
        F.array_join(F.transform("j.detections", lambda d: d["det_id"].cast("string")), ",").alias("ids"),
    )


_TRUTH = "(SELECT doc_id AS page_id, quality = 1 AS has_stamp FROM labels)"


def truth(t: Tables) -> DataFrame:
    return t.labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 1).alias("has_stamp"))


@query(
    "verdict_against_review",
    sql(f"SELECT verdict, has_stamp, count(*) AS n FROM {_VERDICTS} v FULL JOIN {_TRUTH} l ON l.page_id = v.page_id GROUP BY ALL"),
)
def verdict_against_review(t: Tables) -> DataFrame:
    verdicts = det.page_verdicts(pages_of(t).select("page_id"), scored(t), "page_id", "det_id")
    return compare.verdict_against_truth(verdicts, truth(t), "page_id")


@query(
    "threshold_sweep",
    sql(f"""SELECT threshold, CAST(sum(CASE WHEN score >= threshold AND has_stamp THEN 1 ELSE 0 END) AS BIGINT) AS true_positive,
              CAST(sum(CASE WHEN score >= threshold AND NOT has_stamp THEN 1 ELSE 0 END) AS BIGINT) AS false_positive,
              CAST(sum(CASE WHEN score < threshold AND has_stamp THEN 1 ELSE 0 END) AS BIGINT) AS false_negative
            FROM (SELECT d.page_id, round(max(score), 9) AS score FROM decided_v d GROUP BY 1) s JOIN {_TRUTH} l USING (page_id),
                 (SELECT CAST(unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8]) AS DOUBLE) AS threshold) g GROUP BY threshold"""),
)
def threshold_sweep(t: Tables) -> DataFrame:
    best = scored(t).groupBy("page_id").agg(F.round(F.max("score"), 9).alias("score"))
    return compare.threshold_sweep(best, truth(t), "page_id", [0.3, 0.4, 0.5, 0.6, 0.7, 0.8]).drop("precision", "recall")
