"""Raster, voting, polar, orientation and pyramid queries on 8 x 8 pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.functions import identity
from inkledger.operators import components, hough, orientation, polar, raster, signatures
from workload.registry import Tables, query
from workload.views import ctes

PAGE = ["page_id"]


def sql(select: str, extra: str = "") -> str:
    return "WITH RECURSIVE " + ctes("ink_v") + (", " + extra if extra else "") + " " + select


def pages_of(t: Tables, dpi: float = 100.0) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("page_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(dpi).alias("dpi")
    )


def sized(t: Tables) -> DataFrame:
    return t.ink_v.withColumns({"width": F.lit(8), "height": F.lit(8)})


_CELLS = "cells AS (SELECT vec_id AS page_id, CAST(cy AS INTEGER) AS cy, CAST(cx AS INTEGER) AS cx FROM embeddings, range({n}) a(cy), range({n}) b(cx))"


@query(
    "band_tiling",
    """WITH p AS (SELECT c_custkey AS page_id, CAST(1000 + c_custkey % 4000 AS INTEGER) AS h, CAST(50 * (c_custkey % 8 + 1) AS INTEGER) AS dpi FROM customer),
       b AS (SELECT *, dpi * 6 AS band, greatest(1, dpi * 6 - dpi) AS step FROM p),
       n AS (SELECT *, greatest(0, CAST(ceil((h - band) / CAST(step AS DOUBLE)) AS INTEGER)) AS last FROM b)
       SELECT page_id, CAST(i AS INTEGER) AS band_id, CAST(i * step AS INTEGER) AS y0, CAST(least(h, i * step + band) AS INTEGER) AS y1 FROM n, range(0, 400) r(i) WHERE i <= last""",
)
def band_tiling(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    pages = t.customer.select(
        k.alias("page_id"), F.lit(2000).alias("width"), (F.lit(1000) + k % 4000).cast("int").alias("height"),
        (F.lit(50) * (k % 8 + 1)).cast("double").alias("dpi"),
    )
    return raster.page_bands(pages, 6.0, 1.0)


@query(
    "ink_in_bands",
    sql("SELECT page_id, CAST(b AS INTEGER) AS band_id, CAST(y - b * 3 AS INTEGER) AS y, x FROM ink_v, range(2) r(b) WHERE y >= b * 3 AND y < b * 3 + 5"),
)
def ink_in_bands(t: Tables) -> DataFrame:
    layout = raster.band_layout(pages_of(t, 1.0), 5.0, 2.0)
    return raster.ink_in_bands(t.ink_v, layout).select("page_id", "band_id", "y", "x")


@query(
    "run_lengths",
    sql("""SELECT page_id, y, CAST(min(x) AS INTEGER) AS x0, CAST(max(x) + 1 AS INTEGER) AS x1
           FROM (SELECT *, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS g FROM ink_v) GROUP BY page_id, y, g"""),
)
def run_lengths(t: Tables) -> DataFrame:
    runs = raster.pixels_to_runs(t.ink_v, PAGE)
    return raster.pixels_to_runs(raster.runs_to_pixels(runs), PAGE)


@query(
    "polarity",
    """WITH s AS (SELECT event_id, user_id AS block, CAST(floor(value) AS INTEGER) AS v, user_id % 2 = 0 AS white FROM events),
       m AS (SELECT block, max(v) AS hi FROM s GROUP BY block)
       SELECT block, CAST(event_id AS INTEGER) AS x FROM s JOIN m USING (block) WHERE CASE WHEN white THEN v > 0 ELSE v < greatest(hi, 1) / 2 END""",
)
def polarity(t: Tables) -> DataFrame:
    samples = t.events.select(
        F.col("user_id").alias("block"), F.lit(0).alias("y"), F.col("event_id").cast("int").alias("x"),
        F.floor("value").cast("int").alias("value"), (F.col("user_id") % 2 == 0).alias("min_is_white"),
    )
    return raster.ink_from_samples(samples, ["block"]).select("block", "x")


@query("max_pool", sql("SELECT DISTINCT page_id, CAST(y // 3 AS INTEGER) AS y, CAST(x // 3 AS INTEGER) AS x FROM ink_v WHERE y < 6 AND x < 6"))
def max_pool(t: Tables) -> DataFrame:
    return raster.max_pool(t.ink_v, PAGE, 3, F.lit(8), F.lit(8))


@query(
    "mean_pool",
    sql("""SELECT c.page_id, c.cy, c.cx, CAST(round_even(255 * (1 - coalesce(n, 0) / CAST(9 AS DOUBLE)), 0) AS INTEGER) AS gray
           FROM cells c LEFT JOIN (SELECT page_id, y // 3 AS cy, x // 3 AS cx, count(*) AS n FROM ink_v GROUP BY ALL) i USING (page_id, cy, cx)""", _CELLS.format(n=2)),
)
def mean_pool(t: Tables) -> DataFrame:
    return raster.mean_pool(t.ink_v, pages_of(t), 3)


@query(
    "reduced_read",
    sql("""SELECT c.page_id, c.cy, c.cx,
             CAST(round_even(255 * (1 - coalesce(n, 0) / CAST(((least(8, c.cy * 3 + 3) - c.cy * 3) * (least(8, c.cx * 3 + 3) - c.cx * 3)) AS DOUBLE)), 0) AS INTEGER) AS gray,
             CASE WHEN n > 0 THEN 0 ELSE 255 END AS bold
           FROM cells c LEFT JOIN (SELECT page_id, y // 3 AS cy, x // 3 AS cx, count(*) AS n FROM ink_v GROUP BY ALL) i USING (page_id, cy, cx)""", _CELLS.format(n=3)),
)
def reduced_read(t: Tables) -> DataFrame:
    average = raster.reduced_read(t.ink_v, pages_of(t), 3)
    bold = raster.reduced_read(t.ink_v, pages_of(t), 3, "max").withColumnRenamed("gray", "bold")
    return average.join(bold, ["page_id", "cy", "cx"])


_LINES = """fat_h AS MATERIALIZED (SELECT page_id, y + d AS y, x FROM ink_v, (VALUES (-1), (0), (1)) v(d) GROUP BY ALL),
fat_v AS MATERIALIZED (SELECT page_id, y, x + d AS x FROM ink_v, (VALUES (-1), (0), (1)) v(d) GROUP BY ALL),
run_h AS (SELECT *, count(*) OVER (PARTITION BY page_id, y, g) AS n FROM (SELECT *, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS g FROM fat_h)),
run_v AS (SELECT *, count(*) OVER (PARTITION BY page_id, x, g) AS n FROM (SELECT *, y - row_number() OVER (PARTITION BY page_id, x ORDER BY y) AS g FROM fat_v)),
mask AS MATERIALIZED (SELECT page_id, y, x, TRUE AS on_mask FROM
  (SELECT page_id, y, x FROM run_h WHERE n >= 8 UNION ALL SELECT page_id, y, x FROM run_v WHERE n >= 8) GROUP BY page_id, y, x)"""


@query(
    "long_line_suppression",
    "WITH " + ctes("ink_v") + ", " + _LINES + """ SELECT i.page_id, i.y, i.x, coalesce(m.on_mask, FALSE) AS on_line
       FROM ink_v i LEFT JOIN mask m USING (page_id, y, x)""",
)
def long_line_suppression(t: Tables) -> DataFrame:
    return raster.long_line_flags(raster.co_locate(t.ink_v, PAGE), PAGE, 8)


@query(
    "despeckle",
    sql("""SELECT page_id, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x FROM reach GROUP BY page_id, p HAVING count(*) >= 4""",
        """px AS (SELECT page_id, y * 8 + x AS p, y, x FROM ink_v),
           reach AS (SELECT page_id, p, p AS q FROM px UNION
             SELECT r.page_id, r.p, n.p FROM reach r JOIN px c ON c.page_id = r.page_id AND c.p = r.q
             JOIN px n ON n.page_id = r.page_id AND abs(n.y - c.y) + abs(n.x - c.x) = 1)"""),
)
def despeckle(t: Tables) -> DataFrame:
    return components.despeckle(t.ink_v, PAGE, 4)


@query(
    "boundary",
    sql("""SELECT page_id, y, x FROM ink_v i WHERE (SELECT count(*) FROM ink_v n WHERE n.page_id = i.page_id AND abs(n.y - i.y) <= 1 AND abs(n.x - i.x) <= 1)
           < (1 + CAST(y > 0 AS INTEGER) + CAST(y < 7 AS INTEGER)) * (1 + CAST(x > 0 AS INTEGER) + CAST(x < 7 AS INTEGER))"""),
)
def boundary(t: Tables) -> DataFrame:
    rows = raster.boundary_flags(raster.co_locate(sized(t), PAGE), PAGE, ["width", "height"])
    return rows.filter("edge").select("page_id", "y", "x")


def _kernel_values() -> str:
    rows = raster.gradient_kernels()
    return "kern(d, s, m) AS (VALUES " + ", ".join(f"({d}, CAST({s!r} AS DOUBLE), CAST({m!r} AS DOUBLE))" for d, s, m in rows) + ")"


_NORMALS = _kernel_values() + """, raw_g AS (
  SELECT b.page_id, b.y, b.x, sum(kx.s * ky.m) AS gx, sum(kx.m * ky.s) AS gy
  FROM edge_v b JOIN ink_v i ON i.page_id = b.page_id JOIN kern kx ON kx.d = i.x - b.x JOIN kern ky ON ky.d = i.y - b.y
  GROUP BY b.page_id, b.y, b.x
), normals AS (SELECT page_id, y, x, gx / greatest(sqrt(gx * gx + gy * gy), 1e-6) AS nx, gy / greatest(sqrt(gx * gx + gy * gy), 1e-6) AS ny FROM raw_g)"""
_EDGE = """edge_v AS (SELECT page_id, y, x FROM ink_v i WHERE (SELECT count(*) FROM ink_v n WHERE n.page_id = i.page_id AND abs(n.y - i.y) <= 1 AND abs(n.x - i.x) <= 1)
           < (1 + CAST(y > 0 AS INTEGER) + CAST(y < 7 AS INTEGER)) * (1 + CAST(x > 0 AS INTEGER) + CAST(x < 7 AS INTEGER)))"""


def normals_of(t: Tables) -> DataFrame:
    carry = ["width", "height"]
    flagged = raster.boundary_flags(raster.co_locate(sized(t), PAGE), PAGE, carry)
    return raster.edge_normals(flagged, PAGE, carry=carry)


@query(
    "unit_gradients",
    sql("SELECT page_id, y, x, round(nx, 6) + 0 AS nx, round(ny, 6) + 0 AS ny FROM normals", _EDGE + ", " + _NORMALS),
)
def unit_gradients(t: Tables) -> DataFrame:
    rows = normals_of(t)
    return rows.select(
        "page_id", "y", "x", (F.round("nx", 6) + 0).alias("nx"), (F.round("ny", 6) + 0).alias("ny")
    )


@query(
    "ink_density",
    sql("""SELECT page_id, CAST(y - dy AS INTEGER) AS y, CAST(x - dx AS INTEGER) AS x, round(count(*) / CAST(16 AS DOUBLE), 6) AS density
           FROM ink_v, (VALUES (-2), (-1), (0), (1)) a(dy), (VALUES (-2), (-1), (0), (1)) b(dx) GROUP BY ALL"""),
)
def ink_density(t: Tables) -> DataFrame:
    rows = raster.ink_density(raster.co_locate(t.ink_v, PAGE), PAGE, 4)
    return rows.select("page_id", "y", "x", F.round("density", 6).alias("density"))


_VOTES = _EDGE + ", " + _NORMALS + """, votes AS (
  SELECT page_id, radius, CAST(round_even(y + s * radius * ny, 0) AS INTEGER) AS cy, CAST(round_even(x + s * radius * nx, 0) AS INTEGER) AS cx, count(*) AS votes
  FROM normals, (VALUES (CAST(2 AS DOUBLE)), (CAST(3 AS DOUBLE))) r(radius), (VALUES (1), (-1)) g(s) GROUP BY ALL
), inside AS (SELECT * FROM votes WHERE cy BETWEEN 0 AND 7 AND cx BETWEEN 0 AND 7),
gathered AS (
  SELECT page_id, radius, cy + dy AS cy, cx + dx AS cx, CAST(sum(votes) AS BIGINT) AS votes FROM inside, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)
  WHERE cy + dy BETWEEN 0 AND 7 AND cx + dx BETWEEN 0 AND 7 GROUP BY 1, 2, 3, 4
)"""


@query("hough_votes", sql("SELECT page_id, radius, CAST(sum(votes) AS BIGINT) AS votes, count(*) AS n_cells FROM inside GROUP BY ALL", _VOTES))
def hough_votes(t: Tables) -> DataFrame:
    return hough.cast_votes(normals_of(t), PAGE, [2.0, 3.0]).groupBy("page_id", "radius").agg(
        F.sum("votes").alias("votes"), F.count(F.lit(1)).alias("n_cells")
    )


@query("vote_box_sum", sql("SELECT page_id, radius, cy, cx, votes FROM gathered", _VOTES))
def vote_box_sum(t: Tables) -> DataFrame:
    votes = hough.cast_votes(normals_of(t), PAGE, [2.0, 3.0])
    return hough.gather_votes(votes, PAGE).select("page_id", "radius", "cy", "cx", "votes")


_PEAKS = """SELECT g.page_id, g.radius, g.cy, g.cx, CAST(g.votes AS DOUBLE) AS votes FROM gathered g
  WHERE g.votes >= 0.9 * 2 * pi() * g.radius AND NOT EXISTS (SELECT 1 FROM gathered n WHERE n.page_id = g.page_id AND n.radius = g.radius
        AND abs(n.cy - g.cy) <= 3 AND abs(n.cx - g.cx) <= 3 AND n.votes > g.votes)"""


def peaks_of(t: Tables) -> DataFrame:
    votes = hough.cast_votes(normals_of(t), PAGE, [2.0, 3.0])
    return hough.peaks(hough.gather_votes(votes, PAGE), PAGE, 0.9)


@query("vote_peaks", sql(_PEAKS, _VOTES))
def vote_peaks(t: Tables) -> DataFrame:
    return peaks_of(t)


_GREEDY = """ranked AS (
  SELECT page_id, radius, cy, cx, votes,
         row_number() OVER (PARTITION BY page_id ORDER BY votes DESC, cy, cx, radius) AS k
  FROM (""" + _PEAKS + """)
), walk AS (
  SELECT page_id, k, radius, cy, cx, votes, TRUE AS taken, [{'cy': cy, 'cx': cx}] AS kept FROM ranked WHERE k = 1
  UNION ALL
  SELECT r.page_id, r.k, r.radius, r.cy, r.cx, r.votes, f.free,
         CASE WHEN f.free THEN list_append(w.kept, {'cy': r.cy, 'cx': r.cx}) ELSE w.kept END
  FROM walk w JOIN ranked r ON r.page_id = w.page_id AND r.k = w.k + 1,
       LATERAL (SELECT len(list_filter(w.kept, lambda o: (o.cy - r.cy) * (o.cy - r.cy) + (o.cx - r.cx) * (o.cx - r.cx) <= 4)) = 0 AS free) f
)"""


@query(
    "greedy_suppression",
    sql("""SELECT page_id, radius, cy, cx, votes, CAST(2 AS DOUBLE) AS min_sep FROM (
             SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS n FROM walk WHERE taken) WHERE n <= 12""",
        _VOTES + ", " + _GREEDY),
)
def greedy_suppression(t: Tables) -> DataFrame:
    return hough.greedy_suppression(peaks_of(t).withColumn("min_sep", F.lit(2.0)), PAGE, "min_sep", 12)


@query(
    "lift_to_page",
    sql(f"SELECT page_id, radius * 4 AS radius, CAST(cx * 4 + 100 AS INTEGER) AS cx, CAST(cy * 4 + 200 AS INTEGER) AS cy, votes FROM ({_PEAKS})", _VOTES),
)
def lift_to_page(t: Tables) -> DataFrame:
    rows = peaks_of(t).withColumns({"factor": F.lit(4), "x0": F.lit(100), "y0": F.lit(200)})
    return hough.lift(rows, "factor", "x0", "y0").drop("factor", "x0", "y0")


def _ring_values() -> str:
    return "ringo(dy, dx) AS (VALUES " + ", ".join(str(o) for o in raster.ring_offsets(2.0, 0.5)) + ")"


@query(
    "annulus_response",
    sql("SELECT page_id, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x, round(count(*) / (SELECT count(*) FROM ringo), 6) AS response FROM ink_v, ringo GROUP BY ALL", _ring_values()),
)
def annulus_response(t: Tables) -> DataFrame:
    rows = raster.annulus_response(raster.co_locate(t.ink_v, PAGE), PAGE, 2.0, 0.5)
    return rows.select("page_id", "y", "x", F.round("response", 6).alias("response"))


# ------------------------------------------------------------------------ polar

def candidates_of(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("cand_id"), F.col("vec_id").alias("page_id"),
        (F.lit(3.3) + (F.col("vec_id") % 3).cast("double") / 4).alias("cx"), F.lit(3.6).alias("cy"), F.lit(3.0).alias("radius"),
    )


def _angle_values(n: int) -> str:
    import math

    rows = [(i, math.cos(2.0 * math.pi * i / n), math.sin(2.0 * math.pi * i / n)) for i in range(n)]
    return "ang(theta_i, c, s) AS (VALUES " + ", ".join(f"({i}, CAST({c!r} AS DOUBLE), CAST({s!r} AS DOUBLE))" for i, c, s in rows) + ")"


_POLAR = _angle_values(16) + """, rad(r_i, rf) AS (VALUES (0, CAST(0.25 AS DOUBLE)), (1, CAST(0.5 AS DOUBLE)), (2, CAST(0.75 AS DOUBLE)), (3, CAST(1 AS DOUBLE))),
smp AS (SELECT vec_id AS cand_id, r_i, rf, theta_i, CAST(3.3 AS DOUBLE) + CAST(vec_id % 3 AS DOUBLE) / 4 + rf * 3 * c AS sx, CAST(3.6 AS DOUBLE) + rf * 3 * s AS sy FROM embeddings, rad, ang),
cor AS (SELECT *, CAST(floor(sx) AS INTEGER) AS x0, CAST(floor(sy) AS INTEGER) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM smp),
pol AS (SELECT c.cand_id, r_i, rf, theta_i,
    sum(CASE WHEN i.page_id IS NULL THEN 0 ELSE (CASE WHEN dx = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN dy = 1 THEN fy ELSE 1 - fy END) END) AS ink
  FROM cor c CROSS JOIN (VALUES (0), (1)) a(dx) CROSS JOIN (VALUES (0), (1)) b(dy)
  LEFT JOIN ink_v i ON i.page_id = c.cand_id AND i.y = y0 + dy AND i.x = x0 + dx GROUP BY ALL)"""


def polar_of(t: Tables) -> DataFrame:
    return polar.polar_sample(candidates_of(t), t.ink_v, 0.25, 1.0, 4, 16)


@query("polar_sampling", sql("SELECT cand_id, r_i, theta_i, round(ink, 6) + 0 AS ink FROM pol", _POLAR))
def polar_sampling(t: Tables) -> DataFrame:
    return polar_of(t).select("cand_id", "r_i", "theta_i", (F.round("ink", 6) + 0).alias("ink"))


@query("radial_profile", sql("SELECT cand_id, r_i, round(avg(ink), 6) AS ink FROM pol GROUP BY ALL", _POLAR))
def radial_profile(t: Tables) -> DataFrame:
    return polar.radial_profile(polar_of(t)).select("cand_id", "r_i", F.round("ink", 6).alias("ink"))


@query(
    "angular_signature",
    sql("""SELECT 'band' AS kind, cand_id, theta_i, round(avg(ink), 6) AS v FROM pol WHERE rf >= 0.7 GROUP BY ALL
           UNION ALL SELECT 'empty', cand_id, theta_i, round(avg(ink), 6) FROM pol GROUP BY ALL""", _POLAR),
)
def angular_signature(t: Tables) -> DataFrame:
    rows = polar_of(t)
    parts = [
        polar.angular_signature(rows, band).select(F.lit(kind).alias("kind"), "cand_id", "theta_i", F.round("v", 6).alias("v"))
        for kind, band in (("band", (0.7, 1.1)), ("empty", (1.4, 1.5)))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "ring_completeness",
    sql("""SELECT cand_id, round(avg(CASE WHEN v >= 0.25 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS ring_completeness
           FROM (SELECT cand_id, theta_i, avg(ink) AS v FROM pol WHERE rf >= 0.94 GROUP BY ALL) GROUP BY cand_id""", _POLAR),
)
def ring_completeness(t: Tables) -> DataFrame:
    return polar.ring_completeness(polar_of(t)).select("cand_id", F.round("ring_completeness", 6).alias("ring_completeness"))


# -------------------------------------------------------------------- signatures

_UNIT = """unit AS (SELECT vec_id, bin, (v - avg(v) OVER w) / sqrt(sum(v * v) OVER w - 64 * power(avg(v) OVER w, 2)) AS u FROM signature_v WINDOW w AS (PARTITION BY vec_id)),
corr AS (SELECT s.vec_id, (s.bin - r.bin + 64) % 64 AS shift, sum(s.u * r.u) AS c FROM unit s, unit r WHERE r.vec_id = 0 GROUP BY ALL),
best AS (SELECT vec_id, max(c) AS peak, arg_max(shift, c) AS shift FROM corr GROUP BY vec_id)"""


def arrays(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("sig_id"), F.col("embedding").cast("array<double>").alias("sig"))


def anchor(t: Tables) -> list[float]:
    return list(arrays(t).filter("sig_id = 0").first()["sig"])


@query(
    "circular_correlation",
    sql("SELECT vec_id AS sig_id, round(peak, 6) AS peak, CAST(shift AS INTEGER) AS shift, round((360 - shift * 360 / CAST(64 AS DOUBLE)) % 360, 6) AS angle_deg FROM best", _UNIT),
)
def circular_correlation(t: Tables) -> DataFrame:
    rows = signatures.with_correlation(arrays(t), anchor(t))
    return rows.select("sig_id", F.round("peak", 6).alias("peak"), "shift", F.round("angle_deg", 6).alias("angle_deg"))


@query(
    "template_build",
    sql("SELECT CAST(bin AS INTEGER) AS bin, round(v, 6) + 0 AS v FROM (SELECT (u.bin - b.shift + 64) % 64 AS bin, avg(u.u) AS v FROM unit u JOIN best b USING (vec_id) GROUP BY 1)", _UNIT),
)
def template_build(t: Tables) -> DataFrame:
    sources = arrays(t).select(
        "sig_id", "sig", F.slice("sig", 1, 8).alias("profile"),
        (F.lit(0.55) + (F.col("sig_id") % 30).cast("double") / 100).alias("radius_in"), F.col("sig_id").alias("order"),
    )
    made = signatures.build_template(sources)
    return made.select(F.posexplode("digit_signature").alias("bin", "v")).select("bin", (F.round("v", 6) + 0).alias("v"))


@query(
    "template_fields",
    sql("""SELECT 'signature' AS part, CAST((u.bin - b.shift + 64) % 64 AS INTEGER) AS i, round(avg(u.u), 6) + 0 AS v FROM unit u JOIN best b USING (vec_id) GROUP BY 2
           UNION ALL SELECT 'profile', bin, round(avg(v), 6) + 0 FROM signature_v GROUP BY bin
           UNION ALL SELECT 'radius_in', 0, round(median(CAST(0.55 AS DOUBLE) + CAST(vec_id % 30 AS DOUBLE) / 100), 6) FROM embeddings
           UNION ALL SELECT 'n_sources', 0, CAST(count(*) AS DOUBLE) FROM embeddings""", _UNIT),
)
def template_fields(t: Tables) -> DataFrame:
    """All fields of the template that every signature and whole profile goes into."""
    sources = arrays(t).select(
        "sig_id", "sig", F.col("sig").alias("profile"),
        (F.lit(0.55) + (F.col("sig_id") % 30).cast("double") / 100).alias("radius_in"), F.col("sig_id").alias("order"),
    )
    made = signatures.build_template(sources)
    parts = [
        made.select(F.lit(name).alias("part"), F.posexplode(column).alias("i", "v"))
        for name, column in (("signature", F.col("digit_signature")), ("profile", F.col("radial_profile")),
                             ("radius_in", F.array("radius_in")), ("n_sources", F.array(F.col("n_sources").cast("double"))))
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rows.select("part", "i", (F.round("v", 6) + 0).alias("v"))


# ------------------------------------------------------------------- orientation

_COARSE = [i * 10.0 for i in range(18)]


def _turn_values() -> str:
    rows = orientation.angle_table(_COARSE)
    return "turn(angle, c, s) AS (VALUES " + ", ".join(f"(CAST({a!r} AS DOUBLE), CAST({c!r} AS DOUBLE), CAST({s!r} AS DOUBLE))" for a, c, s in rows) + ")"


_SHARP = _turn_values() + """, prj AS (SELECT page_id, angle, y * c - x * s AS t FROM ink_v, turn),
lo AS (SELECT page_id, angle, min(t) AS low, count(*) AS n FROM prj GROUP BY ALL),
bins AS (SELECT p.page_id, p.angle, l.n, CAST(floor(t - low) AS BIGINT) AS bin, count(*) AS c FROM prj p JOIN lo l USING (page_id, angle) GROUP BY ALL),
sharp AS (SELECT page_id, angle, CASE WHEN n < 20 THEN 0 ELSE (sum(c * c) / CAST(max(bin) + 1 AS DOUBLE) - power(sum(c) / CAST(max(bin) + 1 AS DOUBLE), 2)) / power(sum(c) / CAST(max(bin) + 1 AS DOUBLE), 2) END AS sharpness FROM bins GROUP BY page_id, angle, n)"""


@query("projection_sharpness", sql("SELECT page_id, angle, round(sharpness, 6) AS sharpness FROM sharp", _SHARP))
def projection_sharpness(t: Tables) -> DataFrame:
    rows = orientation.projection_sharpness(raster.co_locate(t.ink_v, PAGE), "page_id", _COARSE)
    return rows.select("page_id", "angle", F.round("sharpness", 6).alias("sharpness"))


@query("line_direction")
def line_direction(t: Tables) -> DataFrame:
    return orientation.line_direction(raster.co_locate(t.ink_v, PAGE), "page_id")


@query("disc_mask", sql("SELECT page_id, y, x FROM ink_v WHERE power(x - 3.5, 2) + power(y - 3.5, 2) <= 9"))
def disc_mask(t: Tables) -> DataFrame:
    return polar.disc(t.ink_v, F.lit(3.5), F.lit(3.5), F.lit(3.0))


@query(
    "upright_rotation",
    """WITH v AS (SELECT event_id, value * 3 % 180 AS angle, 1 + CAST(event_id % 20 AS DOUBLE) / 10 AS strength, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (value * 7 + 0.001) % 360 END AS dial FROM events),
       b AS (SELECT *, round_even(angle / 90, 0) * 90 AS base, (360 - dial) AS implied FROM v),
       d AS (SELECT *, base % 360 AS one, (base + 180) % 360 AS other, ((base - implied) % 360 + 360) % 360 AS d1, ((base + 180 - implied) % 360 + 360) % 360 AS d2 FROM b)
       SELECT event_id, round(CASE WHEN strength >= 1.7 THEN CASE WHEN dial IS NULL OR least(d1, 360 - d1) <= least(d2, 360 - d2) THEN one ELSE other END
              ELSE implied % 360 END, 1) AS upright FROM d""",
)
def upright_rotation(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id", (F.col("value") * 3 % 180).alias("angle"), (F.lit(1.0) + (F.col("event_id") % 20).cast("double") / 10).alias("strength"),
        F.when(F.col("event_id") % 3 != 0, (F.col("value") * 7 + 0.001) % 360).alias("dial"),
    )
    return rows.select(
        "event_id", orientation.upright_rotation(F.col("angle"), F.col("strength"), F.col("dial")).alias("upright")
    )


# ----------------------------------------------------------------------- pyramid

_LEVELS = """lv AS (SELECT page_id, 2 AS factor, y // 2 AS cy, x // 2 AS cx, count(*) AS ink FROM ink_v GROUP BY ALL
  UNION ALL SELECT page_id, 4, y // 4, x // 4, count(*) FROM ink_v GROUP BY ALL
  UNION ALL SELECT page_id, 8, y // 8, x // 8, count(*) FROM ink_v GROUP BY ALL)"""


@query(
    "pyramid_build",
    sql("""SELECT page_id, factor, CAST(cy // 2 AS INTEGER) AS ty, CAST(cx // 2 AS INTEGER) AS tx, CAST(cy AS INTEGER) AS cy, CAST(cx AS INTEGER) AS cx, ink,
           CAST(round_even(255 * (1 - ink / CAST(factor * factor AS DOUBLE)), 0) AS INTEGER) AS gray, 0 AS bold FROM lv""", _LEVELS),
)
def pyramid_build(t: Tables) -> DataFrame:
    return raster.pyramid(t.ink_v, pages_of(t), 3, tile_size=2)


@query(
    "tile_window",
    sql("""SELECT c.page_id, c.cy, c.cx, CASE WHEN l.ink IS NULL THEN 255 ELSE CAST(round_even(255 * (1 - l.ink / CAST(4 AS DOUBLE)), 0) AS INTEGER) END AS gray
           FROM cells c LEFT JOIN lv l ON l.page_id = c.page_id AND l.factor = 2 AND l.cy = c.cy AND l.cx = c.cx
           WHERE c.cy BETWEEN 1 AND 3 AND c.cx BETWEEN 0 AND 2""", _LEVELS + ", " + _CELLS.format(n=4)),
)
def tile_window(t: Tables) -> DataFrame:
    cells = raster.pyramid(t.ink_v, pages_of(t), 1, tile_size=2)
    windows = t.embeddings.select(
        F.col("vec_id").alias("window_id"), F.col("vec_id").alias("page_id"), F.lit(2).alias("factor"),
        F.lit(1).alias("x0"), F.lit(3).alias("y0"), F.lit(5).alias("x1"), F.lit(8).alias("y1"),
    )
    return raster.tile_window(cells, windows, tile_size=2).select("page_id", "cy", "cx", "gray")


@query(
    "stale_tiles",
    """WITH c AS (SELECT page_id, substr(sha256(url), 1, 16) AS source_id, substr(sha256(length(html) || ':' || page_id || ':512:1'), 1, 16) AS revision FROM pages),
       s AS (SELECT substr(sha256(url), 1, 16) AS source_id, substr(sha256((length(html) + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END) || ':' || page_id || ':512:1'), 1, 16) AS revision FROM pages WHERE page_id % 5 <> 0)
       SELECT page_id, source_id, revision FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source_id = c.source_id AND s.revision = c.revision)""",
)
def stale_tiles(t: Tables) -> DataFrame:
    size = F.length("html")
    catalog = t.pages.select(
        "page_id", identity.source_id(F.col("url")).alias("source_id"), identity.revision(size, F.col("page_id")).alias("revision")
    )
    stored = t.pages.filter("page_id % 5 <> 0").select(
        identity.source_id(F.col("url")).alias("source_id"),
        identity.revision(size + F.when(F.col("page_id") % 3 == 0, 1).otherwise(0), F.col("page_id")).alias("revision"),
    )
    return raster.stale_sources(catalog, stored)
