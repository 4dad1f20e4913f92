"""Comparison SQL of the queries on collocations, centroids and mixtures."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM words
), phrases AS (
  SELECT lang, w[i:i + size - 1] AS p
  FROM places, (VALUES (1), (2), (3)) s(size) WHERE i + size - 1 <= len(w)
), f AS MATERIALIZED (
  SELECT lang, p, count(*) AS a FROM phrases GROUP BY lang, p
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len(p) = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, p, a FROM f WHERE len(p) > 1 AND a >= 10
), inner_parts AS (
  SELECT lang, p[1:2] AS p, a FROM candidates WHERE len(p) = 3
  UNION ALL SELECT lang, p[2:3], a FROM candidates WHERE len(p) = 3
), longest AS (
  SELECT lang, p, max(a) AS longer FROM inner_parts GROUP BY lang, p
), cuts AS (
  SELECT lang, p, a, unnest(generate_series(1, len(p) - 1)) AS k FROM candidates
), scored AS (
  SELECT c.lang, c.p, c.a, c.k, x.a AS l, y.a AS r,
         (1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.k]
              JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1:len(c.p)]
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS cut FROM scored
), ranked AS (
  SELECT b.lang, array_to_string(b.p, ' ') AS phrase, b.a, b.l, b.r, b.score,
         row_number() OVER (PARTITION BY b.lang
           ORDER BY b.score DESC, b.a DESC, array_to_string(b.p, ' ')) AS rank
  FROM best b LEFT JOIN longest g ON g.lang = b.lang AND g.p = b.p
  WHERE b.cut = 1 AND 100 * coalesce(g.longer, 0) < 50 * b.a
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""


def _rounds(n: int) -> str:
    """``n`` rounds of assignment and means, and one assignment more."""
    steps = []
    for t in range(n + 1):
        steps.append(f"""apart{t} AS (
  SELECT m.rid, c.c, sum((m.x - c.y) * (m.x - c.y))::BIGINT AS distance
  FROM cells m JOIN centres{t} c ON c.d = m.d GROUP BY m.rid, c.c
), assigned{t} AS MATERIALIZED (
  SELECT rid, min(struct_pack(distance := distance, c := c)) AS best FROM apart{t} GROUP BY rid
)""")
        if t < n:
            steps.append(f"""sums{t} AS (
  SELECT a.best.c AS c, m.d, sum(m.x)::HUGEINT AS s, count(*) AS n
  FROM assigned{t} a JOIN cells m ON m.rid = a.rid GROUP BY a.best.c, m.d
), centres{t + 1} AS MATERIALIZED (
  SELECT c.c, c.d, CASE WHEN s.n IS NULL THEN c.y
                        ELSE ((s.s - ((s.s % s.n) + s.n) % s.n) // s.n)::BIGINT END AS y
  FROM centres{t} c LEFT JOIN sums{t} s ON s.c = c.c AND s.d = c.d
)""")
    return ", ".join(steps)


CENTROIDS = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), cells AS MATERIALIZED (
  SELECT rid, unnest(generate_series(1, 64)) AS d, unnest(v) AS x FROM kept
), seeds AS (
  SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), v) - 1 AS c FROM kept
), centres0 AS MATERIALIZED (
  SELECT c, unnest(generate_series(1, 64)) AS d, unnest(v) AS y FROM seeds WHERE c < 8
), {_rounds(10)}, digests AS (
  SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY d)) AS centroid_sha256
  FROM centres10 GROUP BY c
)
SELECT k.vec_id, a.best.c::INTEGER AS cluster, a.best.distance AS distance,
       (sum(a.best.distance) OVER (PARTITION BY a.best.c))::BIGINT AS cluster_inertia,
       (sum(a.best.distance) OVER ())::BIGINT AS inertia, g.centroid_sha256
FROM assigned10 a JOIN kept k ON k.rid = a.rid JOIN digests g ON g.c = a.best.c
"""

MIXTURE = r"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(sha256(concat_ws(':', '13', coalesce(doc_id::VARCHAR, ''), text)), 1, 32) AS place
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighed AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
           WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS total
  FROM sizes
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS pos FROM weighed
), levels AS (
  SELECT pos, cap, weight,
         (total - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           ::DOUBLE) / (sum(weight) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
           ::DOUBLE AS level
  FROM ordered
), level AS (
  SELECT arg_min(level, pos) AS level FROM levels WHERE level * weight <= cap
), targets AS (
  SELECT source, source_size,
         CASE WHEN cap < weight::DOUBLE * level THEN cap::DOUBLE ELSE weight::DOUBLE * level END AS target
  FROM weighed, level
), goals AS (
  SELECT *, floor(target)::BIGINT // greatest(source_size, 1) AS epochs, floor(target)::BIGINT AS goal
  FROM targets
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM docs
)
SELECT p.doc_id, p.size, g.source_size, g.target,
       (g.epochs * p.size
        + greatest(0, least(p.size, g.goal - g.epochs * g.source_size - p.before)))::BIGINT AS taken
FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source
"""
