"""DuckDB statement of the codebook query, written on its own: the rounds are unrolled."""


def codebook_statement(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""
d{t} AS (
  SELECT c.r, c.part, b.e, sum((c.v - b.v) * (c.v - b.v)) AS dist
  FROM comp c JOIN book{t} b ON c.part = b.part AND c.pos = b.pos GROUP BY c.r, c.part, b.e
), a{t} AS (
  SELECT r, part, e, dist FROM d{t} QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY dist, e) = 1
)""")
        if t < rounds:
            steps.append(f"""
u{t} AS (
  SELECT a.part, a.e, c.pos, floor(sum(c.v)::DOUBLE / count(*))::BIGINT AS v
  FROM a{t} a JOIN comp c ON a.r = c.r AND a.part = c.part GROUP BY a.part, a.e, c.pos
), book{t + 1} AS (
  SELECT b.part, b.e, b.pos, coalesce(u.v, b.v) AS v
  FROM book{t} b LEFT JOIN u{t} u ON b.part = u.part AND b.e = u.e AND b.pos = u.pos
)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(abs(x::DOUBLE) < 32768, false)))
), seeds AS (
  SELECT q, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS e FROM kept
  QUALIFY e < {entries}
), dims AS (
  SELECT len(q) AS d, len(q) // {parts} AS k FROM seeds WHERE e = 0
), pts AS (
  SELECT row_number() OVER () AS r, vec_id, label, q FROM kept WHERE len(q) = (SELECT d FROM dims)
), comp AS (
  SELECT r, i // (SELECT k FROM dims) AS part, i % (SELECT k FROM dims) AS pos, q[i + 1] AS v
  FROM (SELECT r, q, unnest(range(len(q))) AS i FROM pts)
), book0 AS (
  SELECT i // (SELECT k FROM dims) AS part, e, i % (SELECT k FROM dims) AS pos, q[i + 1] AS v
  FROM (SELECT e, q, unnest(range(len(q))) AS i FROM seeds WHERE len(q) = (SELECT d FROM dims))
),{",".join(steps)}, coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error
  FROM a{rounds} GROUP BY r
)
SELECT p.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY p.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, e, pos)) FROM book{rounds}) AS codebooks_sha256
FROM pts p JOIN coded c ON p.r = c.r
"""
