"""DuckDB statement of the host-rule query, written on its own."""


def host_rules_statement(min_words: int = 50, max_repeat_pct: int = 50, max_host_rate: float = 0.5) -> str:
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), lines AS (
  SELECT r, unnest(string_split(t, chr(10))) AS l FROM d
), dup AS (
  SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), win AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)
), rep AS (
  SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, w) >= 2
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(3) t(k) GROUP BY r
), f AS (
  SELECT d.r, d.doc_id, d.host, len(d.ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup ON d.r = dup.r LEFT JOIN covered ON d.r = covered.r
), b AS (
  SELECT *, n_words < {min_words} OR n_repeat_words * 100 > n_words * {max_repeat_pct} AS base_failed FROM f
), hosts AS (
  SELECT host, count(*) AS docs, sum(base_failed::INT) AS failed, sum(base_failed::INT) / count(*) AS rate
  FROM b WHERE host IS NOT NULL GROUP BY host
), prior AS (
  SELECT avg(rate) AS mu, var_pop(rate) AS var FROM hosts
), shrunk AS (
  SELECT host, CASE WHEN var = 0 THEN mu
    ELSE (failed + mu * greatest(mu * (1 - mu) / var - 1, 0)) / (docs + greatest(mu * (1 - mu) / var - 1, 0)) END AS host_rate
  FROM hosts, prior
)
SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed,
  NOT b.base_failed AND coalesce(s.host_rate <= {max_host_rate}, true) AS kept
FROM b LEFT JOIN shrunk s ON b.host = s.host
"""
