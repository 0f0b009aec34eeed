"""DuckDB statements of the queries that SQL can express, written on their own."""

STATEMENTS = {
    "op5_prefix_target_chat": r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length('<s>[ROLE][/ROLE]</s>') + length(regexp_replace(role, '([\\<>\[\]])', '\\\1', 'g'))
      + length(regexp_replace(text, '([\\<>\[\]])', '\\\1', 'g')) AS chars
  FROM every WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS prefix FROM placed
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(prefix) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
""",
    "op9_warc_source": r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest)
    ELSE page_id END AS kept FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM m
""",
    "op8_fm_index_substrings": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, ws[j] AS word, j, CASE WHEN j + 19 <= len(ws) THEN array_to_string(ws[j:j + 19], ' ') END AS span
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM d)
), again AS (
  SELECT doc_id, word, j,
    span IS NOT NULL AND row_number() OVER (PARTITION BY span ORDER BY doc_id, j) > 1 AS later
  FROM w
), marked AS (
  SELECT doc_id, word, j,
    bool_or(later) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM again
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op7_int8_tile_vectors": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL
), u AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS id, vec_id AS root FROM v
  UNION SELECT links.b, reach.root FROM reach JOIN links ON reach.id = links.a
), groups AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept
FROM v JOIN groups ON groups.id = vec_id LEFT JOIN n ON n.a = vec_id
""",
    "op4_multi_order_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM d WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
    GROUP BY ALL
  ) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)
), reach AS (
  SELECT doc_id AS id, doc_id AS root FROM d
  UNION SELECT links.b, reach.root FROM reach JOIN links ON reach.id = links.a
)
SELECT id AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = id GROUP BY id
""",
}
