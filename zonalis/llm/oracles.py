"""SQL for the duplicate searches, over all pairs and all byte positions: for DuckDB and small tables."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents WHERE text IS NOT NULL),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM split WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) GROUP BY ALL) p
  JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y
  WHERE x <> y AND 100 * k >= 80 * (na.n + nb.n - k)),
reach(id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT link.y, reach.root FROM reach JOIN link ON link.x = reach.id),
named AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN named ON named.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

REPEATS = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 800)) AS s
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS p FROM d WHERE len(h) >= 800)),
hit AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS step
  FROM w JOIN (SELECT s FROM w GROUP BY s HAVING count(*) > 1) again USING (s)),
run AS (SELECT doc_id, min(p) AS b, max(p) + 400 AS e FROM (
    SELECT doc_id, p, count(*) FILTER (step IS NULL OR step > 400) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit)
  GROUP BY doc_id, k),
gap AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS before FROM run),
cut AS (SELECT d.doc_id, sum(e - b) AS gone, count(*) AS spans,
    string_agg(substr(h, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) || substr(any_value(h), 2 * max(e) + 1) AS kept
  FROM gap JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""
