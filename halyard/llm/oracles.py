"""SQL for the rows of those queries that SQL can express. What is left out there: learnt models, seeded draws and
tokenizers (op2's draw of blocks, op4's hashes, op6, op8, op9's model, op10), and eigenvectors (op11)."""

from __future__ import annotations

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda w: w <> '') AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
weights AS (SELECT doc_id, g, 1 + floor(log2(count(*))) AS w FROM grams GROUP BY ALL),
totals AS (SELECT doc_id, sum(w) AS t FROM weights GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.w, b.w)) AS m FROM weights a JOIN weights b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN totals x ON x.doc_id = a JOIN totals y ON y.doc_id = b WHERE m / (x.t + y.t - m) >= 0.8
  UNION SELECT first, doc_id FROM (SELECT doc_id, min(doc_id) OVER () AS first FROM words WHERE len(w) = 0) WHERE doc_id <> first),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(v, r) AS (SELECT a, b FROM edges UNION SELECT reach.v, edges.b FROM reach JOIN edges ON edges.a = reach.r)
SELECT doc_id, least(doc_id, coalesce((SELECT min(r) FROM reach WHERE v = doc_id), doc_id)) AS class_id FROM documents
"""

REPEATED_STRINGS = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
starts AS (SELECT doc_id, x, unnest(range(0, greatest(octet_length(x) - 199, 0))) AS i FROM d),
hashed AS (SELECT doc_id, i, md5(x[i + 1:i + 200]) AS h FROM starts),
common AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1),
fresh AS (
  SELECT doc_id, i, CASE WHEN i <= 200 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS f FROM hashed SEMI JOIN common USING (h)),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM fresh) GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM runs),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS e, string_agg(CASE WHEN a > p THEN hex(x[p + 1:a]) ELSE '' END, '' ORDER BY a) AS k
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, octet_length(x) AS n_bytes, cast(coalesce(n_removed, 0) AS bigint) AS n_removed, cast(coalesce(n_spans, 0) AS bigint) AS n_spans,
  sha256(CASE WHEN k IS NULL THEN x ELSE unhex(k || CASE WHEN e < octet_length(x) THEN hex(x[e + 1:octet_length(x)]) ELSE '' END) END) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

EMBEDDING_LINKS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, e FROM (SELECT vec_id, label, list_transform(embedding, lambda x: cast(x AS double)) AS e FROM embeddings)
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(n, r) AS (SELECT a, b FROM edges UNION SELECT reach.n, edges.b FROM reach JOIN edges ON edges.a = reach.r),
found AS (SELECT vec_id, least(vec_id, coalesce((SELECT min(r) FROM reach WHERE n = vec_id), vec_id)) AS component_id FROM embeddings)
SELECT vec_id, (SELECT count(*) FROM edges WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM found
"""

ARCHIVES = """
WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS s FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((16 * (strpos('0123456789abcdef', substr(s, 5 * i // 4 + 1, 1)) - 1)
    + strpos('0123456789abcdef', substr(s, 5 * i // 4 + 2, 1)) - 1) >> (3 - (5 * i - 4 * (5 * i // 4)))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

LINES = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

FILTER_AUDIT = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
said AS (SELECT doc_id, max(cast(quality = 1 AS integer)) AS good, max(cast(toxic = 1 AS integer)) AS bad FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, {
    'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words), 'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': doc_id <> first} AS f FROM w LEFT JOIN said USING (doc_id)),
masks AS (SELECT part, concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END, CASE WHEN f.D THEN 'D' ELSE '' END, CASE WHEN f.E THEN 'E' ELSE '' END) AS mask,
  count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM failed GROUP BY ALL),
orders(o) AS (SELECT '' UNION ALL SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE length(o) < 5 AND NOT contains(o, x)),
steps AS (SELECT o AS filter_order, s AS step, o[s] AS x, left(o, s - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS s) WHERE length(o) = 5),
rows AS (
  SELECT part, filter_order, step, x,
    coalesce(sum(n) FILTER (NOT regexp_matches(mask, '[' || before || x || ']')), 0) AS kept,
    coalesce(sum(n) FILTER (contains(mask, x) AND NOT regexp_matches(mask, '[' || before || '_]')), 0) AS removed,
    coalesce(sum(n) FILTER (contains(mask, x) AND regexp_matches(mask, '[' || before || '_]')), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = x), 0) AS unique_fails,
    coalesce(sum(good) FILTER (contains(mask, x) AND NOT regexp_matches(mask, '[' || before || '_]')), 0) AS good_lost,
    coalesce(sum(bad) FILTER (contains(mask, x) AND NOT regexp_matches(mask, '[' || before || '_]')), 0) AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, cast(step AS integer) AS step, cast(kept AS bigint) AS kept, cast(removed AS bigint) AS removed, cast(redundant AS bigint) AS redundant, cast(unique_fails AS bigint) AS unique_fails,
  cast(good_lost AS bigint) AS good_lost, cast(toxic_lost AS bigint) AS toxic_lost, cast(sum(removed) OVER (PARTITION BY part, x) AS bigint) AS shapley FROM rows
"""

ORACLES = {
    "op1_near_duplicates": NEAR_DUPLICATES,
    "op3_repeated_strings": REPEATED_STRINGS,
    "op5_embedding_links": EMBEDDING_LINKS,
    "op7_archives": ARCHIVES,
    "op12_lines": LINES,
    "op13_filter_audit": FILTER_AUDIT,
}
