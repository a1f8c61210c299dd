"""SQL that the queries of this package are checked against, where SQL can express them."""

_NEWEST = "SELECT * FROM opensearch WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) = 1"
_WORDS = r"list_distinct(regexp_extract_all(lower(concat_ws(' ', name, text)), '[\p{L}\p{N}]+'))"
_USABLE = "coalesce(len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false)"
_ROWS = f"""(SELECT session_id, frame_id, embedding::double[] AS v FROM (SELECT * FROM active_learner WHERE frame_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY scored_at DESC) = 1)
   WHERE session_id IS NOT NULL AND {_USABLE} AND prediction IS NOT NULL AND NOT isnan(prediction) AND prediction BETWEEN 0 AND 1)"""

SQL = {
    "p1_found": f"""
WITH d AS (SELECT id, {_WORDS} AS w FROM ({_NEWEST}) WHERE len({_WORDS}) >= 8),
pairs AS (SELECT a.id AS id_a, b.id AS id_b, len(a.w) AS na, len(b.w) AS nb, len(list_intersect(a.w, b.w)) AS c
          FROM d a JOIN d b ON a.id < b.id AND len(a.w) >= 0.7 * len(b.w) - 1e-9 AND len(b.w) >= 0.7 * len(a.w) - 1e-9)
SELECT id_a, id_b FROM pairs WHERE c / (na + nb - c)::double >= 0.7 - 1e-9""",
    "p5_found": rf"""
WITH s AS (SELECT id, coalesce(regexp_replace(lower(name), '[^\p{{L}}\p{{N}}]+', '', 'g'), '') AS x,
                  coalesce(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '', 'g'), '') AS y
           FROM ({_NEWEST}) WHERE len({_WORDS}) >= 8),
g AS (SELECT id, min(id) OVER (PARTITION BY least(x, y), greatest(x, y)) AS keep_id FROM s)
SELECT keep_id, id AS copy_id FROM g WHERE id <> keep_id""",
    "p7_found": r"""
WITH g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 10)), lambda i: array_to_string(w[i:i + 11], ' '))) AS gram
           FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL)),
h AS (SELECT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 10)), lambda i: array_to_string(w[i:i + 11], ' '))) AS gram
      FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL))
SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (gram)""",
    "p6_sound": "SELECT size_id, count(DISTINCT doc_id) AS documents, true AS whole, true AS fits, true AS full FROM context_sizes, documents WHERE doc_id IS NOT NULL GROUP BY size_id",
    "p2_sizes": f"""
WITH n AS (SELECT session_id, count(*) AS n FROM {_ROWS} GROUP BY session_id),
k AS (SELECT session_id, max(n_eval_per_iteration) AS k FROM sessions WHERE session_id IS NOT NULL GROUP BY session_id)
SELECT session_id, least(n, coalesce(k, 20)) AS picked, least(n, coalesce(k, 20)) AS last_pick FROM n LEFT JOIN k USING (session_id) WHERE coalesce(k, 20) > 0""",
    "p3_found": f"""
WITH d AS (SELECT id, embedding::double[] AS v FROM ({_NEWEST}) WHERE {_USABLE}),
s AS (SELECT a.id AS x, b.id AS y, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM d a JOIN d b ON a.id <> b.id),
r AS (SELECT x, y FROM s WHERE s >= 0.7 QUALIFY row_number() OVER (PARTITION BY x ORDER BY s DESC, y) <= 10)
SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM r""",
    "p4_found": f"""
WITH d AS {_ROWS}
SELECT min(b.frame_id) AS first_frame_id, a.frame_id FROM d a JOIN d b ON a.session_id = b.session_id AND round(list_cosine_similarity(a.v, b.v), 6) >= 0.85
GROUP BY a.frame_id HAVING min(b.frame_id) < a.frame_id""",
    "p1_weighted": rf"""
WITH t AS (SELECT id, unnest(regexp_extract_all(lower(concat_ws(' ', name, text)), '[\p{{L}}\p{{N}}]+')) AS w FROM ({_NEWEST}) WHERE len({_WORDS}) >= 8),
n AS (SELECT id, w, count(*) AS c FROM t GROUP BY ALL),
d AS (SELECT id, list(w || '#' || o) AS w FROM (SELECT id, w, unnest(range(c)) AS o FROM n) GROUP BY id),
pairs AS (SELECT a.id AS id_a, b.id AS id_b, len(a.w) AS na, len(b.w) AS nb, len(list_intersect(a.w, b.w)) AS c
          FROM d a JOIN d b ON a.id < b.id AND len(a.w) >= 0.7 * len(b.w) - 1e-9 AND len(b.w) >= 0.7 * len(a.w) - 1e-9)
SELECT id_a, id_b FROM pairs WHERE c / (na + nb - c)::double >= 0.7 - 1e-9""",
    "p7_edited": r"""
WITH texts AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL
     UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM eval_items WHERE item_id IS NOT NULL),
word AS (SELECT kind, id, generate_subscripts(w, 1) AS k, unnest(w) AS word FROM texts),
spot AS (SELECT kind, id, k, 1 + coalesce(sum(length(word) + 1) OVER (PARTITION BY kind, id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
     word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o AS gram, length(word) AS n FROM word WINDOW o AS (PARTITION BY kind, id ORDER BY k)),
whole AS (SELECT kind, id, array_to_string(w, ' ') AS t FROM texts),
run AS (SELECT a.id AS item_id, substring(t, a.pos::bigint, (z.pos + z.n - a.pos)::bigint) AS run, a.k, a.pos FROM spot a JOIN spot z ON a.kind = 'i' AND z.kind = 'i' AND a.id = z.id AND z.k = a.k + 11 JOIN whole w ON w.kind = 'i' AND w.id = a.id),
probe AS (SELECT item_id, run, gram, g.pos - run.pos AS shift FROM run JOIN spot g ON g.kind = 'i' AND g.id = item_id AND g.k IN (run.k + 1, run.k + 7)),
start AS (SELECT DISTINCT d.id AS doc_id, item_id, run, (d.pos - shift)::bigint AS pos FROM probe JOIN spot d ON d.kind = 'd' AND d.gram = probe.gram),
tried AS (SELECT doc_id, item_id, levenshtein(run, substring(t, greatest(1, pos + s), length(run) + l)) AS edits
     FROM start JOIN whole w ON w.kind = 'd' AND w.id = doc_id, (SELECT unnest([-1, 0, 1]) AS s), (SELECT unnest([-1, 0, 1]) AS l) WHERE pos + s >= 1)
SELECT doc_id, item_id, min(edits)::int AS edits FROM tried WHERE edits <= 1 GROUP BY ALL""",
}
