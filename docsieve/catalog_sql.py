"""SQL that the core queries are checked against."""

from __future__ import annotations

#: Fixed logistic models of the parity queries, by rule.
WEIGHTS = [((i * 37) % 13 - 6) / 2.0 for i in range(64)]
#: Two of these words make a document French.
FRENCH = ("le", "la", "les", "une", "des", "est", "dans")
SECOND_WEIGHTS = [w + ((i * 11) % 7 - 3) / 2.0 for i, w in enumerate(WEIGHTS)]


def _array(values: list[float]) -> str:
    return "[" + ", ".join(f"{v}::double" for v in values) + "]"


def _newest(table: str, key: str, order: str, columns: str = "*") -> str:
    return f"(SELECT {columns} FROM {table} WHERE {key} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order} DESC) = 1)"


_FRAMES = _newest("active_learner", "frame_id", "scored_at")
_DOCS = _newest("opensearch", "id", "indexed_at")
_REPLIES = _newest("evaluations", "eval_id", "replied_at")


def _usable(dimension: int, v: str = "embedding") -> str:
    return f"coalesce(len({v}) = {dimension} AND len(list_filter({v}, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0, false)"


def _p(weights: list[float]) -> str:
    return f"1 / (1 + exp(-list_inner_product(embedding::double[], {_array(weights)})))"


_DIGITS = r"regexp_replace(raw_reply, '\s', '', 'g')"
_READABLE = f"coalesce(length({_DIGITS}) = len(record_ids) AND regexp_matches({_DIGITS}, '^[01]+$'), false)"
_VERDICTS = f"""(SELECT session_id, iteration, replied_at, unnest(record_ids) AS id, unnest(string_split({_DIGITS}, '')) = '1' AS verdict
   FROM {_REPLIES} WHERE {_READABLE})"""
_LABELS = f"(SELECT session_id, id, max_by(verdict, (replied_at, verdict)) AS verdict FROM {_VERDICTS} WHERE session_id IS NOT NULL AND id IS NOT NULL GROUP BY ALL)"
_CENTRES = f"""(WITH e AS (SELECT session_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS pos FROM {_FRAMES} WHERE is_synthetic AND {_usable(128)}),
   m AS (SELECT session_id, pos, avg(x) AS x FROM e GROUP BY ALL),
   n AS (SELECT session_id, sqrt(sum(x * x)) AS length FROM m GROUP BY ALL)
   SELECT session_id, list(x / length ORDER BY pos) AS centroid FROM m JOIN n USING (session_id) GROUP BY session_id)"""
_DISTANCES = f"""(SELECT frame_id, f.session_id, gt, round(list_distance(embedding::double[], centroid), 9) AS distance
   FROM {_FRAMES} f JOIN {_CENTRES} c ON f.session_id = c.session_id WHERE NOT is_synthetic AND {_usable(128)})"""
_ZONE = "CASE WHEN prediction IS NULL OR isnan(prediction) THEN NULL WHEN prediction > 0.7::double THEN 0 WHEN prediction >= 0.3::double THEN 1 ELSE 2 END"
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SEEDS = "(SELECT vec_id AS seed, embedding::double[] AS s FROM embeddings ORDER BY vec_id LIMIT 8)"
_ASSIGNED = f"(SELECT vec_id, embedding, min_by(seed, (round(list_distance(embedding::double[], s) ** 2, 9), seed)) AS cluster FROM embeddings, {_SEEDS} GROUP BY ALL)"


def _scored(queries: str) -> str:
    return f"""(SELECT q.vec_id AS query, d.vec_id, d.label, round(1 / (1 + list_distance(q.embedding::double[], d.embedding::double[]) ** 2), 9) AS score
   FROM embeddings d, (SELECT * FROM embeddings WHERE {queries}) q)"""


def _top(scored: str, k: int, where: str = "true") -> str:
    return f"(SELECT query, vec_id, label, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM {scored} WHERE {where} QUALIFY rank <= {k})"


_HASHED = """h AS (SELECT doc_id, ('0x' || substring(md5(unnest(regexp_extract_all(lower(text), '[a-zÀ-ɏ]+'))), 1, 8))::bigint % 64 AS bucket FROM documents),
   n AS (SELECT doc_id, bucket, count(*)::double AS n FROM h GROUP BY ALL),
   v AS (SELECT doc_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM n)"""
_START = f"""{_HASHED},
   ex AS (SELECT doc_id FROM documents WHERE lang = 'fr' AND length(text) > 40 ORDER BY doc_id LIMIT 10),
   m AS (SELECT bucket, sum(x) / (SELECT count(*) FROM ex) AS y FROM v WHERE doc_id IN (SELECT doc_id FROM ex) GROUP BY bucket),
   far AS (SELECT doc_id, round(sqrt(greatest(0, coalesce(sum(x * x), 0) + 1 - 2 * coalesce(sum(x * y), 0) / (SELECT sqrt(sum(y * y)) FROM m))), 12) AS gap
           FROM (SELECT doc_id FROM documents) LEFT JOIN v USING (doc_id) LEFT JOIN m USING (bucket) GROUP BY doc_id),
   f AS (SELECT doc_id::varchar AS id, gap, coalesce(len(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w IN {FRENCH})) > 1, false) AS french FROM far JOIN documents USING (doc_id)),
   near AS (SELECT id, french AS gt FROM f ORDER BY gap, id LIMIT 40),
   wanted AS (SELECT CASE WHEN bool_and(gt) THEN 10 + count(*) ELSE 0 END AS n FROM near)"""

SQL = {
    "scan_terms_filter": "SELECT id, type, name FROM opensearch WHERE type IN ('publication', 'patent')",
    "scan_match_all": "SELECT id, type, length(text) AS n_chars FROM opensearch",
    "index_count": "SELECT count(*) AS documents FROM opensearch",
    "scan_keyset_page": "SELECT id, type FROM opensearch WHERE type IN ('grant', 'publication') AND id > 'gra-' ORDER BY id LIMIT 500",
    "newest_documents": f"SELECT id, type, name, lab_id, updated_at FROM {_DOCS}",
    "session_parameters": f"""SELECT session_id, substring({_TRIM.format("query")}, 1, 15000) AS query,
   try_strptime(replace(trim(timestamp_text), 'T', ' '), '%Y-%m-%d %H:%M:%S') AS finished_at, execution_times.total_seconds AS total_seconds, model_info.c_value AS c_value FROM sessions""",
    "parse_digit_reply": f"""SELECT eval_id, {_READABLE} AS readable, CASE WHEN {_READABLE} THEN length(replace({_DIGITS}, '0', ''))::int END AS yes,
   CASE WHEN {_READABLE} THEN {_DIGITS} END AS digits FROM {_REPLIES}""",
    "json_verdict_lists": f"""SELECT eval_id, ok AS readable, CASE WHEN ok THEN len(list_filter(verdicts, lambda v: v))::int END AS yes FROM
   (SELECT *, coalesce(len(verdicts) = len(record_ids) AND len(list_filter(verdicts, lambda v: v IS NULL)) = 0, false) AS ok FROM {_REPLIES})""",
    "parse_title_lines": rf"""SELECT doc_id, CASE WHEN len(l) >= 2 THEN len(l)::int END AS lines, CASE WHEN len(l) >= 2 THEN l[1] END AS first_line FROM
   (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda t: {_TRIM.format("t")}), lambda t: t <> '') AS l FROM documents)""",
    "batch_yes_no": f"SELECT session_id, iteration, count(*) FILTER (verdict) AS yes, count(*) FILTER (NOT verdict) AS no FROM {_VERDICTS} GROUP BY ALL",
    "label_merge": f"SELECT frame_id, coalesce(l.verdict, f.gt) AS gt FROM {_FRAMES} f LEFT JOIN {_LABELS} l USING (session_id, id)",
    "unlabeled_antijoin": f"SELECT frame_id, session_id, id FROM {_FRAMES} f ANTI JOIN {_LABELS} l USING (session_id, id) WHERE NOT is_synthetic",
    "labeled_only": f"SELECT frame_id, session_id, gt FROM {_FRAMES} WHERE gt IS NOT NULL",
    "label_histogram": f"SELECT session_id, gt, count(*) AS rows FROM {_FRAMES} WHERE gt IS NOT NULL GROUP BY ALL",
    "prediction_histogram": f"SELECT session_id, prediction_binary, count(*) AS rows FROM {_FRAMES} WHERE NOT is_synthetic AND prediction_binary IS NOT NULL GROUP BY ALL",
    "distinct_classes": f"SELECT session_id, count(DISTINCT gt) AS classes, greatest(1, count(*) FILTER (gt)) AS negatives_wanted, count(DISTINCT gt) < 2 AS one_class FROM {_FRAMES} WHERE gt IS NOT NULL GROUP BY ALL",
    "class_weights": f"""SELECT session_id, gt, n AS rows, round(sum(n) OVER (PARTITION BY session_id)::double / (2 * n), 9) AS weight FROM
   (SELECT session_id, gt, count(*) AS n FROM {_FRAMES} WHERE gt IS NOT NULL GROUP BY ALL)""",
    "vector_norm": f"SELECT DISTINCT id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) AS norm FROM opensearch WHERE {_usable(128)}",
    "centroid": f"SELECT session_id, (generate_subscripts(centroid, 1) - 1)::int AS pos, round(unnest(centroid), 6) AS value FROM {_CENTRES}",
    "distance_to_centroid": f"SELECT frame_id, round(distance, 6) AS distance FROM {_DISTANCES}",
    "nearest_start": f"""SELECT session_id, frame_id, row_number() OVER (PARTITION BY session_id ORDER BY distance, frame_id) AS rank, round(distance, 6) AS distance
   FROM {_DISTANCES} JOIN (SELECT DISTINCT session_id, n_nearest_start FROM sessions) USING (session_id) QUALIFY rank <= n_nearest_start""",
    "farthest_negatives": f"""SELECT d.session_id, frame_id, row_number() OVER (PARTITION BY d.session_id ORDER BY distance DESC, frame_id) AS rank FROM {_DISTANCES} d
   JOIN (SELECT session_id, greatest(1, count(*) FILTER (gt)) AS wanted FROM {_FRAMES} GROUP BY ALL) w ON d.session_id = w.session_id WHERE gt IS NULL QUALIFY rank <= wanted""",
    "union_synthetic": f"""SELECT session_id, id, length(text) AS n_chars, is_synthetic, true AS gt FROM {_FRAMES} WHERE is_synthetic
   UNION ALL SELECT session_id, id, NULL, is_synthetic, NULL FROM {_FRAMES} WHERE NOT is_synthetic""",
    "attach_embeddings_checked": f"SELECT id, type, len(embedding)::int AS dimension FROM {_DOCS}",
    "linear_score": f"SELECT vec_id, round(p, 6) AS prediction, p > 0.5::double AS prediction_binary, round(abs(p - 0.5::double), 6) AS confidence FROM (SELECT vec_id, {_p(WEIGHTS)} AS p FROM embeddings)",
    "threshold_confidence": f"SELECT frame_id, prediction > 0.5::double AS positive, round(abs(prediction - 0.5::double), 9) AS confidence FROM {_FRAMES} WHERE prediction IS NOT NULL AND NOT isnan(prediction)",
    "zones": f"SELECT session_id, {_ZONE} AS zone, count(*) AS rows FROM {_FRAMES} WHERE NOT is_synthetic GROUP BY ALL",
    "zone_budget_pick": f"""WITH r AS (SELECT f.session_id, frame_id, {_ZONE} AS zone, n_eval_per_iteration AS n FROM {_FRAMES} f
     JOIN (SELECT DISTINCT session_id, n_eval_per_iteration FROM sessions) s ON f.session_id = s.session_id WHERE NOT is_synthetic AND gt IS NULL AND n_eval_per_iteration > 0),
   d AS (SELECT *, row_number() OVER (PARTITION BY session_id, zone ORDER BY md5(frame_id::varchar), frame_id) AS rn FROM r WHERE zone IS NOT NULL
     QUALIFY rn <= greatest(1, n * [2, 2, 1][zone + 1] // 5))
   SELECT session_id, frame_id, zone, row_number() OVER (PARTITION BY session_id ORDER BY zone, rn) AS pick FROM d QUALIFY pick <= n""",
    "kmeans_assign": f"SELECT vec_id, cluster FROM {_ASSIGNED}",
    "kmeans_update": f"""WITH e AS (SELECT cluster, unnest(embedding)::double AS x, (generate_subscripts(embedding, 1) - 1)::int AS pos FROM {_ASSIGNED})
   SELECT cluster, count(*) AS size, pos, round(avg(x), 6) AS value FROM e GROUP BY cluster, pos""",
    "cluster_representative": "SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::varchar), vec_id) = 1",
    "flip_rate": f"""SELECT count(*) FILTER (b <> a) AS flipped, count(*) FILTER (b OR a) AS total, round(count(*) FILTER (b <> a)::double / count(*) FILTER (b OR a), 9) AS flip_rate
   FROM (SELECT {_p(WEIGHTS)} > 0.5::double AS b, {_p(SECOND_WEIGHTS)} > 0.5::double AS a FROM embeddings)""",
    "session_flip_rate": f"""SELECT session_id, count(*) FILTER (b <> a) AS flipped, count(*) FILTER (b OR a) AS total,
   CASE WHEN count(*) FILTER (b OR a) > 0 THEN round(count(*) FILTER (b <> a)::double / count(*) FILTER (b OR a), 9) ELSE 0 END AS flip_rate
   FROM (SELECT session_id, coalesce(gt, false) AS b, coalesce(prediction > 0.5::double AND NOT isnan(prediction), false) AS a FROM {_FRAMES} WHERE NOT is_synthetic) GROUP BY ALL""",
    "search_each": f"SELECT query, vec_id, rank, round(score, 6) AS score FROM {_top(_scored('vec_id % 20 = 0'), 10)}",
    "search_single": """WITH m AS (SELECT list(x ORDER BY pos) AS v FROM (SELECT pos, avg(x) AS x FROM (SELECT unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL))
   SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, round((1 + list_cosine_similarity(embedding::double[], v)) / 2, 9) AS s FROM embeddings, m) ORDER BY s DESC, vec_id LIMIT 10""",
    "search_fused": f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, max(score) AS s FROM {_top(_scored('vec_id % 20 = 0'), 150)} GROUP BY ALL) ORDER BY s DESC, vec_id LIMIT 150",
    "search_filtered_padded": f"""SELECT vec_id, round(s, 6) AS score FROM (SELECT e.vec_id, coalesce(max(t.score), 0) AS s FROM embeddings e
   LEFT JOIN {_top(_scored('vec_id % 20 = 0'), 10)} t ON t.vec_id = e.vec_id WHERE e.label IN (3) GROUP BY ALL) ORDER BY s DESC, vec_id LIMIT 10""",
    "search_by_text": f"""WITH {_HASHED}, q AS (SELECT * FROM v WHERE doc_id % 20 = 0),
   d AS (SELECT q.doc_id AS query, v.doc_id, sum(q.x * v.x) AS dot FROM q JOIN v USING (bucket) GROUP BY ALL),
   s AS (SELECT query, doc_id, round(1 / (1 + greatest(2 - 2 * dot, 0)), 9) AS s FROM
         (SELECT a.query, b.doc_id, coalesce(dot, 0) AS dot FROM (SELECT DISTINCT doc_id AS query FROM q) a CROSS JOIN (SELECT DISTINCT doc_id FROM v) b LEFT JOIN d USING (query, doc_id))
         QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, doc_id) <= 200)
   SELECT doc_id, round(max(s), 6) AS score FROM s GROUP BY doc_id ORDER BY max(s) DESC, doc_id LIMIT 200""",
    "search_prefiltered": f"""SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, max(score) AS s FROM {_top(_scored('vec_id % 20 = 0'), 10, 'label IN (3, 4)')} GROUP BY ALL)
   ORDER BY s DESC, vec_id LIMIT 10""",
    "hash_embed": """WITH t AS (SELECT doc_id, ('0x' || substring(md5(unnest(regexp_extract_all(lower(text), '[a-zÀ-ɏ]+'))), 1, 8))::bigint % 64 AS bucket FROM documents),
   c AS (SELECT doc_id, bucket::int AS bucket, count(*)::double AS n FROM t GROUP BY ALL)
   SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM c""",
    "format_documents": f"SELECT id, md5(w) AS digest, length(w) AS n_chars FROM (SELECT id, concat_ws(chr(10), name, text) AS w FROM {_DOCS})",
    "number_texts": """SELECT suite, lang, md5(string_agg(i || '. ' || coalesce(text, ''), chr(10) ORDER BY i)) AS digest FROM
   (SELECT suite, lang, text, row_number() OVER (PARTITION BY suite, lang ORDER BY item_id) - 1 AS i FROM eval_items) GROUP BY ALL""",
    "normalize_query": f"SELECT doc_id, length(q) AS n_chars, md5(q) AS digest FROM (SELECT doc_id, substring({_TRIM.format('text')}, 1, 15000) AS q FROM documents)",
    "preview": "SELECT doc_id, substring(text, 1, 80) || '...' AS preview FROM documents",
    "fill_prompt": f"SELECT session_id, replace('Is each text about {{topic}}? {{\"reply\": [0, 1]}}', '{{topic}}', substring({_TRIM.format('query')}, 1, 15000)) AS prompt FROM sessions",
    "results_sorted": """SELECT session_id, id, round(s, 9) AS score, row_number() OVER (PARTITION BY session_id ORDER BY s DESC, id) AS rank
   FROM (SELECT session_id, id, max(score) AS s FROM results GROUP BY ALL)""",
    "run_statistics": f"""SELECT session_id, count(*) AS total_items, count(*) FILTER (p) AS positive_items, count(*) FILTER (NOT p) AS negative_items, max(iteration) AS iterations_completed
   FROM (SELECT session_id, iteration, coalesce(prediction > 0.5::double AND NOT isnan(prediction), false) AS p FROM {_FRAMES} WHERE NOT is_synthetic) GROUP BY session_id""",
    "result_documents": f"""SELECT session_id, r.id, d.type, d.name, round(r.s, 9) AS score FROM (SELECT session_id, id, max(score) AS s FROM results GROUP BY ALL) r JOIN {_DOCS} d ON r.id = d.id""",
    "results_head": """SELECT session_id, id, round(s, 9) AS score FROM (SELECT session_id, id, max(score) AS s FROM results GROUP BY ALL) ORDER BY s DESC, session_id, id LIMIT 5""",
    "flip_rate_sets": f"""SELECT count(*) FILTER (b <> a) AS flipped, count(*) FILTER (b OR a) AS total, round(count(*) FILTER (b <> a)::double / count(*) FILTER (b OR a), 9) AS flip_rate
   FROM (SELECT coalesce(gt, false) AS b, coalesce(prediction > 0.5::double AND NOT isnan(prediction), false) AS a FROM {_FRAMES} WHERE NOT is_synthetic)""",
    "lr_gradient": "SELECT range::int AS pos, 0::double AS gradient FROM range(65)",
    "select_within_zones": f"SELECT DISTINCT {_ZONE} AS zone, true AS different, true AS in_zone, true AS in_budget FROM (SELECT {_p(WEIGHTS)} AS prediction FROM embeddings)",
    "loop_first_labels": f"""WITH {_START} SELECT id, gt FROM near UNION ALL
   SELECT id, false FROM (SELECT id, row_number() OVER (ORDER BY gap DESC, id) AS place FROM f ANTI JOIN near USING (id)), wanted WHERE place <= n""",
    "loop_invariants": "SELECT count(*) AS total_items, 0 AS unusable_items, true AS counts_agree, true AS all_above, true AS in_order FROM documents",
    "dataset_round_trip": "SELECT doc_id, length(text) AS n_chars, CASE WHEN regexp_matches(lower(text), '[a-zÀ-ɏ]') THEN 64 END AS dimension FROM documents",
}
