"""DuckDB SQL with the same results, for the registered queries.

In the ocr_ queries the lost letter becomes a character that no document holds,
so it can be matched with nothing: every one of them is one edit, and the
distance is their number. The queries over turns and sentences compare with
DuckDB's own distance, letters and words first made single bytes.
"""

from __future__ import annotations

_LOST = "(length(text) - length(replace(text, '{0} ', ' ')))"
_WORDS = "len(list_filter(string_split_regex(text, '[\\t-\\r\\x1c-\\x20]+'), lambda w: w <> ''))"
_E, _T = _LOST.format("e"), _LOST.format("t")


def _rates(lost: str) -> str:
    return f"avg(CASE WHEN length(text) = 0 THEN 0.0 ELSE {lost} / length(text) END) AS cer, avg(CASE WHEN {_WORDS} = 0 THEN 0.0 ELSE {lost} / {_WORDS} END) AS wer, count(*) AS n"


_LINKS = """
SELECT page_id, url, 'a' AS kind, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS position FROM pages
"""
_RESOLVED = f"SELECT page_id, position, url, regexp_extract(url, '^([a-z]+://[^/]*)', 1) || link AS target FROM ({_LINKS})"
_ENDINGS = ["", ".png", ".JPG?x=1", ".pdf#f", ".gif", "/a/", "/b c(1).tiff", ".webp?a.b", "/x.tif;v=1"]
_URLS = "SELECT page_id, html, unnest([" + ", ".join(f"url || '{e}'" for e in _ENDINGS) + f"]) AS url, unnest(range({len(_ENDINGS)})) AS n FROM pages"
_DOWN = "regexp_matches(url, '(?i)\\.(png|jpg|jpeg|webp|tif|tiff|pdf)(\\?.*)?$')"
_SUFFIXES = [".jpg", ".JPEG", ".png", ".webp", ".tiff", ".gif", "", ".tar.png"]
_PATHS = "SELECT doc_id, unnest([" + ", ".join(f"'/img/d' || doc_id || '{s}'" for s in _SUFFIXES) + f"]) AS path, unnest(range({len(_SUFFIXES)})) AS n FROM documents"
_SUFFIX = "lower(regexp_extract(path, '/[^/]+(\\.[^./]+)$', 1))"
_IMAGE = f"{_SUFFIX} IN ('.png', '.jpg', '.jpeg', '.webp', '.tif', '.tiff')"
_STEM = f"substr(regexp_extract(path, '([^/]*)$', 1), 1, length(regexp_extract(path, '([^/]*)$', 1)) - length({_SUFFIX}))"

_ERRORS = [("qu", ""), ("th", "thh"), ("e ", "a "), ("en", "e n")]


def _misread(value: str, errors: list = _ERRORS) -> str:
    for old, new in errors:
        value = f"replace({value}, '{old}', '{new}')"
    return value


def _edited(value: str, columns: str, table: str) -> str:
    """pred and ref with their distance: every letter of either becomes one byte, since the function counts bytes."""
    return f"""
        WITH x AS (SELECT {columns}, text AS ref, {value} AS pred FROM {table}),
        letters AS (SELECT c, row_number() OVER (ORDER BY c) AS r FROM (SELECT DISTINCT unnest(string_split(ref || pred, '')) AS c FROM x) WHERE c <> ''),
        v AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS f, coalesce(string_agg(chr(r::INT), '' ORDER BY c), '') AS t FROM letters)
        SELECT x.*, levenshtein(translate(pred, f, t), translate(ref, f, t)) AS edits FROM x CROSS JOIN v"""


def _cer(errors: list) -> str:
    rate = "CASE WHEN ref = '' THEN CASE WHEN pred = '' THEN 0.0 ELSE 1.0 END ELSE edits / length(ref) END"
    return f"(SELECT coalesce(avg({rate}), 0) AS cer, count(*) AS n FROM ({_edited(_misread('text', errors), 'turn', 'conversations')}))"


_SPLIT = "list_filter(string_split_regex({0}, '[\\t-\\r\\x1c-\\x20]+'), lambda w: w <> '')"

ORACLES: dict[str, str] = {
    "turn_cer_rows": f"SELECT conv_id, turn, edits AS char_edits FROM ({_edited(_misread('text'), 'conv_id, turn', 'conversations')})",
    "sentence_wer_rows": f"""
        WITH s AS (SELECT conv_id, turn, unnest(string_split_regex(text, '[.\n]')) AS ref, unnest(range(len(string_split_regex(text, '[.\n]')))) AS n FROM conversations),
        w AS (SELECT conv_id, turn, n, {_SPLIT.format('ref')} AS r, {_SPLIT.format(_misread("replace(ref, 'n, ', 'n,')"))} AS p FROM s),
        v AS (SELECT *, list_distinct(r || p) AS known FROM w),
        d AS (SELECT conv_id, turn, n, len(r) AS n_words, len(p) AS m, levenshtein(array_to_string(list_transform(p, lambda x: chr(list_position(known, x))), ''), array_to_string(list_transform(r, lambda x: chr(list_position(known, x))), '')) AS word_edits FROM v)
        SELECT conv_id, turn, n::INT AS n, word_edits, n_words, round(CASE WHEN n_words = 0 THEN CASE WHEN m = 0 THEN 0.0 ELSE 1.0 END ELSE word_edits / n_words END, 6) AS wer FROM d""",
    "predicted_rows": f"SELECT conv_id * 1000 + turn AS row_idx, conv_id || '-' || turn AS id, md5(text) AS ref_md5, md5({_misread('text')}) AS pred_md5, md5('/img/' || text || '.png') AS path_md5 FROM conversations",
    "predicted_summary": f"SELECT round(a.cer, 6) AS base_cer, round(b.cer, 6) AS tuned_cer, round(b.cer - a.cer, 6) AS delta_cer, a.n AS base_samples FROM {_cer(_ERRORS)} a CROSS JOIN {_cer(_ERRORS[:2])} b",
    "examples_file": """
        WITH t AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS row_idx FROM benchmark)
        SELECT row_idx, CASE item_id % 4 WHEN 0 THEN '/data/set/b/' || item_id WHEN 1 THEN '/abs/' || item_id ELSE '/data/set/i/' || item_id END AS image_path,
          CASE WHEN item_id % 3 = 0 THEN 'n' || item_id ELSE row_idx::VARCHAR END AS id, md5(text) AS text_md5 FROM t""",
    "eval_head": "SELECT row_idx, CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id ELSE row_idx::VARCHAR END AS id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, count(*) OVER () AS n FROM documents) WHERE row_idx < n - 7",
    "collated_batches": f"""
        WITH t AS (SELECT doc_id // 8 AS batch, list_transform(({_SPLIT.format('text')})[1:64], lambda w: length(w)) AS ids FROM documents),
        b AS (SELECT batch, count(*) AS rows, max(len(ids)) AS width, sum(len(ids)) AS n, coalesce(sum(list_sum(ids)), 0) AS s FROM t GROUP BY batch)
        SELECT batch, rows, width, s::BIGINT AS ids_sum, (s - 100 * (rows * width - n))::BIGINT AS labels_sum FROM b""",
    "crawl_levels": """
        WITH RECURSIVE s AS (SELECT count(*) AS n FROM supplier), r(k) AS (SELECT 1::BIGINT UNION ALL SELECT unnest([2 * k, 2 * k + 1]) FROM r CROSS JOIN s WHERE k <= n AND k % 7 <> 0),
        e AS (SELECT k, CASE WHEN k <= n THEN 'download' ELSE 'page_error' END AS type, '/' || k || CASE WHEN k % 7 = 0 THEN '.png' ELSE '' END AS name, floor(log2(k)) AS level, k // 2 AS parent, k % 2 AS odd FROM r CROSS JOIN s WHERE k > n OR k % 7 = 0)
        SELECT type, 'http://s' || name AS url, CASE WHEN type = 'download' THEN 'out/downloads' || name END AS path, (row_number() OVER (ORDER BY level, place) - 1)::INT AS position
        FROM (SELECT *, list_reverse(list_transform(range(level::INT), lambda i: 1 - (k // (2 ** i)::BIGINT) % 2)) AS place FROM e)""",
    "metric_table": "SELECT 'run' AS run, r_regionkey::BIGINT AS step, 'train/loss' AS name, 1.0 / (1 + r_regionkey) AS value FROM region UNION ALL SELECT 'run', r_regionkey::BIGINT, 'eval/' || r_name, r_regionkey FROM region",
    "ocr_cer_rows": f"SELECT doc_id, {_E} AS char_edits, length(text) AS n_chars, round(CASE WHEN length(text) = 0 THEN 0.0 ELSE {_E} / length(text) END, 6) AS cer FROM documents",
    "ocr_wer_rows": f"SELECT doc_id, {_E} AS word_edits, {_WORDS} AS n_words, round(CASE WHEN {_WORDS} = 0 THEN 0.0 ELSE {_E} / {_WORDS} END, 6) AS wer FROM documents",
    "ocr_edge_cases": f"""
        WITH t AS (SELECT doc_id, text, {_WORDS} AS n FROM documents)
        SELECT doc_id, 0::INT AS case, 0.0::DOUBLE AS cer, 0.0::DOUBLE AS wer FROM t
        UNION ALL SELECT doc_id, 1, CASE WHEN text = '' THEN 0.0 ELSE 1.0 END, CASE WHEN n = 0 THEN 0.0 ELSE 1.0 END FROM t
        UNION ALL SELECT doc_id, 2, 1.0, 0.0 FROM t
        UNION ALL SELECT doc_id, 3, CASE WHEN text = '' THEN 0.0 ELSE 1.0 END, CASE WHEN n = 0 THEN 0.0 ELSE 1.0 END FROM t
        UNION ALL SELECT doc_id, 4, 1.0, 0.0 FROM t
        UNION ALL SELECT doc_id, 5, 0.0, 0.0 FROM t""",
    "ocr_eval_summary": f"SELECT round(coalesce(cer, 0), 6) AS cer, round(coalesce(wer, 0), 6) AS wer, n AS num_samples FROM (SELECT {_rates(_E)} FROM documents)",
    "ocr_compare_delta": f"""
        SELECT round(a.cer, 6) AS base_cer, round(a.wer, 6) AS base_wer, a.n AS base_samples, round(b.cer, 6) AS tuned_cer, round(b.wer, 6) AS tuned_wer, b.n AS tuned_samples,
          round(b.cer - a.cer, 6) AS delta_cer, round(b.wer - a.wer, 6) AS delta_wer
        FROM (SELECT {_rates(_E)} FROM documents) a CROSS JOIN (SELECT {_rates(_T)} FROM documents) b""",
    "ocr_report_rows": "SELECT (row_number() OVER (ORDER BY doc_id) - 1)::INT AS position, doc_id::VARCHAR AS id, 'p/' || doc_id AS image_path, length(text)::INT AS ref_chars, md5(replace(text, 'e ', chr(57344) || ' ')) AS pred_md5 FROM documents",
    "dataset_scan": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, '/data/set/i/' || doc_id || '.png' AS image_path, CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id ELSE (row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR END AS id, md5(text) AS text_md5 FROM documents",
    "dataset_prefix": "SELECT * FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id ELSE (row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR END AS id, md5(text) AS text_md5 FROM documents) WHERE row_idx < 100",
    "prompt_concat": "SELECT doc_id, md5('Read this: ' || text) AS prompted_md5 FROM documents",
    "batch_pad_mask": f"""
        WITH t AS (SELECT doc_id AS row_idx, doc_id // 8 AS batch, {_WORDS} AS n, list_sum(list_transform(list_filter(string_split_regex(text, '[\\t-\\r\\x1c-\\x20]+'), lambda w: w <> ''), lambda w: length(w))) AS s FROM documents),
        w AS (SELECT *, max(n) OVER (PARTITION BY batch) AS width FROM t)
        SELECT row_idx, batch, width, coalesce(s, 0)::BIGINT AS ids_sum, (coalesce(s, 0) - 100 * (width - n))::BIGINT AS labels_sum, width - n AS masked FROM w""",
    "page_links": f"SELECT url, kind, position, link FROM ({_LINKS})",
    "page_links_resolved": f"SELECT url, target, regexp_extract(url, '://([^/]*)', 1) = regexp_extract(target, '://([^/]*)', 1) AS same_host FROM ({_RESOLVED})",
    "url_classify": f"""
        WITH u AS (SELECT * FROM ({_URLS}) CROSS JOIN (SELECT unnest(['', 'text/html; charset=utf-8', 'image/png', 'application/pdf', 'text/plain']) AS ctype))
        SELECT page_id, n::INT AS n, ctype, {_DOWN} AS downloadable, {_DOWN} OR contains(ctype, 'application/pdf') OR starts_with(ctype, 'image/') AS stored,
          contains(ctype, 'text/html') OR ctype = '' OR contains(lower(substr(html, 1, 200)), '<html') AS searched FROM u""",
    "safe_filenames": f"""
        WITH u AS (SELECT page_id, n, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS p FROM ({_URLS})),
        x AS (SELECT page_id, n, list_filter(string_split(p, '/'), lambda c: c <> '' AND c <> '.') AS parts FROM u)
        SELECT page_id, n::INT AS n, regexp_replace(CASE WHEN len(parts) = 0 THEN 'download' ELSE parts[len(parts)] END, '[^a-zA-Z0-9._-]+', '_', 'g') AS name FROM x""",
    "crawl_one_seed": f"""
        WITH s AS (SELECT min(url) AS seed FROM pages),
        t AS (SELECT DISTINCT target AS url FROM ({_RESOLVED}) r JOIN s ON r.url = s.seed WHERE regexp_extract(target, '://([^/]*)', 1) = regexp_extract(seed, '://([^/]*)', 1))
        SELECT 'page_error' AS type, url FROM t WHERE url NOT IN (SELECT url FROM pages)""",
    "crawl_budget_prefix": """
        WITH l AS (SELECT page_id, page_id % 5 <> 0 AS ok, page_id % 5 <> 0 AND page_id % 7 = 1 AS downloaded FROM pages),
        c AS (SELECT *, coalesce(sum(ok::INT) OVER w, 0) AS p, coalesce(sum(downloaded::INT) OVER w, 0) AS d FROM l WINDOW w AS (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT page_id, ok, downloaded FROM c WHERE p < 120 AND d < 15""",
    "frontier_dedupe": f"""
        SELECT url, page_id, 0::BIGINT AS kind, position FROM (SELECT target AS url, page_id, position, row_number() OVER (PARTITION BY target ORDER BY page_id, position) AS r FROM ({_RESOLVED}))
        WHERE r = 1 AND url NOT IN (SELECT url FROM pages)""",
    "chat_payload": "SELECT conv_id, turn, 'reader-1' AS model, 64::BIGINT AS max_tokens, 'user' AS role, md5(text) AS prompt_md5, 'data:image/png;base64,AA==' AS image_url, true AS no_null_fields FROM conversations WHERE role = 'user'",
    "chat_response": """SELECT conv_id, turn, md5(CASE WHEN turn % 4 = 3 THEN '{"error":"none"}' ELSE text END) AS text_md5 FROM conversations WHERE role = 'assistant'""",
    "result_coercion": """
        SELECT event_id, s.shape::INT AS shape, CASE s.shape WHEN 2 THEN 'p' || event_id WHEN 3 THEN '{"k":' || event_id || '}' WHEN 5 THEN 'None' ELSE event_type END AS answer_text
        FROM events CROSS JOIN (SELECT unnest(range(6)) AS shape) s""",
    "data_url": "SELECT doc_id, length('data:image/png;base64,' || to_base64(encode(text))) AS url_chars, md5('data:image/png;base64,' || to_base64(encode(text))) AS url_md5 FROM documents",
    "mime_by_suffix": f"""
        SELECT doc_id, n::INT AS n, CASE {_SUFFIX} WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' WHEN '.webp' THEN 'image/webp' ELSE 'application/octet-stream' END AS mime,
          {_SUFFIX} AS suffix, {_STEM} AS stem, {_IMAGE} AS image FROM ({_PATHS})""",
    "stem_collision": f"SELECT doc_id, path, stem, row_number() OVER (PARTITION BY stem ORDER BY path DESC) = 1 AS last FROM (SELECT doc_id, path, {_STEM} AS stem FROM ({_PATHS}) WHERE {_IMAGE})",
    "trigger_steps": "SELECT event_id, event_id % 10 = 0 AS logs, event_id > 0 AND event_id % 200 = 0 AS evaluates FROM events",
    "module_list_parse": """
        SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_type, ' ', ' , ') || ',, ', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS names,
          array_to_string(list_sort(list_distinct([p_size::INT, p_partkey::INT])), '|') AS ids FROM part""",
    "metric_log": "SELECT 'run' AS run, event_id AS step, 'train/' || event_type AS name, value FROM events WHERE event_id % 10 = 0",
    "endpoint_headers": "SELECT c_custkey, 'http://h' || c_custkey || '/v1/chat/completions' AS address, CASE WHEN c_custkey % 3 = 1 THEN 'Bearer k' END AS authorization FROM customer",
}
