"""DuckDB SQL with the columns and rows of the named queries."""

from __future__ import annotations

from .queries import BUDGET

ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_CUT = "list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')"
LINES = f"ls AS (SELECT doc_id, {_CUT} AS xs FROM documents), lines AS (SELECT doc_id, (unnest(range(len(xs))))::INTEGER AS pos, unnest(xs) AS text FROM ls)"
WORDS = "len(list_filter(string_split(regexp_replace({0}, '[ \\t\\n\\r]+', ' ', 'g'), ' '), lambda w: w <> ''))"
PACKS = f"""{LINES}, sized AS (SELECT doc_id, pos, text, {WORDS.format('text')} AS size FROM lines),
walk AS (SELECT doc_id, pos, text, size, 0 AS pack, size AS total FROM sized WHERE pos = 0
  UNION ALL SELECT s.doc_id, s.pos, s.text, s.size, CASE WHEN w.total + s.size > {BUDGET} THEN w.pack + 1 ELSE w.pack END, CASE WHEN w.total + s.size > {BUDGET} THEN s.size ELSE w.total + s.size END FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.pos = w.pos + 1),
packs AS (SELECT doc_id, pack AS split_sequence, count(*) AS n_units, sum(size) AS n_tokens, string_agg(text, chr(10) ORDER BY pos) AS text FROM walk GROUP BY 1, 2)"""
TALK = f"""talk AS (SELECT conv_id AS doc_id, (turn * 2)::INTEGER AS pos, 'heading' AS element_type, CASE role WHEN 'user' THEN 2 ELSE 3 END AS level, role || ' ' || turn AS text FROM conversations WHERE role IN ('user', 'assistant')
  UNION ALL SELECT conv_id, (turn * 2 + 1)::INTEGER, 'paragraph', NULL, text FROM conversations),
shown AS (SELECT *, CASE WHEN level IS NULL THEN '<p>' || {ESC.format('text')} || '</p>' ELSE '<h' || level || '>' || {ESC.format('text')} || '</h' || level || '>' END AS html FROM talk)"""
META = r"""(length(regexp_replace(text, '[^\p{L}]', '', 'g')) < length(text) * 0.5 OR regexp_matches(lower(trim(text, ' ')), '^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$') OR regexp_matches(lower(trim(text, ' ')), '^[a-z]{1,4}[-/ ]?\d{2,}$') OR regexp_matches(lower(trim(text, ' ')), '^page \d+') OR regexp_matches(lower(trim(text, ' ')), '^\d+$'))"""
UUID = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"
VERSIONS = """now_ AS (SELECT doc_id AS source_id, any_value(sha256(text)) AS token FROM documents WHERE doc_id % 13 <> 5 GROUP BY 1),
old_ AS (SELECT doc_id AS source_id, any_value(CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN 'other' ELSE sha256(text) END) AS token FROM documents WHERE doc_id % 10 <> 3 GROUP BY 1),
feed AS (SELECT coalesce(n.source_id, o.source_id) AS source_id, CASE WHEN n.source_id IS NULL THEN 'delete' WHEN o.source_id IS NULL THEN 'add' WHEN nullif(o.token, '') = n.token THEN 'skip' ELSE 'update' END AS status FROM now_ n FULL JOIN old_ o ON n.source_id = o.source_id)"""
NOTED = """el AS (SELECT doc_id % 50 AS doc_id, doc_id::VARCHAR AS element_id, CASE WHEN doc_id % 4 = 0 THEN 'footnote' ELSE 'paragraph' END AS element_type FROM documents),
refs AS (SELECT doc_id % 50 AS doc_id, doc_id AS pos, (doc_id + doc_id % 7 * 50)::VARCHAR AS target_id, CASE doc_id % 3 WHEN 0 THEN 'footnote' ELSE 'table' END AS rel FROM documents WHERE doc_id % 3 < 2)"""
EDGES = "e AS (SELECT o_orderkey AS edge, o_custkey AS src, o_orderkey % 40 AS dst FROM orders), m AS (SELECT c_custkey AS old, c_custkey + 1000000 AS new FROM customer WHERE c_custkey % 9 <> 4)"
DATED = """d0 AS (SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, o_orderkey % 8 AS k, year(o_orderdate) AS y, date_trunc('month', o_orderdate)::DATE AS mo, o_orderdate::DATE AS da FROM orders),
d1 AS (SELECT o_orderkey, o_custkey, CASE k WHEN 0 THEN y::VARCHAR WHEN 1 THEN substr(iso, 1, 7) WHEN 2 THEN iso WHEN 3 THEN substr(iso, 1, 3) || 'X' WHEN 4 THEN y || '~' WHEN 5 THEN y || '/..' WHEN 6 THEN y || '-' || (y + 3) ELSE 'P1Y' END AS edtf,
  CASE k WHEN 1 THEN mo WHEN 2 THEN da WHEN 3 THEN make_date(y // 10 * 10, 1, 1) WHEN 4 THEN make_date(y - 1, 1, 1) WHEN 7 THEN NULL ELSE make_date(y, 1, 1) END AS begin,
  CASE k WHEN 0 THEN make_date(y + 1, 1, 1) WHEN 1 THEN (mo + INTERVAL 1 MONTH)::DATE WHEN 2 THEN (da + INTERVAL 1 DAY)::DATE WHEN 3 THEN make_date(y // 10 * 10 + 10, 1, 1) WHEN 4 THEN make_date(y + 2, 1, 1) WHEN 6 THEN make_date(y + 4, 1, 1) ELSE NULL END AS stop,
  CASE k WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'day' WHEN 3 THEN 'decade' WHEN 4 THEN 'year' WHEN 7 THEN 'unknown' ELSE 'interval' END AS precision FROM d0)"""
LEVEL = """SELECT p_partkey, (CASE WHEN size > 0 THEN CASE WHEN n <= 6 THEN r + 1 ELSE least(r * 6 // n + 1, 6) END END)::INTEGER AS level FROM
(SELECT *, max(CASE WHEN size > 0 THEN r END) OVER (PARTITION BY p_brand) + 1 AS n FROM (SELECT p_partkey, p_brand, size, dense_rank() OVER (PARTITION BY p_brand ORDER BY nullif(size, 0) DESC NULLS LAST) - 1 AS r FROM (SELECT p_partkey, p_brand, {0} AS size FROM part)))"""
NEAR = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.id, b.id AS near_id, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id), near AS (SELECT id, near_id, round(c, 6) AS cosine FROM p WHERE c >= {0})"

ORACLES: dict[str, str] = {
    "elements_from_text": f"WITH {LINES} SELECT doc_id, pos, 'paragraph' AS element_type, '<p>' || {ESC.format('text')} || '</p>' AS html, text FROM lines",
    "documents_by_type_counts": f"WITH {LINES}, {TALK} SELECT 'text' AS origin, 'paragraph' AS element_type, count(*) AS n FROM lines UNION ALL SELECT 'talk', element_type, count(*) FROM talk GROUP BY 2",
    "chunk_greedy_pack": f"WITH RECURSIVE {PACKS} SELECT doc_id, split_sequence::INTEGER AS split_sequence, (max(split_sequence) OVER (PARTITION BY doc_id) + 1)::INTEGER AS split_total, n_units::INTEGER AS n_units, n_tokens::INTEGER AS n_tokens, sha256(text) AS content_hash FROM packs",
    "chunk_ids": f"WITH RECURSIVE {PACKS}, h AS (SELECT doc_id::VARCHAR AS source_id, split_sequence::INTEGER AS split_sequence, sha256(text) AS content_hash, sha256(doc_id || chr(31) || split_sequence || chr(31) || '0' || chr(31) || sha256(text)) AS x FROM packs) SELECT {UUID.format('x')} AS chunk_id, source_id, split_sequence, content_hash FROM h",
    "content_hash_text": f"""SELECT doc_id, sha256('millrace/document/1' || chr(10) || '{{"elements":' || to_json(list_transform({_CUT}, lambda x: {{'element_type': 'paragraph', 'html': '<p>' || {ESC.format('x')} || '</p>'}}))::VARCHAR || ',"title":' || coalesce(to_json(source)::VARCHAR, 'null') || '}}') AS content_hash FROM documents""",
    "exact_duplicate_groups": "SELECT sha256(lower(trim(text, ' '))) AS seed, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "empty_document_filter": f"SELECT doc_id, source FROM documents WHERE len({_CUT}) > 0",
    "conv_split_by_headings": f"WITH {TALK}, f AS (SELECT doc_id, pos, element_type, element_type = 'heading' AND lag(element_type) OVER w <> 'heading' AS b FROM talk WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos, element_type, (sum(coalesce(b, false)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos))::INTEGER AS split_id FROM f",
    "conv_hierarchical_split": f"WITH {TALK}, c AS (SELECT doc_id, min(level) AS split_level FROM (SELECT doc_id, level, count(*) AS n FROM talk WHERE level IS NOT NULL GROUP BY 1, 2) WHERE n >= 2 GROUP BY 1) SELECT t.doc_id, pos, split_level::INTEGER AS split_level, greatest(sum(CASE WHEN level = split_level THEN 1 ELSE 0 END) OVER (PARTITION BY t.doc_id ORDER BY pos) - 1, 0)::INTEGER AS split_id FROM talk t LEFT JOIN c ON t.doc_id = c.doc_id",
    "conv_heading_context_asof": f"""WITH {TALK}, l AS (SELECT doc_id, pos, last_value(CASE WHEN level = 2 THEN text END IGNORE NULLS) OVER w AS t2, min(CASE WHEN level = 2 THEN pos END) OVER w AS p2, last_value(CASE WHEN level = 3 THEN text END IGNORE NULLS) OVER w AS t3, min(CASE WHEN level = 3 THEN pos END) OVER w AS p3 FROM talk WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, pos, CASE WHEN t2 IS NULL THEN coalesce(t3, '') WHEN t3 IS NULL THEN t2 WHEN p2 < p3 THEN t2 || ' > ' || t3 ELSE t3 || ' > ' || t2 END AS context FROM l""",
    "heading_level_dense_rank": LEVEL.format("p_size % 6"),
    "heading_level_compressed": LEVEL.format("p_size"),
    "heading_effective_size": "SELECT p_partkey, round_even(p_size::DOUBLE * (CASE WHEN p_name LIKE '%a%' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN p_size % 2 = 0 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN p_size % 3 = 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END), 1) AS size FROM part",
    "heading_normalize": f"WITH {TALK} SELECT doc_id, pos, dense_rank() OVER (PARTITION BY doc_id ORDER BY level)::INTEGER AS level FROM talk WHERE level IS NOT NULL",
    "main_headings": f"WITH {TALK} SELECT doc_id, arg_min(text, level * 1000000 + pos) AS heading, min(level)::INTEGER AS level FROM talk WHERE level IS NOT NULL GROUP BY 1",
    "title_detection": f"WITH {LINES} SELECT doc_id, pos, text AS title FROM lines WHERE pos // 2 <= 4 AND length(trim(text, ' ')) >= 3 AND NOT {META} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(text) % 7 DESC, (length(text) % 2 = 0) DESC, pos) = 1",
    "looks_like_metadata": f"WITH {LINES} SELECT doc_id, pos, {META} AS is_metadata FROM lines",
    "pages_titles": "SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), ' '), '') AS title, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), ' '), '') AS heading FROM pages",
    "pages_markup_richness": "SELECT page_id, (len(regexp_extract_all(html, '<(b|strong|i|em|u|s|a|sub|sup|code|mark)[ >]')) + len(regexp_extract_all(html, '<span style')) + 2 * len(regexp_extract_all(html, '<ref ')))::INTEGER AS richness FROM pages",
    "sentence_split_counts": r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> ''))::INTEGER AS n_sentences FROM documents",
    "token_window_slices": r"""WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 21, 0) + 1, 180)) AS start FROM w WHERE len(w) > 0)
SELECT doc_id, (start // 180)::INTEGER AS slice, start::INTEGER AS start, len(w[start + 1:start + 200])::INTEGER AS n_tokens, sha256(array_to_string(w[start + 1:start + 200], ' ')) AS text_hash FROM s""",
    "render_prompt_conversation": f"WITH {TALK}, r AS (SELECT doc_id, string_agg(html, chr(10) ORDER BY pos) AS x FROM shown GROUP BY 1) SELECT doc_id, sha256(x) AS html_hash, length(x)::INTEGER AS n_chars FROM r",
    "render_plain_conversation": f"WITH {TALK} SELECT doc_id, sha256(string_agg(regexp_replace(text, '^[\\n -]+|[\\n -]+$', '', 'g'), chr(10) ORDER BY pos)) AS text_hash FROM talk GROUP BY 1",
    "refs_broken": f"WITH {NOTED} SELECT doc_id, pos, target_id, rel FROM refs r WHERE NOT EXISTS (SELECT 1 FROM el e WHERE e.doc_id = r.doc_id AND e.element_id = r.target_id)",
    "footnotes_orphaned": f"WITH {NOTED} SELECT doc_id, element_id FROM el e WHERE element_type = 'footnote' AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.rel = 'footnote' AND e.doc_id = r.doc_id AND e.element_id = r.target_id)",
    "footnote_scoring": rf"""WITH {LINES}, c AS (SELECT doc_id, pos, substr(text, 1, 50) AS before, substr(text, 51, 50) AS after, CASE WHEN length(text) % 3 = 0 THEN 0 ELSE 50 END AS start FROM lines),
s AS (SELECT doc_id, pos AS element_pos, start, (CASE WHEN NOT pos > 1 THEN -10 ELSE 0 END + CASE WHEN start = 0 THEN -5 ELSE 0 END + CASE WHEN regexp_matches(after, '^\.\d') THEN -4 ELSE 0 END + CASE WHEN start = 0 AND regexp_matches(after, '^[.)][ \t]+[^ \t]') THEN -3 ELSE 0 END + CASE WHEN regexp_matches(before, '\d$') THEN -2 ELSE 0 END
 + CASE WHEN regexp_matches(before, '[=+*/<>-] ?$') OR regexp_matches(after, '^ ?[=+*/<>]') THEN -3 ELSE 0 END + CASE WHEN regexp_matches(before, '[.,;:!?)"'']$') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(before, '[a-z]$') THEN 2 ELSE 0 END + CASE WHEN pos > 5 THEN 1 ELSE 0 END)::INTEGER AS score FROM c)
SELECT doc_id, element_pos, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, element_pos, start) = 1""",
    "group_reachability": "WITH RECURSIVE e AS (SELECT n_nationkey AS src, n_nationkey * 2 % 25 AS dst FROM nation UNION ALL SELECT n_nationkey, n_nationkey + n_regionkey % 2 FROM nation), r AS (SELECT n_nationkey AS root, n_nationkey AS node FROM nation UNION SELECT r.root, e.dst FROM r JOIN e ON r.node = e.src) SELECT root::BIGINT AS root, node::BIGINT AS node FROM r",
    "sync_change_feed": f"WITH {VERSIONS} SELECT source_id, status FROM feed",
    "sync_orphans": f"WITH {VERSIONS} SELECT source_id FROM feed WHERE status = 'delete'",
    "sync_source_state": "WITH r AS (SELECT source AS source_id, CASE WHEN ends_with(source, '1') THEN 'same' ELSE lang END AS h FROM documents) SELECT source_id, CASE WHEN count(DISTINCT h) = 1 THEN min(h) END AS source_hash, NULL::VARCHAR AS content_hash FROM r GROUP BY 1",
    "sync_apply_end_state": f"WITH {VERSIONS} SELECT o.source_id, o.token FROM old_ o JOIN feed f USING (source_id) WHERE status = 'skip' UNION ALL SELECT n.source_id, n.token FROM now_ n JOIN feed f USING (source_id) WHERE status IN ('add', 'update') AND n.source_id % 17 <> 2",
    "sync_versioned_sink": f"WITH {VERSIONS} SELECT source_id, token AS source_hash FROM now_",
    "mention_finalize_ids": "WITH o AS (SELECT o_custkey::VARCHAR AS source_id, o_orderkey AS place, sha256(o_orderpriority) AS h, '{\"status\":\"' || o_orderstatus || '\"}' AS payload, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS ordinal FROM orders) SELECT source_id, place, ordinal, sha256(source_id || chr(0) || h || chr(0) || ordinal || chr(0) || payload) AS mention_id FROM o",
    "edge_endpoint_rewrite": f"WITH {EDGES} SELECT edge, a.new AS src, b.new AS dst FROM e JOIN m a ON e.src = a.old JOIN m b ON e.dst = b.old",
    "edge_orphans": f"WITH {EDGES} SELECT edge, src, dst FROM e LEFT JOIN m a ON e.src = a.old LEFT JOIN m b ON e.dst = b.old WHERE a.new IS NULL OR b.new IS NULL",
    "edges_not_dangling": f"WITH {EDGES} SELECT edge, src, dst FROM e WHERE src IN (SELECT old FROM m) AND dst IN (SELECT old FROM m)",
    "pattern_filter": "WITH e AS (SELECT c_custkey AS edge, c_mktsegment AS src_kind, CASE WHEN c_acctbal < 0 THEN 'owes' ELSE 'owns' END AS kind, CASE WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS dst_kind FROM customer) SELECT * FROM e WHERE (src_kind, kind, dst_kind) IN (('BUILDING', 'owes', 'even'), ('MACHINERY', 'owns', 'odd'), ('AUTOMOBILE', 'owns', 'even'))",
    "graph_neighbors": "SELECT DISTINCT 'n' || n_nationkey AS node, 'c' || c_custkey AS neighbour FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_custkey % 3 <> 0 UNION SELECT 'n' || n_nationkey, 's' || s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey",
    "entity_blocking_topk": f"WITH {NEAR.format(0.5)} SELECT id, near_id, cosine, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, near_id)::INTEGER AS rank FROM near QUALIFY rank <= 5",
    "entity_components": f"WITH RECURSIVE {NEAR.format(0.6)}, r AS (SELECT id AS node, id AS root FROM near UNION SELECT near.near_id, r.root FROM r JOIN near ON r.node = near.id) SELECT node, min(root) AS root FROM r GROUP BY 1",
    "entity_canonical": "WITH c AS (SELECT c_custkey::VARCHAR AS id, c_nationkey, 'kind: ' || c_mktsegment || CASE WHEN c_acctbal < 0 THEN chr(10) || 'sign: minus' ELSE '' END AS identity, c_mktsegment AS s FROM customer) SELECT c_nationkey, sha256(string_agg(DISTINCT id, chr(0) ORDER BY id)) AS entity_id, min(identity) AS canonical, string_agg(DISTINCT identity, ' | ' ORDER BY identity) AS aliases, count(DISTINCT id)::INTEGER AS n_members, string_agg(DISTINCT s, ' | ' ORDER BY s) AS sources FROM c GROUP BY 1",
    "fuzzy_date_bounds": f"WITH {DATED} SELECT o_orderkey, edtf, begin::VARCHAR AS begin, stop::VARCHAR AS stop, precision FROM d1",
    "date_overlap_query": f"WITH {DATED} SELECT o_orderkey AS entity_id, edtf FROM d1 WHERE edtf <> 'P1Y' AND (stop IS NULL OR stop > DATE '1995-06-01') AND (begin IS NULL OR begin < DATE '1995-09-01')",
    "date_union": f"WITH {DATED} SELECT o_custkey, (CASE WHEN count(*) = count(begin) THEN min(begin) END)::VARCHAR AS begin, (CASE WHEN count(*) = count(stop) THEN max(stop) END)::VARCHAR AS stop FROM d1 WHERE edtf <> 'P1Y' GROUP BY 1",
    "sibling_documents": "WITH t AS (SELECT conv_id, conv_id || '/' || turn AS doc_id FROM conversations) SELECT a.doc_id, b.doc_id AS sibling_id FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.doc_id <> b.doc_id",
    "metadata_merge_policy": "WITH c AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN role ELSE 'other' END AS other, length(text) AS size FROM conversations) SELECT conv_id, turn, 'role=' || role || ';size=' || size || ';turn=' || turn AS first, 'role=' || other || ';size=' || size || ';turn=' || turn AS second, CASE WHEN role = other THEN 'role=' || role || ';size=' || size || ';turn=' || turn END AS strict FROM c",
    "parser_routing": "WITH f AS (SELECT page_id, page_id % 7 AS k, 'f' || page_id || ['.html', '.HTM', '.azure.json', '_middle.json', '.pdf', '.document.json', '.bin'][page_id % 7 + 1] AS path FROM pages) SELECT page_id, path, CASE k WHEN 0 THEN 'html' WHEN 1 THEN 'html' WHEN 2 THEN 'analysis' WHEN 3 THEN 'layout' WHEN 5 THEN 'snapshot' END AS parser, CASE k WHEN 4 THEN 'needs a service key' WHEN 6 THEN 'no parser for this suffix' END AS error FROM f",
    "bm25_terms": "WITH w AS (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY 1, 2) SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM tf GROUP BY 1 HAVING count(*) >= 3",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_sync_available_now": "SELECT doc_id AS source_id, any_value(sha256(text)) AS source_hash FROM documents GROUP BY 1",
}
