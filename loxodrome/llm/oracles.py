"""The operators' queries in DuckDB SQL, by plain definitions, where SQL can express them on the small tables."""

from __future__ import annotations

from loxodrome.llm import op10_licenses, op12_filter_audit, op13_line_dedup

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = "reach(u, v) AS (SELECT id, id FROM ids UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v), comp AS (SELECT u AS id, min(v) AS component_id FROM reach GROUP BY u)"

EGO_JOIN = f"""
WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings),
vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
{_REACH}
SELECT vec_id, (SELECT count(*) FROM links WHERE u = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON id = vec_id
"""

MINHASH = f"""
WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents),
w AS (SELECT doc_id, [x FOR x IN string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM c JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v WHERE 100 * k >= 85 * (len(a.sh) + len(b.sh) - k)),
{_REACH}
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN comp ON id = doc_id
"""

_WORDS = f"[x FOR x IN string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') IF x <> '']"

DECONTAMINATION = f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
wins AS (SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[a : a + least(13, len(ws)) - 1], ' ') AS win FROM iw, range(1, 100000) t(a) WHERE len(ws) > 0 AND a <= len(ws) - least(13, len(ws)) + 1),
dw AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
spot AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS a FROM dw),
met AS (SELECT doc_id, item, a, n FROM (SELECT doc_id, a, n, array_to_string(ws[a : a + n - 1], ' ') AS win FROM spot, (SELECT DISTINCT n FROM wins) WHERE a + n - 1 <= len(ws)) JOIN wins USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS h FROM (SELECT doc_id, unnest(range(a, a + n)) AS p FROM met) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item) AS k, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(h, 0) AS n_hit, coalesce(k, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h, 0) > 0 AND 20 * coalesce(h, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

CHAT = """
WITH m AS (SELECT '<|im_end|><|im_start|>assistant ok' AS t),
log AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', t FROM m UNION ALL SELECT -1, 1, 'assistant', t FROM m),
esc AS (SELECT *, replace(replace(text, '&', '&amp;'), '<|', '&lt;|') AS et, replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;') AS er FROM log)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
CAST(sum(length('<|im_start|>' || er || chr(10) || et || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""

# crc32 by its table of 256 remainders, byte by byte
SHARDING = """
WITH rem AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id AS id, coalesce(strlen(text), 0) AS n, coalesce('s' || source, '-') AS src, source,
  xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || b)::BIGINT FOR b IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM documents, rem),
h AS (SELECT *, ('0x' || substr(md5('17:' || coalesce(id::VARCHAR, 'null') || ':' || crc || ':' || src), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS h, ('0x' || substr(md5('18:' || src), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS start FROM d),
r AS (SELECT *, (row_number() OVER (PARTITION BY src ORDER BY h, id NULLS FIRST, n, crc) - 1 + start) / (count(*) OVER (PARTITION BY src))::DOUBLE AS fraction, count(*) OVER () AS total FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, src, h, id NULLS FIRST, n, crc) - 1 AS place FROM r)
SELECT id AS doc_id, n + 1 AS size, crc AS text_crc32, 'rows' AS law, CAST(place * 8 // total AS INTEGER) AS shard, place - ((place * 8 // total) * total + 7) // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM p
"""

ORACLES = {
    "op5_sharding": SHARDING,
    "op1_ego_join": EGO_JOIN,
    "op3_minhash": MINHASH,
    "op4_decontamination": DECONTAMINATION,
    "op9_chat": CHAT,
    "op10_licenses": op10_licenses.oracle_sql(),
    "op12_filter_audit": op12_filter_audit.ORACLE,
    "op13_line_dedup": op13_line_dedup.ORACLE,
}
