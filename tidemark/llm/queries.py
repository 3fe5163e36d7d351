"""The registered queries of this package and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.chat import op5_chat_format
from tidemark.llm.decontaminate import op4_decontaminate
from tidemark.llm.embed_join import op8_embedding_join
from tidemark.llm.line_dedup import op1_line_dedup
from tidemark.llm.lm_score import op2_lm_score
from tidemark.llm.merkle import op12_merkle_manifest
from tidemark.llm.minhash import op9_minhash_near_dedup
from tidemark.llm.packing import op6_best_fit_packing
from tidemark.llm.quality import op7_quality_classifier
from tidemark.llm.ranked import op11_ranked_search
from tidemark.llm.substring import op10_suffix_dedup
from tidemark.llm.token_files import op3_token_files
from tidemark.llm.warc import op13_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_lm_score,
        op3_token_files,
        op4_decontaminate,
        op5_chat_format,
        op6_best_fit_packing,
        op7_quality_classifier,
        op8_embedding_join,
        op9_minhash_near_dedup,
        op10_suffix_dedup,
        op11_ranked_search,
        op12_merkle_manifest,
        op13_warc,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, i, line, f.keeper IS NOT NULL AND f.keeper <> doc_id AS gone FROM keyed LEFT JOIN frequent f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op8_embedding_join": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.id WHERE reach.r < links.b)
SELECT e.vec_id, coalesce((SELECT count(*) FROM links WHERE a = e.vec_id), 0) AS n_links, min(reach.r) AS component_id, min(reach.r) = e.vec_id AS kept
FROM embeddings e JOIN reach ON reach.id = e.vec_id GROUP BY e.vec_id""",
    "op5_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
        17 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) AS chars
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM e)
SELECT conv_id, max(n) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE field AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END) AS crc
  FROM documents),
hashed AS (SELECT lang, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other FROM field),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
node(lang, level, idx, n, h) AS (SELECT lang, 0, idx, n, leaf FROM leaves
  UNION ALL SELECT lang, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM node WHERE n > 1 GROUP BY lang, level, idx // 8, n),
subroots AS MATERIALIZED (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM node WHERE n = 1),
upper_node(level, idx, n, h) AS (SELECT 0, idx, n, subroot FROM subroots
  UNION ALL SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM upper_node WHERE n > 1 GROUP BY level, idx // 8, n),
walk(lang, leaf_idx, level, idx, n, now, path) AS (SELECT lang, idx, 0, idx, n, coalesce(other, leaf), '' FROM leaves
  UNION ALL SELECT w.lang, w.leaf_idx, w.level + 1, w.idx // 8, (w.n + 7) // 8, sha256(string_agg(CASE WHEN s.idx = w.idx THEN w.now ELSE s.h END, '' ORDER BY s.idx)), w.path || coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx <> w.idx), '')
  FROM walk w JOIN node s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.idx // 8 = w.idx // 8 WHERE w.n > 1 GROUP BY w.lang, w.leaf_idx, w.level, w.idx, w.n, w.now, w.path),
climb(lang, leaf_idx, level, idx, n, now, path) AS (SELECT w.lang, w.leaf_idx, 0, r.idx, r.n, w.now, w.path FROM walk w JOIN subroots r ON r.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL SELECT w.lang, w.leaf_idx, w.level + 1, w.idx // 8, (w.n + 7) // 8, sha256(string_agg(CASE WHEN s.idx = w.idx THEN w.now ELSE s.h END, '' ORDER BY s.idx)), w.path || coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx <> w.idx), '')
  FROM climb w JOIN upper_node s ON s.level = w.level AND s.idx // 8 = w.idx // 8 WHERE w.n > 1 GROUP BY w.lang, w.leaf_idx, w.level, w.idx, w.n, w.now, w.path)
SELECT l.doc_id, l.leaf, r.subroot, u.h AS root, sha256(c.path) AS proof_sha256, c.now AS folded_root, c.now = u.h AS verified
FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN climb c ON c.lang IS NOT DISTINCT FROM l.lang AND c.leaf_idx = l.idx AND c.n = 1 CROSS JOIN (SELECT h FROM upper_node WHERE n = 1) u""",
    "op13_warc": r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 AND page_id IS NOT NULL THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op11_ranked_search": r"""
WITH term AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS t FROM documents WHERE doc_id IS NOT NULL),
tf AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM term GROUP BY doc_id, t),
doc AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM doc),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
query AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS t FROM benchmark WHERE item_id IS NOT NULL),
scored AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // len)))) AS BIGINT) AS score
  FROM query JOIN df USING (t) JOIN tf USING (t) JOIN doc USING (doc_id) CROSS JOIN total GROUP BY item_id, doc_id),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50""",
}
