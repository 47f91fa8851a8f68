"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_OP2 = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(verdict, h, q) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT page_id, host, path,
  (SELECT h || q FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) ORDER BY length(h || q) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) ORDER BY length(h || q) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""

_OP4 = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
c(a, b) AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM c WHERE c.a = vec_id), vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce((SELECT min(b) FROM c WHERE c.a = vec_id), vec_id)) AS kept FROM embeddings
"""

# Texts are in hex, two characters a byte. Windows are cut from pieces of 500 starts, as cutting far into a long string is slow.
_OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
pieces AS (SELECT r, 500 * j AS f, substr(x, 1000 * j + 1, 1398) AS y FROM (SELECT r, x, unnest(range((length(x) // 2 + 300) // 500)) AS j FROM d WHERE length(x) >= 400)),
starts AS (SELECT r, f + i AS p, md5(substr(y, 2 * i + 1, 400)) AS h FROM (SELECT r, f, y, unnest(range(length(y) // 2 - 199)) AS i FROM pieces WHERE length(y) >= 400)),
again AS (SELECT r, p FROM starts WHERE h IN (SELECT h FROM starts GROUP BY h HAVING count(*) > 1)),
marked AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS opens FROM again),
numbered AS (SELECT r, p, sum(opens) OVER (PARTITION BY r ORDER BY p) AS span FROM marked),
spans AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY r, span),
before AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS last FROM spans),
cut AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM before JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, substr(md5(coalesce(doc_id::VARCHAR, '') || ':42:' || md5(coalesce(text, ''))), 1, 15) AS u, row_number() OVER () AS r FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT source, n, 3 * n AS cap, 1 + ((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source IS NULL, source) AS k FROM w),
c AS (SELECT k, cap, w, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps,
             (sum(w) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS ws FROM o),
l AS (SELECT ((SELECT sum(n) FROM s)::BIGINT - caps)::DOUBLE / ws AS level FROM c WHERE cap >= w * (((SELECT sum(n) FROM s)::BIGINT - caps)::DOUBLE / ws) ORDER BY k LIMIT 1),
t AS (SELECT source, n, CASE WHEN cap < w * level THEN cap::DOUBLE ELSE w * level END AS target FROM w, l),
f AS (SELECT source, n, target, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS whole FROM t),
x AS (SELECT d.doc_id, d.size, f.n, f.target, f.whole, target - whole * n AS rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY u, r) AS upto FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, n AS source_size, target, size * (whole + CASE WHEN 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END)::BIGINT AS taken FROM x
"""

# CRC-32 with the reflected polynomial 0xEDB88320, a byte at a time through its table of 256.
_OP7 = r"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS step FROM bits WHERE k = 8),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, size, list_transform(regexp_extract_all(x, '..'), lambda y: ('0x' || y)::BIGINT) AS bytes FROM d),
z AS (SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_concat([4294967295], bytes), lambda acc, v: xor(acc // 256, step[xor(acc % 256, v) + 1])), 4294967295)::BIGINT AS text_crc32 FROM b, crc),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM z),
s AS (SELECT *, ((2 * before + size) * 8 // (2 * total))::INT AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard FROM s
"""

_OP9 = r"""
WITH t AS (
  SELECT conv_id AS pair_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
         replace(coalesce(role, 'user'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
e AS (SELECT pair_id, max(i) AS i FROM t WHERE role = 'assistant' GROUP BY pair_id),
o AS (SELECT own.pair_id, own.i, t.role, t.text FROM e own JOIN e far ON far.pair_id = xor(own.pair_id, 1) JOIN t ON t.pair_id = far.pair_id AND t.i = far.i),
c AS (SELECT pair_id, 0 AS side, i, role, text FROM t UNION ALL SELECT t.pair_id, 1, t.i, t.role, t.text FROM t JOIN o ON t.pair_id = o.pair_id AND t.i < o.i UNION ALL SELECT pair_id, 1, i, role, text FROM o),
m AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.i, b.i) AS i, coalesce(a.role = b.role AND a.text = b.text, false) AS same
      FROM (SELECT * FROM c WHERE side = 0) a FULL JOIN (SELECT * FROM c WHERE side = 1) b ON a.pair_id = b.pair_id AND a.i = b.i),
n AS (SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN i END) - 1, count(*))::INT AS n FROM m GROUP BY pair_id),
r AS (SELECT c.*, n.n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown FROM c JOIN n USING (pair_id)),
z AS (SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, side ORDER BY i) AS stop FROM r WHERE i > n)
SELECT n.pair_id, n.n AS n_prompt_turns,
  coalesce((SELECT string_agg(shown, '' ORDER BY i) FROM r WHERE r.pair_id = n.pair_id AND side = 0 AND i <= r.n), '') AS prompt,
  coalesce((SELECT string_agg(shown, '' ORDER BY i) FROM z WHERE z.pair_id = n.pair_id AND side = 0), '') AS chosen_text,
  coalesce((SELECT string_agg(shown, '' ORDER BY i) FROM z WHERE z.pair_id = n.pair_id AND side = 1), '') AS rejected_text,
  coalesce((SELECT string_agg((stop - length(text) - 11)::VARCHAR || ':' || stop::VARCHAR, ',' ORDER BY i) FROM z WHERE z.pair_id = n.pair_id AND side = 0 AND role = 'assistant'), '') AS chosen_spans,
  coalesce((SELECT string_agg((stop - length(text) - 11)::VARCHAR || ':' || stop::VARCHAR, ',' ORDER BY i) FROM z WHERE z.pair_id = n.pair_id AND side = 1 AND role = 'assistant'), '') AS rejected_spans
FROM n
"""

_OP10 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest, row_number() OVER w AS i, first_value(page_id) OVER w AS last
      FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND i > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND i > 1 THEN last END AS refers_to FROM q
"""

SQL = {"op2_url_filter": _OP2, "op4_embedding": _OP4, "op5_suffix": _OP5, "op6_mixing": _OP6, "op7_sharding": _OP7, "op9_chat": _OP9, "op10_warc": _OP10}
