"""DuckDB SQL of the training-data queries that SQL can express, written from their contracts and not from the operators."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Digests and lengths from the source rows. A turn is "### Name: text\n</turn>\n"; each control string in a text costs one backslash.
CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (
  SELECT conv_id, turn, role, text, len(regexp_extract_all(text, '#{3,}|</turn>')) AS escapes,
    CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role) ELSE 1 + 2 * strlen(role) END AS name FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(4 + name + 2 + length(text) + escapes + 9)::BIGINT AS formatted_chars FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

#: Links by an exact join of whole shingle sets, components by recursion.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] WHEN len(w) = 1 THEN w ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reached)
SELECT doc_id, any_value(n.n)::BIGINT AS n_shingles, min(reached) AS component_id, doc_id = min(reached) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id
"""

#: All products of the queries with all candidates.
TOP_K = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id AND q.vec_id % 50 = 0 AND len(q.e) = len(v.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: CRC-32 by its table of 256 remainders, made by eight shifts each; near words share a word less one code point.
VARIANTS = rf"""
WITH RECURSIVE t AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(256) x(i)),
crc AS (SELECT list(r ORDER BY i) AS t FROM t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
counted AS (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 5 GROUP BY ALL),
hexed AS (SELECT w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM counted),
coded AS (
  SELECT w, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, [('0x' || x[2 * j - 1:2 * j])::BIGINT for j in range(1, length(x) // 2 + 1)]),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM hexed, crc),
edited AS (SELECT CASE WHEN h % 97 = 0 THEN w[1:(h % length(w))] || w[(h % length(w)) + 2:] ELSE w END AS word, n FROM coded),
v AS (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, word AS y FROM v UNION SELECT word, n, word[1:j - 1] || word[j + 1:] FROM v, unnest(range(1, length(word) + 1)) AS u(j)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.y = b.y AND a.word <> b.word WHERE length(a.word) <> length(b.word) OR len([1 for j in range(1, length(a.word) + 1) if a.word[j] <> b.word[j]]) = 1),
best AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM near),
forms AS (SELECT word, n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM best WHERE k = 1),
chain AS (SELECT word, form AS root, 1 AS step FROM forms WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT v.word, f.form, coalesce(r.root, v.word) AS root, v.n, coalesce(f.n_near, 0)::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM v LEFT JOIN forms f USING (word) LEFT JOIN roots r USING (word)
"""

#: Rules by a join with their list; reputation by moments at three levels.
URLS = rf"""
WITH p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
hit AS (
  SELECT p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY ALL),
lab AS (SELECT doc_id, max(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY doc_id),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad::INT), 0) AS k FROM p LEFT JOIN lab ON page_id = doc_id GROUP BY host),
h AS (SELECT *, split_part(host, '.', -1) AS suffix, CASE WHEN host LIKE '%.%' THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) ELSE host END AS domain FROM h0),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
m0 AS (SELECT (coalesce(sum(k), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) AS m FROM s),
a1 AS (SELECT least(greatest(coalesce(sum((k - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 1e-4), 1e-4), 1 - 1e-4) AS alike FROM s, m0 WHERE n > 0),
s1 AS (SELECT suffix, n, ((1 / alike - 1) * m + k) / ((1 / alike - 1) + n) AS m FROM s, m0, a1),
d0 AS (SELECT d.*, s1.m AS prior FROM d JOIN s1 USING (suffix)),
a2 AS (SELECT least(greatest(coalesce(sum((k - n * prior) ** 2 - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 1e-4), 1e-4), 1 - 1e-4) AS alike FROM d0 WHERE n > 0),
d1 AS (SELECT domain, ((1 / alike - 1) * prior + k) / ((1 / alike - 1) + n) AS m FROM d0, a2),
h1 AS (SELECT h.*, d1.m AS prior FROM h JOIN d1 USING (domain)),
a3 AS (SELECT least(greatest(coalesce(sum((k - n * prior) ** 2 - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 1e-4), 1e-4), 1 - 1e-4) AS alike FROM h1 WHERE n > 0),
f AS (SELECT host, n, k, 1 / alike - 1 AS c, ((1 / alike - 1) * prior + k) / ((1 / alike - 1) + n) AS rate FROM h1, a3)
SELECT page_id, host, path, hit.rule, coalesce(hit.verdict, CASE WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (c + n + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  n::BIGINT AS n_labelled, k::BIGINT AS n_bad
FROM p JOIN f USING (host) LEFT JOIN hit USING (host, path)
"""

ORACLE = {
    "op2_chat_formatting": CHAT,
    "op3_minhash_near_dedup": NEAR_DUPLICATES,
    "op9_exact_top_k": TOP_K,
    "op11_spelling_variants": VARIANTS,
    "op13_url_filters": URLS,
}
