"""DuckDB SQL for the queries that SQL can express."""

OP3 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shingles AS (SELECT doc_id, hash(unnest(s)) AS h FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT sizes.doc_id, CAST(n AS BIGINT) AS n_shingles, component_id
FROM sizes JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

OP9 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

OP11 = r"""
WITH RECURSIVE raw AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
dealt AS (
  SELECT *, xor(list_reduce(range(0, 8 * len(k)), lambda c, i: CASE WHEN xor(c, CASE WHEN i % 8 = 0 THEN ascii(k[i // 8 + 1]) ELSE 0 END) % 2 = 1
      THEN xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(k[i // 8 + 1]) ELSE 0 END) // 2, 3988292384)
      ELSE xor(c, CASE WHEN i % 8 = 0 THEN ascii(k[i // 8 + 1]) ELSE 0 END) // 2 END, 4294967295), 4294967295) % 20 AS f
  FROM raw),
hurt AS (
  SELECT conv, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt WHERE f <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text), copy) AS rn,
    row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM hurt),
turns AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY rn) AS p
  FROM placed),
facts AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (p IS NOT NULL AND p || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv),
gap(a, b, cost, audit, body) AS (
  VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'),
    (3, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
    (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
edit(a, b, cost, audit, c) AS (
  SELECT s, s, 2, 'D', CAST(NULL AS VARCHAR) FROM range(0, 4) x(s)
  UNION ALL VALUES (0, 1, 0, 'K', 's'), (0, 2, 0, 'K', 'u'), (1, 2, 0, 'K', 'u'), (3, 2, 0, 'K', 'u'), (2, 3, 0, 'K', 'a'),
    (0, 2, 1, 'R', 'user'), (1, 2, 1, 'R', 'user'), (3, 2, 1, 'R', 'user'), (2, 3, 1, 'R', 'assistant')),
way AS (
  SELECT conv, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS cost, CAST('' AS VARCHAR) AS audit, CAST('' AS VARCHAR) AS body FROM facts
  UNION ALL
  SELECT conv, rn, s, cost, audit, body FROM (
    SELECT way.conv, t.rn, CAST(e.b AS BIGINT) AS s, way.cost + g.cost + e.cost + CASE WHEN t.fault = 'truncated' AND e.audit <> 'D' THEN 5 ELSE 0 END AS cost,
      way.audit || g.audit || e.audit AS audit,
      way.body || g.body || CASE e.audit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || t.role || ':' || t.text ELSE chr(10) || e.c || ':' || t.text END AS body
    FROM way JOIN turns t ON t.conv = way.conv AND t.rn = way.rn + 1 JOIN gap g ON g.a = way.s JOIN edit e ON e.a = g.b
    WHERE e.audit = 'D' OR (t.fault IN ('', 'truncated') AND (e.audit = 'R' OR e.c = t.c))
    QUALIFY row_number() OVER (PARTITION BY way.conv, e.b ORDER BY way.cost + g.cost + e.cost + CASE WHEN t.fault = 'truncated' AND e.audit <> 'D' THEN 5 ELSE 0 END, way.audit || g.audit || e.audit) = 1)),
best AS (
  SELECT way.conv, way.cost + g.cost AS cost, way.audit || g.audit AS audit, way.body || g.body AS body
  FROM way JOIN facts f ON f.conv = way.conv AND f.n = way.rn JOIN gap g ON g.a = way.s AND g.b IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY way.conv ORDER BY way.cost + g.cost, way.audit || g.audit) = 1)
SELECT DISTINCT raw.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(substr(body, 2), '')) AS repaired_sha256
FROM raw LEFT JOIN facts USING (conv) LEFT JOIN best USING (conv)
"""

OP13 = r"""
WITH parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM (SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages)),
hosts AS (
  SELECT host, CASE WHEN two IN ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'org.uk') THEN regexp_extract(host, '(?:[^.]*\.){0,2}[^.]*$') ELSE two END AS domain,
    CASE WHEN two IN ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'org.uk') THEN two ELSE regexp_extract(host, '[^.]*$') END AS suffix
  FROM (SELECT DISTINCT host, regexp_extract(host, '(?:[^.]*\.)?[^.]*$') AS two FROM parts)),
marks AS (
  SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) <> 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h AS (
  SELECT host, domain, suffix, count(*) AS n, sum(bad) AS k
  FROM parts JOIN marks ON TRY_CAST(regexp_extract(path, '/([0-9]{1,18})(?:\.html|/)?$', 1) AS BIGINT) = doc_id JOIN hosts USING (host) WHERE url IS NOT NULL GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
s1 AS (SELECT suffix, n, k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM s) AS prior FROM s),
s2 AS (SELECT *, (SELECT CASE WHEN sum(n * (n - 1) * prior * (1 - prior)) > 0
    THEN least(greatest(sum((k - n * prior) ** 2 - n * prior * (1 - prior)) / sum(n * (n - 1) * prior * (1 - prior)), 0.001), 0.999) ELSE 0.5 END FROM s1) AS alike FROM s1),
s3 AS (SELECT suffix, (prior * (1 / alike - 1) + k) / (1 / alike - 1 + n) AS mean, 1 / alike - 1 + n AS weight FROM s2),
d1 AS (SELECT domain, n, k, mean AS prior FROM d JOIN s3 USING (suffix)),
d2 AS (SELECT *, (SELECT CASE WHEN sum(n * (n - 1) * prior * (1 - prior)) > 0
    THEN least(greatest(sum((k - n * prior) ** 2 - n * prior * (1 - prior)) / sum(n * (n - 1) * prior * (1 - prior)), 0.001), 0.999) ELSE 0.5 END FROM d1) AS alike FROM d1),
d3 AS (SELECT domain, (prior * (1 / alike - 1) + k) / (1 / alike - 1 + n) AS mean, 1 / alike - 1 + n AS weight FROM d2),
h1 AS (SELECT host, n, k, mean AS prior FROM h JOIN d3 USING (domain)),
h2 AS (SELECT *, (SELECT CASE WHEN sum(n * (n - 1) * prior * (1 - prior)) > 0
    THEN least(greatest(sum((k - n * prior) ** 2 - n * prior * (1 - prior)) / sum(n * (n - 1) * prior * (1 - prior)), 0.001), 0.999) ELSE 0.5 END FROM h1) AS alike FROM h1),
h3 AS (SELECT host, (prior * (1 / alike - 1) + k) / (1 / alike - 1 + n) AS mean, 1 / alike - 1 + n AS weight FROM h2),
blocked AS (
  SELECT host FROM hosts LEFT JOIN h3 USING (host) LEFT JOIN d3 USING (domain) LEFT JOIN s3 USING (suffix)
  WHERE coalesce(h3.mean - 1.645 * sqrt(h3.mean * (1 - h3.mean) / (h3.weight + 1)) > 0.5, d3.mean - 1.645 * sqrt(d3.mean * (1 - d3.mean) / (d3.weight + 1)) > 0.5,
    s3.mean - 1.645 * sqrt(s3.mean * (1 - s3.mean) / (s3.weight + 1)) > 0.5, false)),
rules(said, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT page_id, host, path,
  (SELECT arg_max(rhost || rpath, len(rhost || rpath)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
  coalesce((SELECT arg_max(said, len(rhost || rpath)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
    CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts
"""

ORACLE_SQL = {"op3_jaccard_join": OP3, "op9_exact_top_k": OP9, "op11_conversation_repair": OP11, "op13_url_filter": OP13}
