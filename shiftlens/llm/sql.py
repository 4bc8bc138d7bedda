"""Oracle text in DuckDB's SQL for the queries that it can express."""

from __future__ import annotations

# op1: every window against every document, words between spaces
DECONTAMINATE = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(regexp_extract_all(translate(text,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT item_id, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s, w
    FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS t FROM v),
ks AS (SELECT DISTINCT k FROM win),
p AS (SELECT n, k, unnest(range(1, len(w) - k + 2)) AS s, w FROM d, ks WHERE len(w) >= k),
g AS (SELECT n, k, s, array_to_string(w[s : s + k - 1], ' ') AS t FROM p),
h AS (SELECT g.n, g.s, g.k, win.item_id FROM g JOIN win ON g.k = win.k AND g.t = win.t),
c AS (SELECT n, count(DISTINCT x) AS n_hit FROM (SELECT n, unnest(range(s, s + k)) AS x FROM h) GROUP BY n),
m AS (SELECT n, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
    FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (n) LEFT JOIN m USING (n)
"""

# op3: a hash of every window, the smallest document of each
SUBSTRINGS = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
k AS (SELECT n, doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS s FROM (SELECT n, doc_id,
    list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i : i + 49], ' '))) AS hs
    FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h),
g AS (SELECT DISTINCT n, unnest(range(s, s + 50)) AS x FROM k JOIN f USING (h) WHERE first < doc_id),
u AS (SELECT n, unnest(w) AS word, generate_subscripts(w, 1) AS x FROM d),
r AS (SELECT u.n, string_agg(word, ' ' ORDER BY u.x) AS kept, count(*) AS stay
    FROM u ANTI JOIN g ON u.n = g.n AND u.x = g.x GROUP BY u.n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(stay, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (n)
"""

# op7: classes by their sorted shingles, pairs by shared shingles, groups by reachability
NGRAM_JOIN = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2),
      lambda i: array_to_string(w[i : i + least(5, len(w)) - 1], ' ')))) AS sh FROM d WHERE len(w) > 0),
c AS (SELECT sh, min(doc_id) AS rep FROM s GROUP BY sh),
x AS (SELECT rep, len(sh) AS n, unnest(sh) AS t FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.t = b.t AND a.rep < b.rep
    GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(v, l) AS (SELECT rep, rep FROM c UNION SELECT e.b, r.l FROM r JOIN e ON e.a = r.v),
g AS (SELECT v, min(l) AS label FROM r GROUP BY v),
k AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(rep, d.doc_id) AS class_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links,
  coalesce(label, d.doc_id) AS group_id
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c ON s.sh = c.sh LEFT JOIN g ON g.v = rep LEFT JOIN k ON k.a = rep
"""

# op8: the rules as rows, the longest that fits wins
URL_FILTER = r"""
WITH r(rule, host, path, verdict) AS (VALUES
    ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
    ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
    ('com/de/', 'com', '/de/', 'block')),
u AS (SELECT page_id, CASE WHEN contains(url, '://')
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS n FROM pages),
p AS (SELECT page_id, n, coalesce(translate(regexp_extract(rest, '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '')
      AS path FROM u),
f AS (SELECT p.*, r.rule, r.verdict, row_number() OVER (
      PARTITION BY p.n ORDER BY length(r.rule) DESC NULLS LAST, r.rule) AS place
    FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host))
      AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, CASE
    WHEN regexp_matches(host || path, '\.(exe|zip|tar\.gz|dmg|jpg|jpeg|png|gif|svg)$')
      OR regexp_matches(host || path, '^[^/]*/(login|signin|wp-admin/)') THEN 'block'
    ELSE 'allow' END) AS verdict
FROM f WHERE place = 1
"""

# op9: every query against every row
EXACT_TOPK = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))
      AS ints, row_number() OVER () AS n FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.ints, c.ints),
      lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

# op11: every line with its key, the documents of each
LINE_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT n, doc_id, line, i, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
    FROM (SELECT n, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d)),
r AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 AND doc_id IS NOT NULL
    GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
x AS (SELECT l.n, l.line, l.i, coalesce(l.doc_id < r.last, false) AS gone FROM l LEFT JOIN r ON l.k = r.k),
o AS (SELECT n, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM x GROUP BY n)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256
FROM d JOIN o USING (n)
"""

# op12: every anchor against every row
HARD_NEGATIVES = r"""
WITH v AS (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.n, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id,
      CAST(list_sum(list_transform(list_zip(a.ints, c.ints), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v a JOIN v c ON a.n <> c.n WHERE a.vec_id % 100 = 0),
p AS (SELECT n, vec_id AS positive_id, score AS positive_score,
      row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
r AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
      row_number() OVER (PARTITION BY s.n, place ORDER BY score DESC, vec_id) AS rank
    FROM s JOIN p ON s.n = p.n WHERE NOT same AND place <= 5
      AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM r WHERE rank <= 10
"""

ORACLES = {
    "op1_decontaminate": DECONTAMINATE,
    "op3_substrings": SUBSTRINGS,
    "op7_ngram_join": NGRAM_JOIN,
    "op8_url_filter": URL_FILTER,
    "op9_exact_topk": EXACT_TOPK,
    "op11_line_dedup": LINE_DEDUP,
    "op12_hard_negatives": HARD_NEGATIVES,
}
