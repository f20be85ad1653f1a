"""DuckDB SQL for the queries whose whole result SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SPACED = r"'[^\x20\x09-\x0D]+'"

WINNOWING = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, {ALNUM}) AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, regexp_extract_all({LOWER}, {ALNUM}) AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k)),
hits AS (SELECT DISTINCT rid, item_id, i, k FROM dw JOIN iw USING (k, g)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
names AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits WHERE item_id IS NOT NULL GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN names USING (rid)
"""

HOST_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, {SPACED}) AS w FROM d),
grams AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
twice AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, {SPACED}) GROUP BY 1),
c AS (SELECT rid, doc_id, host, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 4 * n_symbols > word_chars OR 2 * n_dup_lines > n_lines AS failed FROM c),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE failed) AS f FROM j WHERE host IS NOT NULL GROUP BY 1),
m AS (SELECT avg(f / n) AS m, var_pop(f / n) - avg(f / n) * (1 - avg(f / n)) * avg(1 / n) AS extra FROM h),
p AS (SELECT m, least(1e4, greatest(1.0, m * (1 - m) / greatest(extra, 1e-9) - 1)) AS s FROM m),
v AS (SELECT host, (f + m * s) / (n + s) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND coalesce(rate, 0) <= 0.5 AS kept FROM j LEFT JOIN v USING (host)
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, {SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT rid, g FROM (SELECT rid, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.rid AS u, b.rid AS v, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT u, v FROM o JOIN n a ON a.rid = u JOIN n b ON b.rid = v WHERE 100 * o >= 80 * (a.n + b.n - o)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT rid AS u, rid AS v FROM d UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)
SELECT any_value(a.doc_id) AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b.doc_id) AS component_id FROM r JOIN d a ON a.rid = r.u JOIN d b ON b.rid = r.v LEFT JOIN n ON n.rid = r.u GROUP BY r.u
"""
