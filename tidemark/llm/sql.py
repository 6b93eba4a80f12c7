"""DuckDB SQL that gives the same rows as the operators, where SQL can."""

from __future__ import annotations

NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), ok AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
    AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, comp.c AS component_id, e.vec_id = comp.c AS kept
FROM embeddings e JOIN comp ON comp.a = e.vec_id
"""


def url_filters(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in rules)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    part = "regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', {}, 's')"
    return f"""
WITH rules(action, rhost, rpath) AS (VALUES {values}),
p AS (SELECT page_id, {lower.format(part.format(1))} AS host, {part.format(2)} AS path FROM pages),
m AS (
  SELECT p.page_id, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY p.page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1
"""


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

NGRAM_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 75 * (na + nb - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT s.doc_id, len(s.g) AS n_shingles, comp.c AS component_id FROM s JOIN comp ON comp.a = s.doc_id
"""

REPEATED_BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS i, h FROM d WHERE length(h) >= 200),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS m FROM w),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS n FROM k),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM r WHERE n > 1),
t AS (SELECT doc_id, i, sum(CASE WHEN gap IS NULL OR gap > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS e FROM t GROUP BY doc_id, span),
x AS (SELECT s.doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS before, h FROM s JOIN d ON d.doc_id = s.doc_id),
y AS (SELECT doc_id, sum(e - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(e) + 1) AS kept FROM x GROUP BY doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(y.removed, 0)::BIGINT AS n_removed, coalesce(y.spans, 0) AS n_spans, sha256(unhex(coalesce(y.kept, d.h))) AS kept_sha256
FROM d LEFT JOIN y ON y.doc_id = d.doc_id
"""

REPEATED_LINES = """
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_at FROM a),
v AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM u),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_at) AS k, sum(words) OVER (PARTITION BY doc_id ORDER BY line_at) AS upto FROM v WHERE words > 0),
e AS (SELECT x.doc_id, x.k, min(y.k) AS last FROM w x JOIN w y ON x.doc_id = y.doc_id AND y.k BETWEEN x.k AND x.k + 7 AND y.upto - x.upto + x.words >= 8 GROUP BY ALL
  UNION SELECT y.doc_id, max(x.k) AS k, y.k AS last FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.k BETWEEN y.k - 7 AND y.k AND y.upto - x.upto + x.words >= 8 GROUP BY y.doc_id, y.k),
r AS (SELECT e.doc_id, e.k, e.last, md5(string_agg(w.line, chr(10) ORDER BY w.k)) AS run FROM e JOIN w ON w.doc_id = e.doc_id AND w.k BETWEEN e.k AND e.last GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, k) AS i FROM r),
gone AS (SELECT DISTINCT w.doc_id, w.k, w.line_at FROM n JOIN w ON w.doc_id = n.doc_id AND w.k BETWEEN n.k AND n.last WHERE n.i > 1),
s AS (SELECT doc_id, count(*) AS removed, sum(new) AS runs FROM (SELECT doc_id, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) = 1 THEN 0 ELSE 1 END AS new FROM gone) GROUP BY doc_id),
t AS (SELECT u.doc_id, string_agg(u.line, chr(10) ORDER BY u.line_at) AS kept FROM u LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.line_at = u.line_at WHERE g.doc_id IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(s.removed, 0) AS n_removed, coalesce(s.runs, 0)::BIGINT AS n_runs, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
