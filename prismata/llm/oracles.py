"""The same results in plain SQL, where SQL can say them."""

from __future__ import annotations

from . import secret_scan

JACCARD = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS s FROM t),
d AS (SELECT r, doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS k FROM g),
one AS (SELECT k, min(r) AS r, any_value(n) AS n, count(*) AS copies FROM d WHERE n > 0 GROUP BY 1),
s AS (SELECT o.k, unnest(g.s) AS x FROM one o JOIN g ON g.r = o.r),
pair AS (SELECT a.k AS k, b.k AS l, count(*) AS both FROM s a JOIN s b ON a.x = b.x AND a.k <> b.k GROUP BY 1, 2),
link AS (SELECT p.k, p.l, b.copies FROM pair p JOIN one a ON a.k = p.k JOIN one b ON b.k = p.l WHERE p.both >= 0.8 * (a.n + b.n - p.both)),
reach AS (SELECT k, k AS l FROM one UNION SELECT r.k, e.l FROM reach r JOIN link e ON e.k = r.l),
class AS (SELECT r.k, min(d.doc_id) AS class_id FROM reach r JOIN d ON d.k = r.l AND d.n > 0 GROUP BY 1),
degree AS (SELECT k, count(*) AS texts, sum(copies) AS docs FROM link GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.n = 0 THEN d.doc_id ELSE c.class_id END AS class_id, CASE WHEN d.n = 0 THEN 0 ELSE CAST(o.copies - 1 + coalesce(e.docs, 0) AS BIGINT) END AS n_links, CASE WHEN d.n = 0 THEN 0 ELSE coalesce(e.texts, 0) END AS n_texts
FROM d LEFT JOIN one o ON o.k = d.k AND d.n > 0 LEFT JOIN class c ON c.k = d.k AND d.n > 0 LEFT JOIN degree e ON e.k = d.k AND d.n > 0
"""


def _quoted(s: str) -> str:
    return s.replace("'", "''")


def _spans(rule: secret_scan.Rule, number: int) -> str:
    """Spans of one rule: starts are the lengths of all pieces and matches before."""
    p = f"'{_quoted(rule.java)}'"
    whole, value, gaps = f"regexp_extract_all(text, {p}, 0)", f"regexp_extract_all(text, {p}, {rule.value})", f"regexp_split_to_array(text, {p})"
    ends = f"list_transform(range(1, len({whole}) + 1), lambda i: list_sum(list_transform({gaps}[1:i], lambda x: length(x))) + list_sum(list_transform({whole}[1:i], lambda x: length(x))))"
    rows = f"list_transform(list_zip({ends}, {whole}, {value}), lambda z: {{'s': CAST(z[1] - length(z[2]) AS BIGINT), 'k': {number}, 'e': CAST(z[1] AS BIGINT), 'n': length(z[3])}})"
    return f"list_filter({rows}, lambda z: z.n >= {rule.least})"


def secrets(rules: list[secret_scan.Rule] = secret_scan.RULES) -> str:
    names = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    lists = ", ".join(f"{_spans(r, i)} AS l{i}" for i, r in enumerate(rules))
    listed = lambda these: f"array_to_string(list_transform(list_sort(flatten([{', '.join(f'l{i}' for i in these)}])), lambda z: {names}[z.k + 1] || ':' || z.s || ':' || z.e), ',')"
    base = [i for i, r in enumerate(rules) if r.base]
    counts = ", ".join(f"CAST(len(l{i}) AS BIGINT) AS n_{rules[i].kind}" for i in base)
    return f"SELECT doc_id, {counts}, sha256({listed(base)}) AS base_sha256, {listed(range(len(rules)))} AS spans FROM (SELECT doc_id, {lists} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"
