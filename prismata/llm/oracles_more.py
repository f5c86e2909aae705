"""SQL of the suffix dedup, the reply trees, the resampling and the vector codes."""

from __future__ import annotations

from . import importance, reply_trees, suffix_dedup, vector_codes
from .oracles import _quoted


def conversations() -> str:
    """Turns and answers straight from the rows; only the formatted length needs the template."""
    control = _quoted(reply_trees.CONTROL)
    escape = lambda c: f"regexp_replace({c}, '{control}', '\\1\\\\\\2\\3', 'g')"
    extra = " UNION ALL ".join(f"SELECT {c}, {t}, '{_quoted(r)}', '{_quoted(x)}'" for c, t, r, x in reply_trees.CONTROL_ROWS)
    marks = len(reply_trees.OPEN + reply_trees.ROLE_END + reply_trees.CLOSE)
    order = "ORDER BY turn NULLS FIRST, role, sha256(text)"
    learnt = f"coalesce(string_agg(text, '' {order}) FILTER (role = '{reply_trees.LEARNT}'), '')"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {extra})),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' {order}) AS said, {learnt} AS learnt, CAST(sum({marks} + length({escape("role")}) + length({escape("text")})) AS BIGINT) AS chars FROM c GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(said) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, chars AS formatted_chars FROM g
"""


def resampling(buckets: int = importance.BUCKETS) -> str:
    """Order 1 only; crc32 from its table of 256 remainders, once for each distinct word."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}')"
    ln = f"ln((CAST(t + 1 AS DOUBLE) * CAST(ss.n + {buckets} AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(tt.n + {buckets} AS DOUBLE)))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
f AS (SELECT r, unnest(w) AS word FROM d),
b AS (SELECT unnest({words}) AS word FROM benchmark),
poly AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM f UNION SELECT DISTINCT word FROM b)),
bytes AS (SELECT word, list_transform(range(CAST(length(h) // 2 AS BIGINT)), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT)) AS a FROM v),
crc AS (SELECT word, xor(list_reduce(list_prepend(4294967295, a), lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295) % {buckets} AS bucket FROM bytes, poly),
s AS (SELECT bucket, count(*) AS s FROM f JOIN crc USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN crc USING (word) GROUP BY 1),
ss AS (SELECT coalesce(sum(s), 0) AS n FROM s), tt AS (SELECT coalesce(sum(t), 0) AS n FROM t),
gain AS (SELECT bucket, CAST(floor({importance.SCALE} * {ln}) AS BIGINT) AS gain FROM (SELECT bucket, s, coalesce(t, 0) AS t FROM s LEFT JOIN t USING (bucket)), ss, tt),
sums AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY 1),
h AS (SELECT r, doc_id, CAST('0x' || sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h FROM d),
one AS (SELECT h.doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight, CAST(floor(-{importance.SCALE} * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS noise FROM h LEFT JOIN sums USING (r)),
scored AS (SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + noise AS BIGINT) AS score, n_features >= {importance.LEAST_WORDS} AS enough FROM one),
placed AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (enough) OVER () AS there FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= {importance.PERCENT} * there // 100 THEN place END AS rank FROM placed
"""


def vectors(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """Every distance in every round; for ids and vectors without gaps."""
    near = lambda i: f"near{i} AS MATERIALIZED (SELECT v, vec_id, part, x, min({{'d': d, 'e': entry}}) AS m FROM (SELECT p.v, p.vec_id, p.part, p.x, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN book{i} b USING (part)) GROUP BY v, vec_id, part, x)"
    moved = lambda i: f"""
sum{i} AS (SELECT part, entry, j, CAST(sum(x) AS BIGINT) AS x, count(*) AS n FROM (SELECT part, m.e AS entry, unnest(x) AS x, unnest(range(len(x))) AS j FROM near{i}) GROUP BY part, entry, j),
mean{i} AS (SELECT part, entry, list((x - ((x % n) + n) % n) // n ORDER BY j) AS x FROM sum{i} GROUP BY part, entry),
book{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN mean{i} m USING (part, entry))"""  # noqa: E731
    steps = ",\n".join(f"{near(i)},{moved(i)}" for i in range(rounds))
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS v, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {vector_codes.SCALE}) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT v, vec_id, q AS part, e[q * len(e) // {parts} + 1 : (q + 1) * len(e) // {parts}] AS x FROM k, (SELECT unnest(range({parts})) AS q)),
book0 AS MATERIALIZED (SELECT part, v AS entry, x FROM p WHERE v < {entries}),
{steps},
{near(rounds)},
code AS (SELECT v, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{rounds} GROUP BY v),
told AS (SELECT k.vec_id, k.label, code.code, code.error FROM k JOIN code USING (v)),
sha AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM told, sha
"""


def repeats(length: int = suffix_dedup.LENGTH) -> str:
    """Every window of ``length`` bytes by its digest, cut from pieces of the text in hexadecimal."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, o, substring(h, 2 * o + 1, 2 * (1024 + {length - 1})) AS h FROM (SELECT r, h, unnest(range(0, len(h) // 2, 1024)) AS o FROM d)),
w AS (SELECT r, o, unnest(range(greatest(0, least(1024, len(h) // 2 - {length - 1})))) AS i, h FROM p),
k AS (SELECT r, o + i AS i, md5(substring(h, 2 * i + 1, {2 * length})) AS m FROM w),
t AS (SELECT m FROM k GROUP BY m HAVING count(*) > 1),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM k SEMI JOIN t USING (m)),
run AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i - before > {length} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS n FROM hit),
span AS (SELECT r, n, min(i) AS a, max(i) + {length} AS b FROM run GROUP BY r, n),
cut AS (SELECT r, list({{'a': a, 'b': b}} ORDER BY a) AS s, count(*) AS n_spans, sum(b - a) AS n_removed FROM span GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN s IS NULL THEN h ELSE array_to_string(list_transform(range(len(s) + 1), lambda j: substring(h, CASE WHEN j = 0 THEN 1 ELSE 2 * s[j].b + 1 END, CASE WHEN j = len(s) THEN len(h) ELSE 2 * (s[j + 1].a - CASE WHEN j = 0 THEN 0 ELSE s[j].b END) END)), '') END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
