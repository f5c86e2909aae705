"""Tables and lists of pages: of ``pages``, and of order pages that are made from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ENTITIES, SILENT
from ..operators import specs
from ..operators import tables as tb
from .registry import query, table

_CLEAN = "regexp_replace(html, '(?s)<!--.*?(?:-->|\\z)', '', 'g')"
for _tag in ("script", "style"):
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)<{_tag}\\b[^<>]*>.*?(?:</{_tag}>|\\z)', '', 'g')"
_TEXT = "regexp_replace(x, '<[^<>]*>', ' ', 'g')"
for _name, _char in ENTITIES:
    _TEXT = "replace({}, '{}', '{}')".format(_TEXT, _name, _char.replace("'", "''"))
_TEXT = f"trim(regexp_replace({_TEXT}, '\\s+', ' ', 'g'))"


@query(
    "page_list_cells",
    f"""WITH c AS (SELECT page_id, {_CLEAN} AS html FROM pages),
    b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<[uo]l\\b[^<>]*>(.*?)</[uo]l>', 1)) AS items, generate_subscripts(regexp_extract_all(html, '(?is)<[uo]l\\b[^<>]*>(.*?)</[uo]l>', 1), 1) - 1 AS block FROM c),
    i AS (SELECT page_id, block, unnest(regexp_extract_all(items, '(?is)<li\\b[^<>]*>(.*?)</li>', 1)) AS x, generate_subscripts(regexp_extract_all(items, '(?is)<li\\b[^<>]*>(.*?)</li>', 1), 1) - 1 AS place FROM b)
    SELECT page_id, block, place, {_TEXT} AS item FROM i""",
)
def page_list_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of every list and table of every page; these pages have lists only."""
    c = tb.cells(table(spark, sf_dir, "pages"), "page_id", "html")
    return c.select(F.col("page").alias("page_id"), "block", F.col("row").alias("place"), F.col("text").alias("item"))


def _order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order: a table of its lines, in which each supplier's cell spans its lines and the sums span columns."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    td = lambda x, more="": F.concat(F.lit(f"<td{more}>"), x.cast("string"), F.lit("</td>"))
    of = F.collect_list(F.struct("l_suppkey", "l_linenumber", "l_partkey", "q"))  # the lines of one order
    o = lines.groupBy("l_orderkey").agg(F.array_sort(of).alias("lines"))
    first = lambda x, i: (i == 0) | (F.get(F.col("lines"), i - 1).l_suppkey != x.l_suppkey)
    many = lambda x: F.size(F.filter("lines", lambda y: y.l_suppkey == x.l_suppkey)).cast("string")
    row = lambda x, i: F.concat(F.lit("<tr>"), F.when(first(x, i), F.concat(F.lit('<td rowspan="'), many(x), F.lit('"><b>'), x.l_suppkey.cast("string"), F.lit("</b></td>"))).otherwise(""), td(x.l_linenumber), td(x.l_partkey), td(x.q), F.lit("</tr>\n"))
    head = "<div><table class=lines><tr><th>Supplier</th><th>Line</th><th>Part&nbsp;</th><th>Qty:</th></tr>"
    body = F.array_join(F.transform("lines", row), "")
    total = F.concat(F.lit("<tr><td colspan=3>all"), td(F.aggregate("lines", F.lit(0), lambda a, x: a + x.q)), F.lit("</table></div>"))
    return o.select(F.col("l_orderkey").alias("page"), F.concat(F.lit(head), body, total).alias("html"))


@query(
    "order_table_records",
    """WITH l AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey, CAST(l_quantity AS INT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_linenumber, l_partkey, l_quantity) AS r FROM lineitem),
    t AS (SELECT l_orderkey, count(*) + 1 AS r, sum(q) AS q FROM l GROUP BY 1)
    SELECT l_orderkey AS page, r, CAST(l_suppkey AS VARCHAR) AS label, unnest(['line', 'part', 'qty']) AS key, unnest([CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(q AS VARCHAR)]) AS value FROM l
    UNION ALL SELECT l_orderkey, r, 'all', unnest(['line', 'part', 'qty']), unnest(['all', 'all', CAST(q AS VARCHAR)]) FROM t""",
)
def order_table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every order read from its page: header row as keys, spans filled, one row for each value."""
    return tb.records(_order_pages(spark, sf_dir), "page", "html").select("page", F.col("row").alias("r"), "label", "key", "value")


_SILENT = "regexp_replace(html, '(?s)<!--.*?(?:-->|\\z)', '', 'g')"
for _tag in SILENT:
    _SILENT = f"regexp_replace({_SILENT}, '(?is)<{_tag}\\b[^<>]*>.*?(?:</{_tag}>|\\z)', '', 'g')"


@query(
    "page_sections",
    f"""WITH a AS (SELECT page_id, regexp_split_to_array({_SILENT}, '(?i)<h[1-6]\\b') AS p FROM pages),
    b AS (SELECT page_id, unnest(p[2:]) AS piece, unnest(range(len(p) - 1)) AS i FROM a),
    c AS (SELECT page_id, i, '<h1' || regexp_extract(piece, '(?is)^(.*?)</h[1-6]\\s*>', 1) AS head, regexp_replace(piece, '(?is)^.*?</h[1-6]\\s*>', '') AS body FROM b),
    d AS (SELECT page_id, i, {_TEXT.replace('(x,', '(head,')} AS heading, {_TEXT.replace('(x,', '(body,')} AS body FROM c)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS place, heading, CASE WHEN regexp_matches(lower(heading), 'the|and') THEN 'english' WHEN regexp_matches(lower(heading), 'que|tion') THEN 'french' ELSE 'other' END AS category, length(body) AS chars FROM d WHERE length(body) BETWEEN 30 AND 5000""",
)
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands under the headings of every page, by the kind of heading."""
    s = specs.sections(F.col("html"), {"english": "the|and", "french": "que|tion"})
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(s).alias("place", "s"))
    return p.select("page_id", F.col("place").cast("long").alias("place"), "s.heading", "s.category", F.length("s.text").cast("long").alias("chars"))
