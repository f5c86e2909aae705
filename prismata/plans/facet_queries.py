"""Faceted search over ``part``: words of the name as an array facet, type, brand, size and price."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import as_strings, demote_last
from ..operators import facets as fc
from ..operators import search_index
from ..operators.facet_url import parse, serialise
from ..sources.shared import shared_dir
from .registry import query, table

FACETS = [
    fc.Facet("type", kind="multi", searchable=True, sortable=True),
    fc.Facet("tokens", kind="boolean", modes=("any", "all"), searchable=True),
    fc.Facet("brand", kind="multi", modes=("any",), searchable=True, sortable=True),
    fc.Facet("size", kind="range", modes=("any",), low=1, high=50, sortable=True),
    fc.Facet("price", kind="range", modes=("any",), low=900, high=1000, sortable=True),
]
SEARCHABLE = ["model", "brand", "type", "tokens"]
URL = "?type=ECONOMY,PROMO&tokens=red,blue,~rod&price=905,990,dec&size=5,_"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("model"),
        F.split("p_name", " ").alias("tokens"),
        F.col("p_brand").alias("brand"),
        F.array("p_type").alias("type"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
    )


CAT = "(SELECT p_partkey AS id, p_name AS model, string_split(p_name, ' ') AS tokens, p_brand AS brand, [p_type] AS type, p_size AS size, p_retailprice AS price FROM part)"


def _multi(name: str, column: str, selected: tuple[str, ...], mode: str, where: str) -> None:
    @query(name, f"SELECT id, model FROM {CAT} c WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = catalogue(spark, sf_dir)
        return c.where(fc.predicate(fc.Spec((fc.Multi(column, selected, mode),)), c.schema)).select("id", "model")


_multi("facet_any", "tokens", ("red", "gear"), "any", "list_has_any(tokens, ['red', 'gear'])")
_multi("facet_all", "tokens", ("red", "gear"), "all", "list_has_all(tokens, ['red', 'gear']) AND len(tokens) >= 2")
_multi("facet_only", "tokens", ("red", "gear", "rod"), "only", "list_has_all(['red', 'gear', 'rod'], tokens) AND len(tokens) <= 3")
_multi("facet_none", "tokens", ("red", "gear"), "none", "NOT list_has_any(tokens, ['red', 'gear'])")
_multi("facet_scalar_string", "brand", ("Brand#1", "Brand#2"), "any", "brand IN ('Brand#1', 'Brand#2')")


def _yes_no(name: str, mode: str, where: str) -> None:
    @query(name, f"SELECT id, model FROM {CAT} c WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = catalogue(spark, sf_dir)
        return c.where(fc.predicate(fc.Spec((fc.YesNo("tokens", ("red",), ("gear", "rod"), mode),)), c.schema)).select("id", "model")


_yes_no("facet_boolean_all", "all", "list_contains(tokens, 'red') AND NOT list_contains(tokens, 'gear') AND NOT list_contains(tokens, 'rod')")
_yes_no("facet_boolean_any", "any", "list_contains(tokens, 'red') OR NOT list_contains(tokens, 'gear') OR NOT list_contains(tokens, 'rod')")


@query("facet_range_scalar", f"SELECT id, price FROM {CAT} c WHERE price >= 905 AND price <= 950")
def facet_range_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalogue(spark, sf_dir)
    return c.where(fc.predicate(fc.Spec((fc.Range("price", 905, 950),)), c.schema)).select("id", "price")


@query("facet_range_array", "SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING bool_or(l_quantity BETWEEN 49 AND 50)")
def facet_range_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with any sold quantity inside the window, the quantities being an array cell."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set("l_quantity").alias("quantities"), F.count(F.lit(1)).alias("n"))
    return rows.where(fc.predicate(fc.Spec((fc.Range("quantities", 49, 50),)), rows.schema)).select("id", "n")


@query(
    "facet_conjunction_default",
    f"SELECT id, completeness FROM (SELECT *, (model <> '')::INT + (brand <> '')::INT + (size > 10)::INT * 4 + (price > 905)::INT * 3 AS completeness FROM {CAT} c) WHERE completeness >= 8 AND NOT list_has_any(type, ['accessory', 'blog'])",
)
def facet_conjunction_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default quality filter over a small completeness score."""
    score = (F.col("model") != "").cast("int") + (F.col("brand") != "").cast("int") + (F.col("size") > 10).cast("int") * 4 + (F.col("price") > 905).cast("int") * 3
    c = catalogue(spark, sf_dir).withColumn("completeness", score)
    return c.where(fc.predicate(fc.Spec(fc.default_quality()), c.schema)).select("id", "completeness")


@query("facet_show_unknown", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 OR l.quality IS NULL")
def facet_show_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.where(fc.predicate(fc.Spec((fc.Range("quality", 1, 1, unknown=True),)), d.schema))


@query("facet_inactive_pruned", f"SELECT count(*) AS n FROM {CAT} c")
def facet_inactive_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters without a selection or bound give no predicate."""
    c = catalogue(spark, sf_dir)
    spec = fc.Spec((fc.Multi("tokens", ()), fc.YesNo("tokens"), fc.Range("price"), fc.Multi("no_such_column", ("x",))))
    return c.where(fc.predicate(spec, c.schema)).agg(F.count(F.lit(1)).alias("n"))


@query("facet_options", f"SELECT value, count(*) AS n FROM (SELECT id, unnest(list_distinct(tokens)) AS value FROM {CAT} c) WHERE value <> '' AND value <> 'unknown' GROUP BY 1")
def facet_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.options(catalogue(spark, sf_dir), "tokens")


@query("facet_counts", "SELECT 'brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY 2")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value histograms of several facets in one pass: facets are exploded before one aggregate."""
    c = catalogue(spark, sf_dir)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), as_strings(F.col(f), c.schema[f].dataType).alias("values")) for f in ("brand", "type")]))
    t = c.select(cells.alias("x")).select("x.facet", F.explode("x.values").alias("value"))
    return t.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


@query("facet_bounds", "SELECT min(value) AS low, max(value) AS high FROM events WHERE value > 0")
def facet_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.bounds(table(spark, sf_dir, "events"), "value")


@query(
    "facet_option_priority",
    "SELECT value, row_number() OVER (ORDER BY CASE value WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 ELSE 3 END, value) AS place FROM (SELECT DISTINCT p_type AS value FROM part)",
)
def facet_option_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.prioritised(fc.options(catalogue(spark, sf_dir), "type").select("value"), ["PROMO", "SMALL"])


_URL_WHERE = "p_type IN ('ECONOMY', 'PROMO') AND (contains(p_name, 'red') OR contains(p_name, 'blue') OR NOT contains(p_name, 'rod')) AND p_retailprice BETWEEN 905 AND 990 AND p_size >= 5"


@query("facet_url_query", f"SELECT p_partkey AS id, p_name AS model, p_retailprice AS price, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part WHERE {_URL_WHERE} QUALIFY place <= 200")
def facet_url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a search from its URL; the first 200 rows by price."""
    from pyspark.sql import Window

    c = catalogue(spark, sf_dir)
    top = fc.query(c, parse(URL, FACETS), "id", SEARCHABLE).limit(200)
    return top.select("id", "model", "price", F.row_number().over(Window.orderBy(F.desc("price"), "id")).cast("long").alias("place"))


@query("facet_url_roundtrip", f"SELECT p_partkey AS id FROM part WHERE {_URL_WHERE}")
def facet_url_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same predicate after writing the search as a URL and reading it again."""
    c = catalogue(spark, sf_dir)
    again = parse(serialise(parse(URL, FACETS), FACETS), FACETS)
    return c.where(fc.predicate(again, c.schema)).select("id")


_SEARCH = "lower(p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_name)"


@query("search_substring_multi", f"SELECT p_partkey AS id FROM part WHERE contains({_SEARCH}, 'red') AND contains({_SEARCH}, 'eco')")
def search_substring_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalogue(spark, sf_dir)
    return c.where(fc.words_match(fc.search_text(c.schema, SEARCHABLE), "Red eco")).select("id")


@query(
    "search_fuzzy",
    f"SELECT p_partkey AS id FROM part WHERE contains({_SEARCH}, 'wdget') OR len(list_filter(range(1, length({_SEARCH}) - 2), lambda i: regexp_matches(substring({_SEARCH}, i, 6), '^w.*?d.*?g.*?e.*?t'))) > 0",
)
def search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing letter in the query still finds ``widget``; the index of character pairs leaves few rows to test."""
    c = catalogue(spark, sf_dir)
    text, path = fc.search_text(c.schema, SEARCHABLE), f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    search_index.build(c, "id", text, path)
    return search_index.search(c, "id", text, "wdget", spark.read.parquet(path)).select("id")


@query(
    "search_candidates",
    f"""WITH t AS (SELECT p_partkey AS id, {_SEARCH} AS s FROM part)
    SELECT count(*) AS rows, count(*) FILTER (contains(s, 'wd') OR (contains(s, 'ge') AND contains(s, 'et'))) AS candidates FROM t""",
)
def search_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows the index leaves for the exact test."""
    c = catalogue(spark, sf_dir)
    path = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    search_index.build(c, "id", fc.search_text(c.schema, SEARCHABLE), path)
    hits = search_index.candidates(spark.read.parquet(path), "wdget").withColumn("hit", F.lit(1))
    return c.join(hits, "id", "left").agg(F.count(F.lit(1)).alias("rows"), F.count("hit").alias("candidates"))


@query("sort_dec_nulls_last_topk", "SELECT id, key, row_number() OVER (ORDER BY key DESC NULLS LAST, id) AS place FROM (SELECT d.doc_id AS id, l.quality AS key FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) QUALIFY place <= 150")
def sort_dec_nulls_last_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted_docs(spark, sf_dir, True)


@query("sort_inc_reverse", "SELECT id, key, row_number() OVER (ORDER BY key ASC NULLS FIRST, id DESC) AS place FROM (SELECT d.doc_id AS id, l.quality AS key FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) QUALIFY place <= 150")
def sort_inc_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ascending is the exact reverse of descending: empty cells first, ties reversed."""
    return _sorted_docs(spark, sf_dir, False)


def _sorted_docs(spark: SparkSession, sf_dir: str, descending: bool) -> DataFrame:
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    d = d.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("key")), "id", "left")
    order = fc.order_by(d.schema, "key", descending, "id")
    return d.orderBy(*order).limit(150).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query("page_offset", "SELECT p_partkey AS id FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100 OFFSET 50")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalogue(spark, sf_dir)
    return fc.page(fc.query(c, fc.Spec(sort="price"), "id").select("id"), 1)


@query("like_any_search", "SELECT p_partkey AS id, p_name AS model FROM part WHERE p_name ILIKE '%WIDGET%' OR p_brand ILIKE '%brand#17%' OR length(p_name) > 80")
def like_any_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalogue(spark, sf_dir)
    return c.where(F.col("model").ilike("%WIDGET%") | F.col("brand").ilike("%brand#17%") | (F.length("model") > 80)).select("id", "model")


@query("facet_option_search", "SELECT DISTINCT p_brand AS value FROM part WHERE contains(lower(p_brand), '#1') ORDER BY value LIMIT 20")
def facet_option_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fc.options(catalogue(spark, sf_dir), "brand")
    return o.where(F.contains(F.lower("value"), F.lit("#1"))).select("value").orderBy("value").limit(20)


@query("facet_inversion", "SELECT p_partkey AS id FROM part WHERE p_type NOT IN ('PROMO', 'SMALL')")
def facet_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All options but the selected ones."""
    c = catalogue(spark, sf_dir)
    return c.where(fc.predicate(fc.Spec((fc.inverted(fc.Multi("type", ("PROMO", "SMALL"))),)), c.schema)).select("id")


@query("pinned_only", "SELECT p_partkey AS id, p_name AS model FROM part WHERE p_partkey IN (1, 5, 7, 1000000)")
def pinned_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).where(F.col("id").isin(1, 5, 7, 1000000)).select("id", "model")


@query("item_order_demotion", "SELECT p_partkey AS id, CASE WHEN p_name LIKE 'red %' THEN substring(p_name, 5) || ',red' ELSE replace(p_name, ' ', ',') END AS items FROM part")
def item_order_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array whose first item matches gives it the last place."""
    return catalogue(spark, sf_dir).select("id", F.array_join(demote_last(F.col("tokens"), "^red$"), ",").alias("items"))
