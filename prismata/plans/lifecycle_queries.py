"""Life of catalogue rows: filters, display strings, candidates, fills, repairs and loops until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as ce
from ..functions import display as di
from ..functions import numbers as nu
from ..functions import text as tx
from ..functions import urls as ur
from ..operators import entities as en
from .registry import query, table


@query("lifecycle_filter", "SELECT p_partkey AS id FROM part WHERE p_type NOT IN ('SMALL', 'removed')")
def lifecycle_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose first type is no ended one; a row without a type goes too."""
    p = table(spark, sf_dir, "part")
    return p.where(~ce.first_item(F.array("p_type")).isin("SMALL", "removed")).select(F.col("p_partkey").alias("id"))


# fixed values: hosts that count as retailers on the driver's pages
RETAILERS = r"//(?:www\.|m\.|blog\.)"
_LINKED = "list_concat([url], regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"(https?://[^\"]+)\"', 1))"
_MAKER = f"len(list_filter({_LINKED}, lambda u: u IS NOT NULL AND u <> '' AND NOT regexp_matches(u, '{RETAILERS}'))) > 0"


@query("maker_url", f"SELECT page_id, {_MAKER} AS has_maker FROM pages")
def maker_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any URL of a row is not a retailer's."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", ur.any_outside(F.concat(F.array("url"), F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="(https?://[^"]+)"'), F.lit(1))), RETAILERS).alias("has_maker"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '')"


@query("makers_without_url", f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1 HAVING NOT bool_or({_MAKER})")
def makers_without_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups none of whose rows has a URL that is not a retailer's."""
    p = table(spark, sf_dir, "pages")
    urls = F.concat(F.array("url"), F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="(https?://[^"]+)"'), F.lit(1)))
    t = p.select(ur.host(F.col("url")).alias("host"), ur.any_outside(urls, RETAILERS).alias("ok"))
    return t.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.bool_or("ok").alias("ok")).where("not ok").select("host", "n")


@query(
    "mode_strings",
    """SELECT l_orderkey AS id, string_agg(coalesce(nullif(concat_ws(' / ', CASE WHEN l_linenumber <= 3 THEN CAST(l_quantity AS BIGINT) || ' lum' END, CASE WHEN l_linenumber <= 2 THEN CAST(l_linenumber AS VARCHAR) || 'h' END), ''), l_returnflag), '; ' ORDER BY l_linenumber, l_quantity, l_returnflag) AS modes FROM lineitem GROUP BY 1""",
)
def mode_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs, runtimes and names of unequal number, zipped to one string per mode."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag")))  # the lines of one order
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(rows.alias("r"))
    lumens = F.transform(F.filter("r", lambda x: x["l_linenumber"] <= 3), lambda x: x["l_quantity"].cast("long").cast("string"))
    hours = F.transform(F.filter("r", lambda x: x["l_linenumber"] <= 2), lambda x: x["l_linenumber"].cast("string"))
    return t.select("id", F.array_join(di.mode_strings(lumens, hours, F.col("r.l_returnflag")), "; ").alias("modes"))


@query("measurement_strings", "SELECT p_partkey AS id, concat_ws(', ', CASE WHEN p_size > 10 THEN p_size || 'mm' END, CASE WHEN p_size % 2 = 0 THEN '⌀' || p_size || 'mm head' END, CASE WHEN p_partkey % 5 = 0 THEN p_partkey || 'g' END) AS measures FROM part")
def measurement_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    parts = [(F.when(F.col("p_size") > 10, F.col("p_size")), "{}mm"), (F.when(F.col("p_size") % 2 == 0, F.col("p_size")), "⌀{}mm head"), (F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey")), "{}g")]
    return p.select(F.col("p_partkey").alias("id"), F.array_join(di.labelled(parts), ", ").alias("measures"))


_TITLE = "nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^<>]*>(.*?)(?:</title>|\\z)', 1), '\\s+', ' ', 'g')), '')"
for _name, _char in (("&nbsp;", " "), ("\u00a0", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    _TITLE = f"replace({_TITLE}, '{_name}', '{_char}')"


@query("display_cells", f"SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN '?' ELSE p_size || ' mm' END AS length, {_TITLE} AS title, CASE WHEN p_size % 3 = 0 THEN '?' ELSE p_type || ' ' || p_brand END AS terms FROM part LEFT JOIN pages ON page_id = p_partkey")
def display_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as they are shown: unit template, ``?`` for unknown ones, lists joined, references decoded."""
    titles = table(spark, sf_dir, "pages").select(F.col("page_id").alias("p_partkey"), di.without_references(ur.title(F.col("html"))).alias("title"))
    p = table(spark, sf_dir, "part").join(titles, "p_partkey", "left")
    return p.select(
        F.col("p_partkey").alias("id"),
        di.cell(F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("string")), "{} mm").alias("length"),
        "title",
        di.cell_list(F.when(F.col("p_size") % 3 != 0, F.array("p_type", "p_brand"))).alias("terms"),
    )


@query("year_in_text", "SELECT doc_id, CAST(nullif(regexp_extract(text, '20[12][0-9]'), '') AS INT) AS year FROM documents")
def year_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.year(F.col("text")).alias("year"))


@query("source_union", "SELECT url FROM pages WHERE page_id % 2 = 0 UNION SELECT url FROM pages WHERE page_id % 3 = 0")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of two sources, each once."""
    p = table(spark, sf_dir, "pages")
    return en.united(p.where("page_id % 2 = 0").select("url"), p.where("page_id % 3 = 0").select("url"))


@query("filtered_then_first", "SELECT p_partkey AS id, p_size AS size FROM part WHERE p_brand <> 'Brand#11' AND p_size > 5 ORDER BY p_size DESC, p_partkey LIMIT 15")
def filtered_then_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first n of what passes the filter, so nothing must be fetched in excess."""
    p = table(spark, sf_dir, "part").where("p_brand <> 'Brand#11' AND p_size > 5")
    return p.orderBy(F.desc("p_size"), "p_partkey").limit(15).select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))


@query(
    "variant_candidate",
    "SELECT a.p_partkey AS id, min(b.p_partkey) AS candidate FROM part a JOIN part b ON b.p_brand = a.p_brand AND b.p_name IN (replace(a.p_name, 'red', 'blue'), replace(a.p_name, 'small', 'large')) AND b.p_partkey <> a.p_partkey GROUP BY 1",
)
def variant_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of the same brand whose name is one of two variants of a row's own."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"))
    variants = [F.replace("name", F.lit("red"), F.lit("blue")), F.replace("name", F.lit("small"), F.lit("large"))]
    return en.variant_candidates(p, p, "brand", "name", "id", variants)


@query(
    "prefix_price",
    "SELECT a.p_name || ' ' || a.p_brand AS key, min(b.p_retailprice) AS price FROM part a JOIN part b ON starts_with(a.p_name || ' ' || a.p_brand, b.p_name) AND length(b.p_name) >= 8 AND b.p_retailprice >= 15 AND a.p_name || ' ' || a.p_brand <> b.p_name WHERE a.p_partkey % 4 = 0 GROUP BY 1",
)
def prefix_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest plausible price among long enough model names that a key begins with; equal keys are left out."""
    p = table(spark, sf_dir, "part")
    keys = p.where("p_partkey % 4 = 0").select(F.concat_ws(" ", "p_name", "p_brand").alias("key")).distinct()
    models = p.where("p_retailprice >= 15").groupBy(F.col("p_name").alias("model")).agg(F.min("p_retailprice").alias("price"))
    return en.prefix_match(keys, models, "key", "model", 8).groupBy("key").agg(F.min("price").alias("price"))


@query("append_points", "SELECT user_id, count(*) AS n, max(ts) AS last FROM (SELECT user_id, ts FROM events UNION ALL SELECT user_id, ts + INTERVAL 1 DAY FROM events WHERE event_id % 10 = 0) GROUP BY 1")
def append_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price point is added, never compared with what is there."""
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    new = table(spark, sf_dir, "events").where("event_id % 10 = 0").select("user_id", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    return e.unionByName(new).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


@query(
    "verdict_apply",
    "SELECT p.p_partkey AS id, CASE WHEN p.p_partkey % 3 = 0 THEN CASE l.toxic WHEN 1 THEN 'red' ELSE 'green' END ELSE split_part(p.p_name, ' ', 1) END AS color, CASE WHEN l.quality = 0 THEN 'accessory' ELSE p.p_type END AS type FROM part p JOIN labels l ON l.doc_id = p.p_partkey",
)
def verdict_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier's verdict fills empty cells through a map, and a negative one turns the row into an accessory."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 != 0, F.split_part("p_name", F.lit(" "), F.lit(1))).alias("color"), F.col("p_type").alias("type"))
    v = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("string").alias("color"), (F.col("quality") == 1).alias("ok"))
    return en.verdict_applied(p, v.where("color is not null"), "id", "color", {"1": "red", "0": "green"}, "ok", "type", "accessory").join(v.select("id"), "id", "left_semi")


_DONOR = "(SELECT p_name AS model, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS size, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS type, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS brand, p_partkey AS id FROM part)"
_AGREED = ", ".join(f"CASE WHEN count(DISTINCT {c}) = 1 THEN min({c}) END AS {c}" for c in ("size", "type", "brand"))


@query("donor_fill_many", f"SELECT p.id, coalesce(p.size, d.size) AS size, coalesce(p.type, d.type) AS type, coalesce(p.brand, d.brand) AS brand FROM {_DONOR} p JOIN (SELECT model, {_AGREED} FROM {_DONOR} q GROUP BY 1) d USING (model)")
def donor_fill_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any number of fields from agreeing donors, in one aggregate and one join."""
    when = lambda k, c: F.when(k, F.col(c))
    id_ = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("model"), when(id_ % 2 == 0, "p_size").alias("size"), when(id_ % 3 == 0, "p_type").alias("type"), when(id_ % 5 != 0, "p_brand").alias("brand"), id_.alias("id"))
    return en.donor_filled(p, ["model"], ["size", "type", "brand"]).select("id", "size", "type", "brand")


@query(
    "beam_repair",
    "SELECT l_orderkey AS o, l_linenumber AS n, CASE WHEN cd > 500000 OR (cd > 100000 AND d < 300) THEN (d / 2) ^ 2 ELSE cd END AS candela, CASE WHEN NOT (cd > 500000 OR (cd > 100000 AND d < 300)) THEN round(2 * sqrt(cd), 6) ELSE d END AS throw_m FROM (SELECT *, l_extendedprice * 10 AS cd, l_quantity * 10 AS d FROM lineitem)",
)
def beam_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensity is trusted and gives the distance, unless it is bogus: then the distance gives the intensity."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), (F.col("l_extendedprice") * 10).alias("cd"), (F.col("l_quantity") * 10).alias("d"))
    candela, throw = nu.beam_repaired(F.col("cd"), F.col("d"))
    return t.select("o", "n", candela.alias("candela"), F.round(throw, 6).alias("throw_m"))


@query(
    "revert_with_arrays",
    """SELECT id, m AS matches, CASE WHEN m < 2 THEN size END AS size, CASE WHEN m < 2 THEN price END AS price, CASE WHEN m < 3 THEN type END AS type FROM (
        SELECT a.p_partkey AS id, a.p_size AS size, a.p_retailprice AS price, a.p_type AS type, (abs(a.p_size - b.size) <= 0.02 * abs(b.size))::INT + (abs(a.p_retailprice - b.price) <= 0.02 * abs(b.price))::INT + (abs(length(a.p_name) - b.len) <= 0.02 * abs(b.len))::INT AS m
        FROM part a JOIN (SELECT p_partkey AS id, p_size + CASE WHEN p_partkey % 3 = 0 THEN 9 ELSE 0 END AS size, p_retailprice * CASE WHEN p_partkey % 4 = 0 THEN 1.5::DOUBLE ELSE 1.01::DOUBLE END AS price, length(p_name) AS len FROM part) b ON b.id = a.p_partkey)""",
)
def revert_with_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that came from a bad source go: two scalar matches clear scalars, three also arrays."""
    p = table(spark, sf_dir, "part")
    own = p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.length("p_name").alias("len"), F.array("p_type").alias("type"))
    bad = p.select(F.col("p_partkey").alias("id"), (F.col("p_size") + F.when(F.col("p_partkey") % 3 == 0, 9).otherwise(0)).alias("size"), (F.col("p_retailprice") * F.when(F.col("p_partkey") % 4 == 0, 1.5).otherwise(1.01)).alias("price"), F.length("p_name").alias("len"))
    t = en.reverted(own, bad, "id", ["size", "price", "len"], ["type"])
    return t.select("id", "matches", "size", "price", ce.first_item(F.col("type")).alias("type"))


@query(
    "cross_fill_bounded",
    "SELECT p.p_partkey AS id, coalesce(CASE WHEN p.p_partkey % 2 = 0 THEN p.p_size END, CASE WHEN x.v BETWEEN 10 AND 40 THEN x.v END) AS size FROM part p LEFT JOIN (SELECT p_name || p_brand AS k, arg_min(p_size, p_partkey) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) x ON x.k = p.p_name || p.p_brand",
)
def cross_fill_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values from another catalogue by key, where they lie inside their bounds."""
    p = table(spark, sf_dir, "part")
    other = p.where("p_partkey % 2 = 0").groupBy(F.concat("p_name", "p_brand").alias("k")).agg(F.min_by("p_size", "p_partkey").alias("size"))
    own = p.select(F.col("p_partkey").alias("id"), F.concat("p_name", "p_brand").alias("k"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("size"))
    return en.cross_filled(own, other, "k", {"size": (10, 40)}).select("id", "size")


@query(
    "purchase_fill",
    f"SELECT {_HOST} AS host, CASE WHEN min(page_id) % 2 = 0 THEN 'kept' ELSE array_to_string(list_sort(list(DISTINCT url))[1:3], ' ') END AS urls FROM pages WHERE url IS NOT NULL GROUP BY 1",
)
def purchase_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a purchase URL take up to three of their sources, in order."""
    g = table(spark, sf_dir, "pages").where("url is not null").groupBy(ur.host(F.col("url")).alias("host")).agg(F.min("page_id").alias("first"), F.collect_set("url").alias("all"))
    own = F.when(F.col("first") % 2 == 0, F.array(F.lit("kept"))).otherwise(F.array().cast("array<string>"))
    return g.select("host", F.array_join(ce.filled_list(own, F.array_sort("all"), 3), " ").alias("urls"))


@query("row_overrides", "SELECT p_partkey AS id, CASE p_partkey WHEN 3 THEN 99 ELSE p_size END AS size, CASE p_partkey WHEN 5 THEN 'fixed name' ELSE p_name END AS name FROM part WHERE p_partkey <> 7")
def row_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs by hand: literal values for single rows, and rows that go."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.col("p_name").alias("name"))
    return en.overridden(p, "id", {3: {"size": 99}, 5: {"name": "fixed name"}}, gone=[7])


@query(
    "fixpoint_fill",
    """WITH RECURSIVE known AS (SELECT p_partkey AS id, p_brand AS brand FROM part WHERE p_partkey % 50 = 1
        UNION SELECT p.p_partkey, k.brand FROM part p JOIN known k ON p.p_partkey = k.id + 1 WHERE p.p_partkey % 50 BETWEEN 2 AND 12)
        SELECT p_partkey AS id, k.brand FROM part LEFT JOIN known k ON k.id = p_partkey""",
)
def fixpoint_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pass fills rows from filled neighbours, until a pass fills nothing (or after twenty)."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 50 == 1, F.col("p_brand")).alias("brand"))

    def step(t: DataFrame) -> DataFrame:
        donors = t.where("brand is not null").select((F.col("id") + 1).alias("id"), F.col("brand").alias("given"))
        given = F.when((F.col("id") % 50).between(2, 12), F.col("given"))
        return t.join(donors, "id", "left").select("id", F.coalesce("brand", given).alias("brand"))

    return en.until_unchanged(p, step, F.count("brand"), most=20)


@query("entry_mapping", "SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(lower(p_name), '\\b(small|large|red|the|with)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS model, CASE WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_name, 'plate') THEN 'plate' ELSE 'other' END AS kind, p_brand AS brand, p_retailprice AS price FROM part")
def entry_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's product as an entry: the model is its title without brand and stop words, the kind its first keyword."""
    p = table(spark, sf_dir, "part")
    model = tx.without_words(F.lower("p_name"), ["small", "large", "red", "the", "with"])
    kind = tx.first_key_in(F.col("p_name"), [("ring", "ring"), ("plate", "plate")], "other")
    return p.select(F.col("p_partkey").alias("id"), model.alias("model"), kind.alias("kind"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))


@query("embedded_script_data", "SELECT page_id, TRY_CAST(regexp_extract(html, '(?s)<script[^>]*>.*?track\\((\\d+)\\)', 1) AS BIGINT) AS tracked, json_extract_string(replace(regexp_extract(html, '(?s)<script[^>]*>var t=(\"[^\"]*\");', 1), '\\/', '/'), '$') AS t FROM pages")
def embedded_script_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a page's script carries: a call's number and a JSON literal."""
    p = table(spark, sf_dir, "pages")
    literal = ur.script_literal(F.col("html"), "t")
    return p.select("page_id", ur.script_call(F.col("html"), "track").alias("tracked"), F.get_json_object(F.concat(F.lit('{"v":'), literal, F.lit("}")), "$.v").alias("t"))


@query("sort_strings", "SELECT p_partkey AS id, row_number() OVER (ORDER BY CASE WHEN p_size % 9 = 0 THEN 1 ELSE 0 END, lower(p_name || p_brand), p_partkey) AS place FROM part QUALIFY place <= 200")
def sort_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 by name, case aside; empty ones come last and equal ones keep their order."""
    name = F.when(F.col("p_size") % 9 != 0, F.concat("p_name", "p_brand"))
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower(name).alias("k"), F.lower(F.concat("p_name", "p_brand")).alias("k2"))
    first = t.orderBy(F.col("k").isNull(), "k2", "id").limit(200)
    return first.agg(F.array_sort(F.collect_list(F.struct(F.col("k").isNull().alias("e"), "k2", "id"))).alias("r")).select(F.posexplode("r").alias("at", "r")).select("r.id", (F.col("at") + 1).alias("place"))  # 200 rows


@query("sort_array_max", "SELECT l_orderkey AS id, max(l_quantity) AS top FROM lineitem GROUP BY 1 ORDER BY top DESC, id LIMIT 100")
def sort_array_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell with several numbers sorts by its largest."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_quantity").alias("cell"))  # the lines of one order
    return t.withColumn("top", F.array_max("cell")).orderBy(F.desc_nulls_last("top"), "id").limit(100).select("id", "top")


@query("tier_order", "SELECT l_orderkey AS id, string_agg(l_returnflag || l_linenumber, ' ' ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_linenumber) AS ordered FROM lineitem GROUP BY 1")
def tier_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a cell by the tier they belong to, stable."""
    cell = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("x")))), lambda s: s["x"])  # the lines of one order
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(cell.alias("cell"))
    tier = lambda x: F.when(F.startswith(x, F.lit("R")), 0).when(F.startswith(x, F.lit("N")), 1).otherwise(2)
    return t.select("id", F.array_join(ce.by_tier(F.col("cell"), tier), " ").alias("ordered"))


@query("same_terms", "SELECT a.p_partkey AS id, list_sort(list_distinct(string_split(lower(a.p_name), ' '))) = list_sort(list_distinct(string_split(lower(b.p_name), ' '))) AS same FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def same_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two cells hold the same terms, whatever their order and case."""
    p = table(spark, sf_dir, "part")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.split("p_name", " ").alias("other"))
    return p.join(b, "p_partkey").select(F.col("p_partkey").alias("id"), ce.same_set(F.split(F.upper("p_name"), " "), F.col("other")).alias("same"))


_SI = "'^\\s*(-?[0-9]+(?:\\.[0-9]+)?)\\s*([kMGmu]?)\\s*$'"


@query("si_parse", f"SELECT doc_id, count(v) AS n, round(max(v), 6) AS largest FROM (SELECT doc_id, TRY_CAST(nullif(regexp_extract(w, {_SI}, 1), '') AS DOUBLE) * CASE regexp_extract(w, {_SI}, 2) WHEN 'k' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'G' THEN 1e9 WHEN 'm' THEN 1e-3 WHEN 'u' THEN 1e-6 ELSE 1 END AS v FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)) GROUP BY 1")
def si_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of every whole text, with or without a prefix of magnitude."""
    values = F.filter(F.transform(F.split("text", " "), nu.si_value), lambda v: v.isNotNull())
    t = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", values.alias("v"))
    return t.select("doc_id", F.size("v").cast("long").alias("n"), F.round(F.array_max("v"), 6).alias("largest"))


_TICK = "floor(ln(p_retailprice) / ln(100000.0::DOUBLE) * 200 + 0.5) / 200"


@query("slider_roundtrip", f"SELECT p_partkey AS id, CAST({_TICK} * 200 AS BIGINT) AS tick, round(pow(100000.0::DOUBLE, {_TICK}), 4) AS price FROM part")
def slider_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of a slider's 200 ticks to a price, and the price that the tick stands for."""
    tick = F.floor(nu.slider_position(F.col("p_retailprice"), 1.0, 1e5) * 200 + 0.5)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tick.cast("long").alias("tick"), F.round(nu.slider_value(tick / 200, 1.0, 1e5), 4).alias("price"))


_LINE = "string_split(coalesce(text, ''), chr(10))[1]"
_BARE = f"regexp_replace({_LINE}, '[\u200b\u200c\u200d\u2060\ufeff]', '', 'g')"
_BARE = f"regexp_replace({_BARE}, '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g')"
_BARE = f"regexp_replace({_BARE}, '(?i)\\b[0-9][0-9,.]*\\s*(lumens?|lm|mah|wh|k|mm|cm|m|g|v|w)\\b', ' ', 'g')"
_BARE = f"trim(regexp_replace({_BARE}, '\\s+', ' ', 'g'))"


@query("name_keys", f"SELECT doc_id AS id, regexp_replace(lower({_LINE}), '[^a-z0-9]+', '', 'g') AS tight, trim(regexp_replace(lower({_LINE}), '[^a-z0-9]+', ' ', 'g')) AS spaced, {_BARE} AS bare, CASE WHEN starts_with(lower({_LINE}), 'the ') THEN trim(substring({_LINE}, 4)) ELSE {_LINE} END AS tail FROM documents")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison keys of every text's first line; figures with units, zero-width characters and a leading word taken off."""
    line = F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), line.alias("line"))
    name = F.col("line")
    return d.select("id", tx.match_key(name).alias("tight"), tx.match_key(name, spaced=True).alias("spaced"), tx.without_specs(tx.without_zero_width(name)).alias("bare"), tx.without_prefix(name, F.lit("The")).alias("tail"))


@query("fenced_and_safe", "SELECT conv_id, turn, trim(CASE WHEN regexp_extract(text, '(?s)```(?:json)?\\s*(.*?)```', 1) <> '' THEN regexp_extract(text, '(?s)```(?:json)?\\s*(.*?)```', 1) ELSE text END) AS inside, false AS safe FROM conversations WHERE NOT regexp_matches(text, '^https?://[^\\s/]+') UNION ALL SELECT page_id, -1, url, regexp_matches(url, '^https?://[^\\s/]+') FROM pages")
def fenced_and_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers out of their code fence, where they have one; whether a page's URL is a safe link."""
    c = table(spark, sf_dir, "conversations").where(~ur.is_safe(F.col("text"))).select("conv_id", "turn", tx.unfenced(F.col("text")).alias("inside"), F.lit(False).alias("safe"))
    return c.unionByName(table(spark, sf_dir, "pages").select(F.col("page_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), F.col("url").alias("inside"), ur.is_safe(F.col("url")).alias("safe")))


@query("price_fill", "SELECT user_id, ts, event_id, last_value(CASE WHEN event_id % 3 <> 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS price FROM events")
def price_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last known price of a key at each of its points."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("p", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return e.select("user_id", "ts", "event_id", F.last("p", ignorenulls=True).over(w).alias("price"))
