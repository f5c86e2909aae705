"""Quality reports on ``documents`` with ``labels``, ``lineitem``, ``orders``, ``part`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import built
from ..operators import quality as qu
from .registry import query, table

FIELDS = ["lang", "source", "quality", "toxic"]
_DOCS = "(SELECT d.doc_id, d.text, CASE WHEN d.doc_id % 7 = 0 THEN '' ELSE d.lang END AS lang, CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE d.source END AS source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels and some emptied cells."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", "text", F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 11 != 0, F.col("source")).alias("source"), "quality", "toxic")


_MISSING = "[CASE WHEN (lang IS NULL OR lang = '') AND NOT coalesce(toxic = 1, false) THEN 'lang' END, CASE WHEN source IS NULL OR source = '' THEN 'source' END, CASE WHEN quality IS NULL THEN 'quality' END]"


def _missing(d: DataFrame) -> DataFrame:
    return d.withColumn("missing", qu.missing(d, ["lang", "source", "quality"], {"lang": F.col("toxic") == 1}))


@query("required_missing_list", f"SELECT doc_id, m = '' AS valid, m AS missing FROM (SELECT doc_id, array_to_string(list_filter({_MISSING}, lambda x: x IS NOT NULL), ',') AS m FROM {_DOCS} d)")
def required_missing_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which required attributes are empty; toxic documents need no language."""
    d = _missing(_docs(spark, sf_dir))
    return d.select("doc_id", (F.size("missing") == 0).alias("valid"), F.array_join("missing", ",").alias("missing"))


@query("missing_histogram", f"SELECT field, count(*) AS n FROM (SELECT unnest(list_filter({_MISSING}, lambda x: x IS NOT NULL)) AS field FROM {_DOCS} d) GROUP BY field")
def missing_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _missing(_docs(spark, sf_dir)).select(F.explode("missing").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


_SCORE = "(lang IS NOT NULL AND lang <> '')::INT + (source IS NOT NULL AND source <> '')::INT + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT + (length(text) >= 500)::INT"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = [F.col("lang") != "", F.col("source") != "", F.col("quality").isNotNull(), F.col("toxic").isNotNull(), F.length("text") >= 500]
    return _docs(spark, sf_dir).withColumn("score", qu.completeness(have))


@query("completeness_hist", f"SELECT score, n, round(n * 100 / sum(n) OVER (), 4)::DOUBLE AS percent FROM (SELECT CAST({_SCORE} AS INT) AS score, count(*) AS n FROM {_DOCS} d GROUP BY 1)")
def completeness_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qu.histogram(_scored(spark, sf_dir), "score")


_NO = "count(*) FILTER (lang IS NULL OR lang = '') AS no_lang, count(*) FILTER (source IS NULL OR source = '') AS no_source, count(*) FILTER (quality IS NULL) AS no_quality, count(*) FILTER (toxic IS NULL) AS no_toxic"
_GAPS = f"(SELECT source, count(*) AS total, {_NO} FROM {_DOCS} d GROUP BY source HAVING count(*) >= 5)"


@query("gaps_by_group", f"SELECT * FROM {_GAPS} g")
def gaps_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qu.gaps(_docs(spark, sf_dir), "source", FIELDS, 5)


@query("gaps_grand_total", f"SELECT source, false AS grand, total, no_lang, no_source, no_quality, no_toxic FROM {_GAPS} g UNION ALL SELECT NULL, true, count(*), {_NO} FROM {_DOCS} d")
def gaps_grand_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qu.gaps(_docs(spark, sf_dir), "source", FIELDS, 5, total=True)


@query("avg_gap_rank", f"SELECT source, round((no_lang * 100.0::DOUBLE / total + no_source * 100.0::DOUBLE / total + no_quality * 100.0::DOUBLE / total + no_toxic * 100.0::DOUBLE / total) / 4, 4) AS gap FROM {_GAPS} g ORDER BY gap DESC, source NULLS LAST LIMIT 20")
def avg_gap_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = qu.gaps(_docs(spark, sf_dir), "source", FIELDS, 5)
    return g.select("source", qu.average_gap(g, FIELDS).alias("gap")).orderBy(F.desc("gap"), F.asc_nulls_last("source")).limit(20)


_PRICE = "l_extendedprice / l_quantity"
_ISSUES = f"""(SELECT l_orderkey AS id, l_linenumber AS line, 'quantity_high' AS issue, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value FROM lineitem WHERE l_quantity > 48
    UNION ALL SELECT l_orderkey, l_linenumber, 'discount_with_return', l_returnflag FROM lineitem WHERE l_discount > 0.09 AND l_returnflag = 'R'
    UNION ALL SELECT l_orderkey, l_linenumber, 'price_off', l_linestatus FROM lineitem WHERE NOT ({_PRICE} / 1200 BETWEEN 0.5 AND 2))"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_extendedprice")
    rules = {
        "quantity_high": (F.col("l_quantity") > 48, F.col("l_quantity").cast("long")),
        "discount_with_return": ((F.col("l_discount") > 0.09) & (F.col("l_returnflag") == "R"), F.col("l_returnflag")),
        "price_off": (~qu.consistent(F.col("l_extendedprice") / F.col("l_quantity"), F.lit(1200.0)), F.col("l_linestatus")),
    }
    return qu.issues(t, ["id", "line"], rules)


@query("issue_rules_long", f"SELECT * FROM {_ISSUES} i")
def issue_rules_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules, one of them across columns and one on a ratio, as a long table from one scan."""
    return _issues(spark, sf_dir)


@query("issue_counts", f"SELECT issue, count(*) AS n FROM {_ISSUES} i GROUP BY issue")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query("suspicious_counts", "SELECT 'large' AS rule, count(*) AS n FROM part WHERE p_size > 45 UNION ALL SELECT 'cheap', count(*) FROM part WHERE p_retailprice < 905 UNION ALL SELECT 'never', count(*) FROM part WHERE p_size < 0")
def suspicious_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qu.counts(table(spark, sf_dir, "part"), {"large": F.col("p_size") > 45, "cheap": F.col("p_retailprice") < 905, "never": F.col("p_size") < 0})


@query("ratio_consistency", f"SELECT l_orderkey AS id, l_linenumber AS line FROM lineitem WHERE NOT ({_PRICE} / 1200 BETWEEN 0.5 AND 2)")
def ratio_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").where(~qu.consistent(F.col("l_extendedprice") / F.col("l_quantity"), F.lit(1200.0)))
    return t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"))


@query("cross_field_rule", "SELECT p_partkey AS id FROM part WHERE p_size < 5 AND (' ' || p_name || ' ' LIKE '% widget %' OR ' ' || p_name || ' ' LIKE '% gear %')")
def cross_field_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small parts with a heavy item in their list."""
    heavy = F.exists(F.split("p_name", " "), lambda w: w.rlike("^(widget|gear)$"))
    return table(spark, sf_dir, "part").where((F.col("p_size") < 5) & heavy).select(F.col("p_partkey").alias("id"))


@query("group_quality_bottom_n", f"SELECT source, round(avg({_SCORE}), 4) AS mean, count(*) AS n FROM {_DOCS} d GROUP BY source HAVING count(*) >= 3 ORDER BY mean, source NULLS FIRST LIMIT 5")
def group_quality_bottom_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qu.bottom_groups(_scored(spark, sf_dir), "source", "score", 3, 5)


_WORDS = "list_distinct(string_split(p_name, ' '))"
_SEEN = "list_distinct([string_split(p_name, ' ')[1], CASE WHEN p_size % 3 = 0 THEN string_split(p_name, ' ')[2] ELSE 'other' END])"


@query(
    "overlap_accuracy",
    f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN b = len(x) AND b = len(y) THEN 'exact' WHEN b > 0 THEN 'partial' ELSE 'mismatch' END AS kind FROM (SELECT x, y, len(list_intersect(x, y)) AS b FROM (SELECT {_WORDS} AS x, {_SEEN} AS y FROM part))) GROUP BY kind",
)
def overlap_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector's sets against the true ones."""
    words = F.split("p_name", " ")
    seen = F.array(F.get(words, 0), F.when(F.col("p_size") % 3 == 0, F.get(words, 1)).otherwise("other"))
    return table(spark, sf_dir, "part").select(qu.overlap(words, seen).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("label_confusion", "SELECT CAST(length(d.text) >= 500 AS INT) AS guess, l.quality, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2")
def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") >= 500).cast("int").alias("guess"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("guess", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("priority_order_limit", "SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'O' ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END, o_orderdate, o_orderkey LIMIT 25")
def priority_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next work to do: by priority class, then oldest."""
    rank = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(2)
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return o.orderBy(rank, "o_orderdate", "o_orderkey").limit(25).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))


@query("stale_oldest", "SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 12 HOUR ORDER BY seen, user_id LIMIT 50")
def stale_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys not seen for half a day, oldest first."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("seen"))
    return last.where(F.col("seen") < F.lit("2024-01-31").cast("timestamp_ntz") - F.expr("INTERVAL 12 HOUR")).orderBy("seen", "user_id").limit(50)


_CASCADE = [("^(red|blue) ", "primary"), ("(bolt|nut)$", "fastener"), ("e", "named")]


@query("classify_cascade", "SELECT p_partkey AS id, CASE WHEN regexp_matches(p_name, '^(red|blue) ') THEN 'primary' WHEN regexp_matches(p_name, '(bolt|nut)$') THEN 'fastener' WHEN regexp_matches(p_name, 'e') THEN 'named' ELSE 'rest' END AS kind FROM part")
def classify_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), qu.cascade(F.col("p_name"), _CASCADE, "rest").alias("kind"))


@query("global_counts", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus <> 'F') AS open FROM orders")
def global_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") != "F").alias("open"))


@query("group_counts_ranked", "SELECT p_brand AS brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS place FROM part GROUP BY p_brand")
def group_counts_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    t = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "brand")).cast("long"))  # one row per brand


@query("group_concat", "SELECT p_brand AS brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS kinds FROM part GROUP BY p_brand")
def group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("kinds"))


@query(
    "coverage_gain",
    "SELECT source, count(*) FILTER (quality IS NOT NULL) - count(*) FILTER (quality IS NOT NULL AND doc_id % 2 = 0) AS gain_quality FROM (SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY source",
)
def coverage_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    before = after.withColumn("quality", F.when(F.col("doc_id") % 2 == 0, F.col("quality")))
    return qu.coverage_gain(before, after, "source", ["quality"])


@query(
    "verdict_table",
    "SELECT 'rows' AS measure, count(*)::DOUBLE AS value, 1000.0::DOUBLE AS target, count(*) >= 1000 AS passed FROM part UNION ALL SELECT 'brands', count(DISTINCT p_brand)::DOUBLE, 20.0::DOUBLE, count(DISTINCT p_brand) >= 20 FROM part UNION ALL SELECT 'repeats', (count(*) - count(DISTINCT p_partkey))::DOUBLE, 0.0::DOUBLE, count(*) - count(DISTINCT p_partkey) <= 0 FROM part",
)
def verdict_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance targets on the whole table."""
    p = table(spark, sf_dir, "part")
    m = p.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("p_brand").alias("brands"), (F.count(F.lit(1)) - F.count_distinct("p_partkey")).alias("repeats"))
    return qu.verdicts(m, {"rows": 1000, "brands": 20, "repeats": 0})


@query("batch_number", "SELECT p_partkey AS id, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 25 AS INT) AS batch FROM part")
def batch_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 25 inside each brand."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.floor(at / 25).cast("int").alias("batch"))


@query("derived_columns", "SELECT p_partkey AS id, CASE WHEN p_size >= 6 THEN '6+' ELSE CAST(p_size AS VARCHAR) END AS levels, least(p_retailprice, 1500.0::DOUBLE) AS capped, 'size ' || p_size || CASE WHEN p_size > 25 THEN ' / large' ELSE '' END AS shown FROM part")
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucketed, capped and composed output columns."""
    size = F.col("p_size")
    parts = F.array_compact(F.array(F.concat(F.lit("size "), size.cast("string")), F.when(size > 25, "large")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(size >= 6, "6+").otherwise(size.cast("string")).alias("levels"), F.least("p_retailprice", F.lit(1500.0)).alias("capped"), F.array_join(parts, " / ").alias("shown"))


@query(
    "built_columns",
    """WITH l AS (SELECT l_partkey AS id, list(l_quantity ORDER BY l_orderkey, l_linenumber, l_quantity) AS q, max(l_extendedprice) AS m FROM lineitem GROUP BY 1)
    SELECT p_partkey AS id, CASE WHEN p_size >= 6 THEN '6+' ELSE CAST(p_size AS VARCHAR) END AS levels,
        array_to_string(list_transform(range(greatest(len(q), 2)), lambda i: CASE WHEN i < len(q) THEN regexp_replace(CAST(q[i + 1] AS VARCHAR), '\\.0$', '') || ' lum' || CASE WHEN i = 0 THEN ' / ' || p_size || 'h' ELSE '' END ELSE string_split(p_name, ' ')[i + 1] END), ', ') AS modes,
        concat_ws(', ', p_size || 'mm', CASE WHEN p_size % 2 = 0 THEN '⌀' || p_size // 2 || 'mm head' END, CAST(p_retailprice * 4 AS INT) || 'g') AS measurements,
        CASE WHEN CAST(p_retailprice * 4 AS INT) <= 5000 THEN CAST(CAST(p_retailprice * 4 AS INT) AS DOUBLE) END AS weight, CASE WHEN p_size <= 10 THEN p_size::DOUBLE END AS impact FROM part JOIN l ON l.id = p_partkey WHERE len(string_split(p_name, ' ')) >= 2""",
)
def built_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed columns of the built table: levels, modes, measurements, plausible weights and impacts."""
    c = F.col
    lines = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity")))  # the lines of one part
    told = table(spark, sf_dir, "lineitem").groupBy(c("l_partkey").alias("id")).agg(F.transform(lines, lambda x: x.l_quantity).alias("lumens"))
    p = table(spark, sf_dir, "part").where(F.size(F.split("p_name", " ")) >= 2).select(
        c("p_partkey").alias("id"), c("p_size").alias("levels"), F.array(c("p_size").cast("double")).alias("runtime_hours"), F.slice(F.split("p_name", " "), 1, 2).alias("modes"), c("p_size").alias("length_mm"),
        F.when(c("p_size") % 2 == 0, c("p_size") / 2).alias("bezel_mm"), F.round(c("p_retailprice") * 4).cast("int").alias("weight_g"), F.array(F.concat(c("p_size").cast("string"), F.lit("m"))).alias("impact"),
    )
    b = built.built(p.join(told, "id"), ["levels", "modes", "measurements", "weight", "impact"], ("id",))
    return b.select("id", F.get("levels", F.lit(0)).alias("levels"), F.array_join("modes", ", ").alias("modes"), F.array_join("measurements", ", ").alias("measurements"), "weight", "impact")
