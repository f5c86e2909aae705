"""Entity resolution, merging and snapshots on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cells import contains_all, expand_multiples, within_tolerance
from ..functions.text import core_model, slug, without_version
from ..operators import entities as en
from ..sources.shared import shared_dir
from ..sources.snapshots import Snapshot
from .registry import query, table


@query("dup_groups_having", "SELECT lower(c_mktsegment) AS segment, c_nationkey AS nation, count(*) AS n, min(c_custkey) AS first_id, list_sort(list(c_custkey)) AS ids FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return en.duplicate_groups(c, [F.lower("c_mktsegment"), F.col("c_nationkey")], ["segment", "nation"], "c_custkey")


@query("dup_best_row", "SELECT lower(p_name) AS model, p_brand AS brand, p_partkey AS id, p_size AS size FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name), p_brand ORDER BY p_size DESC, p_partkey) = 1")
def dup_best_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.lower("p_name").alias("model"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return en.best_row(p, ["model", "brand"], F.col("size"), "id")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("model"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("price"), F.array("p_type").alias("type"))


PARTS = "(SELECT p_partkey AS id, p_name AS model, p_brand AS brand, p_size AS size, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS price, p_type AS type FROM part)"


@query(
    "dup_merge_fill",
    f"SELECT model, brand, arg_min(id, (-size, id)) AS id, count(*) AS merged_rows, arg_min(price, (-size, id)) FILTER (price IS NOT NULL) AS price, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM {PARTS} p GROUP BY 1, 2",
)
def dup_merge_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = en.merged(_parts(spark, sf_dir), ["model", "brand"], F.col("size"), "id", ["price"], ["type"])
    return m.select("model", "brand", "id", "merged_rows", "price", F.array_join("type", ",").alias("types"))


@query("dup_reparent", f"SELECT k.id AS part, count(*) AS n FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN (SELECT model, brand, arg_min(id, (-size, id)) AS id FROM {PARTS} q GROUP BY 1, 2) k ON k.model = p.p_name AND k.brand = p.p_brand GROUP BY 1")
def dup_reparent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of merged parts point to the part that was kept."""
    p = _parts(spark, sf_dir)
    kept = en.merged(p, ["model", "brand"], F.col("size"), "id", [], []).select("model", "brand", F.col("id").alias("keep"))
    moves = p.select("model", "brand", "id").join(kept, ["model", "brand"]).where("id <> keep")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"))
    return en.reparented(lines, "part", moves, "id", "keep").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("self_join_pairs", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey")
def self_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.pairs(table(spark, sf_dir, "part"), ["p_name", "p_brand"], "p_partkey").select("a", "b")


@query(
    "donor_unanimous_fill",
    f"SELECT p.id, coalesce(p.price, d.v) AS price FROM (SELECT *, CASE WHEN id % 3 <> 0 THEN size END AS s FROM {PARTS} q) p LEFT JOIN (SELECT model, CASE WHEN count(DISTINCT price) = 1 THEN any_value(price) END AS v FROM {PARTS} q WHERE price IS NOT NULL GROUP BY 1) d ON d.model = p.model",
)
def donor_unanimous_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing prices come from donors of the same model if all donors agree."""
    p = _parts(spark, sf_dir)
    donors = en.unanimous(p, ["model"], ["price"]).withColumnRenamed("price", "v")
    return p.join(donors, "model", "left").select("id", F.coalesce("price", "v").alias("price"))


_L = "(SELECT p_partkey AS id, p_brand AS brand, p_name || CASE WHEN p_partkey % 4 = 0 THEN ' v2' ELSE '' END AS name FROM part WHERE p_partkey % 2 = 0)"
_R = "(SELECT p_partkey AS id, p_brand AS brand, CASE WHEN p_partkey % 3 = 0 THEN string_split(p_name, ' ')[2] ELSE p_name END AS name FROM part WHERE p_partkey % 2 = 1)"
_V = "trim(regexp_replace({}, '\\s*v[0-9]+$', ''))"


@query(
    "entity_match_tiered",
    f"""SELECT left_id, right_id, CAST(tier AS INT) AS tier FROM (SELECT l.id AS left_id, r.id AS right_id,
        CASE WHEN l.name = r.name THEN 1 WHEN contains(l.name, r.name) OR contains(r.name, l.name) THEN 2 WHEN {_V.format("l.name")} = {_V.format("r.name")} THEN 3 END AS tier,
        least(length(l.name), length(r.name)) AS o FROM {_L} l JOIN {_R} r ON l.brand = r.brand) WHERE tier IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY tier, CASE WHEN tier = 2 THEN -o ELSE 0 END, right_id) = 1""",
)
def entity_match_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    left = p.where("p_partkey % 2 = 0").select("p_partkey", "p_brand", F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, " v2").otherwise("")).alias("name"))
    right = p.where("p_partkey % 2 = 1").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 3 == 0, F.get(F.split("p_name", " "), 1)).otherwise(F.col("p_name")).alias("name"))
    return en.tiered_match(left, right, "p_brand", "name", "name", "p_partkey", "p_partkey", without_version)


@query(
    "entity_lookup_tiered",
    "SELECT p.p_partkey AS id, coalesce(a.v, b.v) AS value, CAST(CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 END AS INT) AS tier FROM part p LEFT JOIN (SELECT p_name || p_brand AS k, arg_min(p_size, p_partkey) AS v FROM part WHERE p_partkey % 2 = 1 GROUP BY 1) a ON a.k = p.p_name || p.p_brand LEFT JOIN (SELECT p_name AS k, arg_min(p_size, p_partkey) AS v FROM part WHERE p_partkey % 2 = 1 GROUP BY 1) b ON b.k = p.p_name WHERE p.p_partkey % 2 = 0",
)
def entity_lookup_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    keys = [F.concat("p_name", "p_brand"), F.col("p_name")]
    return en.tiered_lookup(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), "p_partkey", keys, "p_size", keys, "p_partkey")


@query("prefix_join", "SELECT a.p_brand AS long_key, b.p_brand AS short_key FROM (SELECT DISTINCT p_brand FROM part) a JOIN (SELECT DISTINCT p_brand FROM part) b ON starts_with(a.p_brand, b.p_brand) AND a.p_brand <> b.p_brand AND length(b.p_brand) >= 7")
def prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "part").select("p_brand").distinct()
    return en.prefix_match(b.select(F.col("p_brand").alias("long_key")), b.select(F.col("p_brand").alias("short_key")), "long_key", "short_key", 7)


_OLD = "(SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, o_orderstatus AS status, o_orderpriority AS tag FROM orders WHERE o_orderkey % 3 <> 0)"
_NEW = "(SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 END AS price, 'N' AS status, 'new' AS tag FROM orders WHERE o_orderkey % 3 <> 1)"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("tag"))
    new = o.where("o_orderkey % 3 <> 1").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") + 1).alias("price"), F.lit("N").alias("status"), F.lit("new").alias("tag"))
    return old, new


@query("upsert_coalesce_snapshot", f"SELECT coalesce(o.id, n.id) AS id, coalesce(n.price, o.price) AS price, CASE WHEN n.id IS NOT NULL THEN n.status ELSE o.status END AS status, CASE WHEN o.id IS NOT NULL THEN o.tag ELSE n.tag END AS tag FROM {_OLD} o FULL OUTER JOIN {_NEW} n ON o.id = n.id")
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return en.upserted(old, new, "id", ["price"], {}, ["status"], ["tag"])


@query("upsert_partitions", f"SELECT coalesce(o.id, n.id) AS id, coalesce(n.price, o.price) AS price, CASE WHEN n.id IS NOT NULL THEN n.status ELSE o.status END AS status, CASE WHEN o.id IS NOT NULL THEN o.tag ELSE n.tag END AS tag FROM {_OLD} o FULL OUTER JOIN (SELECT * FROM {_NEW} n WHERE id % 50 = 0) n ON o.id = n.id")
def upsert_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same upsert into a stored snapshot, of which the changed partitions are written; then once more, which changes nothing."""
    old, new = _snapshots(spark, sf_dir)
    name = f"snapshot_{uuid.uuid4().hex}"
    s = Snapshot(spark, name, f"{shared_dir(spark)}/{name}", "id")
    s.create(old)
    for _ in range(2):
        s.upsert(new.where("id % 50 = 0"), lambda a, b: en.upserted(a, b, "id", ["price"], {}, ["status"], ["tag"]))
    return s.rows().drop("slot")


@query("fill_only_merge_fields_added", f"SELECT o.id, coalesce(o.price, n.price) AS price, CASE WHEN o.price IS NULL AND n.price IS NOT NULL THEN 'price' ELSE '' END AS added FROM {_OLD} o LEFT JOIN {_NEW} n ON o.id = n.id")
def fill_only_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return en.fill_only(old, new, "id", ["price", "tag"]).select("id", "price", F.array_join("fields_added", ",").alias("added"))


@query("insert_ignore_first_wins", f"SELECT id, tag FROM {_OLD} o UNION ALL SELECT id, tag FROM {_NEW} n WHERE id NOT IN (SELECT id FROM {_OLD} o)")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return en.inserted_or_ignored(old.select("id", "tag"), new.select("id", "tag"), ["id"])


@query("replace_last_wins", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def replace_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return en.last_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.without(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


@query("orphan_cleanup", "SELECT l.doc_id, l.toxic FROM labels l WHERE l.doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'en')")
def orphan_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of deleted parents go."""
    kept = table(spark, sf_dir, "documents").where("lang <> 'en'").select("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id", "toxic").join(kept, "doc_id", "left_semi")


@query("requested_minus_returned", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def requested_minus_returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.without(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("core_model_key", "SELECT p_partkey AS id, upper(nullif(regexp_extract(p_brand || p_size, '([A-Za-z0-9]*[0-9][A-Za-z0-9]*)', 1), '')) AS core FROM part")
def core_model_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), core_model(F.regexp_replace(F.concat("p_brand", "p_size"), "Brand#", "")).alias("core"))


@query("slug_id", "SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_brand || '-' || p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slug_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), slug(F.col("p_brand"), F.col("p_name")).alias("slug"))


@query("multicell_expand", "SELECT p_partkey AS id, CASE WHEN (p_size || 'x' || p_name) < p_name THEN p_size || 'x' || p_name || ',' || p_name ELSE p_name || ',' || p_size || 'x' || p_name END AS cells FROM part")
def multicell_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.array_join(expand_multiples(F.array(F.concat("p_size", F.lit("x"), "p_name"))), ",").alias("cells"))


@query("array_union_merge", "SELECT p_brand AS brand, string_agg(DISTINCT w, ',' ORDER BY w) AS words FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def array_union_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.explode(F.split("p_name", " ")).alias("w"))
    return p.groupBy("brand").agg(F.array_join(F.array_sort(F.collect_set("w")), ",").alias("words"))


@query("array_setdiff", "SELECT p_partkey AS id, CAST(len(list_filter(string_split(p_name, ' '), lambda w: w NOT IN ('red', 'gear'))) AS INT) AS n, list_has_all(['red', 'gear', 'rod', 'old'], string_split(p_name, ' ')) AS inside FROM part")
def array_setdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("t", F.split("p_name", " "))
    return p.select(F.col("p_partkey").alias("id"), F.size(F.array_except("t", F.array(F.lit("red"), F.lit("gear")))).alias("n"), contains_all(F.array(*[F.lit(x) for x in ("red", "gear", "rod", "old")]), F.col("t")).alias("inside"))


@query("tolerance_match", "SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) <= 25 * 0.02 AND abs(l_extendedprice - 50000) <= 50000 * 0.02 AS near FROM lineitem")
def tolerance_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", within_tolerance(F.array("l_quantity", "l_extendedprice"), F.array(F.lit(25.0), F.lit(50000.0))).alias("near"))


@query("clear_bogus", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 AND l_shipmode_ok IS NULL THEN NULL ELSE l_quantity END AS quantity, CASE WHEN l_discount > 0.08 AND l_returnflag <> 'A' THEN NULL ELSE l_discount END AS discount FROM (SELECT *, NULL AS l_shipmode_ok FROM lineitem)")
def clear_bogus(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), "l_returnflag")
    t = en.cleared(t, {"quantity": F.col("quantity") > 45, "discount": F.col("discount") > 0.08}, {"discount": F.col("l_returnflag") == "A"})
    return t.drop("l_returnflag")


@query("revert_matches", "SELECT a.p_partkey AS id, (a.p_size = b.p_size)::INT + (abs(a.p_retailprice - b.p_retailprice) <= 0.02 * b.p_retailprice)::INT AS hits, CASE WHEN (a.p_size = b.p_size)::INT + (abs(a.p_retailprice - b.p_retailprice) <= 0.02 * b.p_retailprice)::INT >= 2 THEN NULL ELSE a.p_size END AS size FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 50")
def revert_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that agree with a contaminated source in two fields or more are cleared."""
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    b = p.select((F.col("p_partkey") - 50).alias("id"), F.col("p_size").alias("b_size"), F.col("p_retailprice").alias("b_price"))
    hits = (F.col("size") == F.col("b_size")).cast("int") + (F.abs(F.col("price") - F.col("b_price")) <= F.col("b_price") * 0.02).cast("int")
    t = a.join(b, "id").withColumn("hits", hits)
    return en.cleared(t, {"size": F.col("hits") >= 2}).select("id", "hits", "size")


@query("rename_conflicts", "SELECT a.p_partkey AS id, b.p_partkey AS target FROM part a LEFT JOIN (SELECT p_name, p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2) b ON b.p_brand = a.p_brand AND b.p_name = replace(a.p_name, 'small', 'large') WHERE a.p_name LIKE 'small %'")
def rename_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed rows and, where the new name is taken, the row to merge into."""
    p = table(spark, sf_dir, "part")
    taken = p.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("target"))
    moved = p.where("p_name like 'small %'").select(F.col("p_partkey").alias("id"), F.regexp_replace("p_name", "small", "large").alias("p_name"), "p_brand")
    return moved.join(taken, ["p_name", "p_brand"], "left").select("id", "target")


@query("flag_propagation_by_group", "SELECT s_suppkey AS id, bool_or(s_acctbal > 9000) OVER (PARTITION BY s_nationkey) AS flagged FROM supplier")
def flag_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag of one row holds for its whole group: a small aggregate joined back, no group in one task."""
    s = table(spark, sf_dir, "supplier")
    flags = s.groupBy("s_nationkey").agg(F.bool_or(F.col("s_acctbal") > 9000).alias("flagged"))
    return s.join(flags, "s_nationkey").select(F.col("s_suppkey").alias("id"), "flagged")


@query("tile_position", "SELECT p_partkey AS id, (row_number() OVER (ORDER BY p_partkey) - 1) % 45 AS x, (row_number() OVER (ORDER BY p_partkey) - 1) // 45 AS y, (row_number() OVER (ORDER BY p_partkey) - 1) // 25 AS batch FROM part")
def tile_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each row in a grid of 45 columns, and its batch of 25.

    Row numbers without one global window: rows are cut into ranges, counted,
    and numbered inside their range.
    """
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).withColumn("r", F.floor(F.col("id") / 512))
    first = p.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    first = first.select("r", (F.sum("n").over(Window.orderBy("r")) - F.col("n")).alias("o"))  # one row per range
    n = F.col("o") + F.row_number().over(Window.partitionBy("r").orderBy("id")) - 1
    return p.join(first, "r").select("id", n.alias("n")).select("id", (F.col("n") % 45).alias("x"), F.floor(F.col("n") / 45).alias("y"), F.floor(F.col("n") / 25).alias("batch"))
