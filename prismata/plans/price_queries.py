"""Price analytics: sold lines as observations of a part's price, events as series of a user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import candela_from_throw, round_half_up, si_text, slider_value, throw_from_candela
from ..operators import prices as pr
from .registry import query, table

AS_OF = "2001-11-05"
EVENTS_START, EVENTS_SECONDS = "2024-01-01", 30 * 86400 / pr.BUCKETS


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_partkey").alias("key"), F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("value").alias("price"))


OBS = "(SELECT l_partkey AS key, l_shipdate AS ts, l_extendedprice / l_quantity AS price FROM lineitem)"
STATS = f"(SELECT key, min(price) AS low, coalesce(min(price) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY), min(price)) AS low_recent, arg_max(price, (ts, price)) AS last FROM {OBS} o WHERE price > 0 GROUP BY key)"


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.statistics(observations(spark, sf_dir), "key", F.lit(AS_OF).cast("timestamp_ntz"))


@query("price_stats_all_time_90d_last", f"SELECT * FROM {STATS} s")
def price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir)


_BUCKET = f"greatest(CAST(ceil((epoch_us(ts) - epoch_us(TIMESTAMP '{EVENTS_START}')) / {EVENTS_SECONDS * 1e6}) AS BIGINT) - 1, 0)"
_ENDS = f"(SELECT u.key, b.b, (SELECT arg_max(price, (ts, price)) FROM (SELECT user_id AS key, ts, value AS price FROM events) e WHERE e.key = u.key AND e.price > 0 AND {_BUCKET} <= b.b) AS p FROM (SELECT DISTINCT user_id AS key FROM events) u, (SELECT unnest(range(0, {pr.BUCKETS})) AS b) b)"
_FILLED = f"(SELECT key, b, coalesce(p, first_value(p IGNORE NULLS) OVER (PARTITION BY key ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS p FROM {_ENDS} e)"


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.bucketed(user_series(spark, sf_dir), "key", F.lit(EVENTS_START).cast("timestamp_ntz"), EVENTS_SECONDS)


@query("price_asof_buckets", f"SELECT key, CAST(b AS INT) AS bucket, p AS price FROM {_FILLED} f")
def price_asof_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(spark, sf_dir).select("key", F.posexplode("prices").alias("bucket", "price"))


@query(
    "sparkline_path",
    f"""SELECT key, CASE WHEN hi > lo AND (hi - lo) / lo >= 0.05 THEN path ELSE '' END AS path FROM (
        SELECT key, any_value(lo) AS lo, any_value(hi) AS hi, string_agg((CASE WHEN b = 0 THEN 'M' ELSE 'L' END) || printf('%.1f', b * 50.0::DOUBLE / 23) || ',' || printf('%.1f', 18.0::DOUBLE - (p - lo) / (hi - lo) * 16), ' ' ORDER BY b) AS path
        FROM (SELECT *, min(p) OVER (PARTITION BY key) AS lo, max(p) OVER (PARTITION BY key) AS hi FROM {_FILLED} f) GROUP BY key)""",
)
def sparkline_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(spark, sf_dir).select("key", pr.sparkline(F.col("prices")).alias("path"))


_PCT = "floor(({low} - price) / {low} * 100 + 0.5)"


def _deal(price: str) -> str:
    return f"""(SELECT *, ok AND price <= low AS at_low, CASE WHEN ok THEN CAST({_PCT.format(low="low")} AS BIGINT) END AS pct_below_low, CASE WHEN ok THEN CAST({_PCT.format(low="low_recent")} AS BIGINT) END AS pct_below_recent
    FROM (SELECT s.*, {price} AS price, p.p_name AS model, {price} > 0 AND {price} >= 0.3 * last AS ok FROM {STATS} s JOIN part p ON p.p_partkey = s.key))"""


def deals(spark: SparkSession, sf_dir: str, price: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("model"), "p_retailprice")
    return pr.with_deal(stats(spark, sf_dir).join(p, "key").withColumn("price", F.col(price)))


@query("deal_flag_pct_below", f"SELECT key, at_low, pct_below_low, pct_below_recent FROM {_deal('p_retailprice')} d")
def deal_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deals(spark, sf_dir, "p_retailprice").select("key", "at_low", "pct_below_low", "pct_below_recent")


@query(
    "deals_feed_top100",
    f"SELECT key, model, price, low FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY price, key) AS n FROM (SELECT * FROM {_deal('last')} d WHERE at_low) QUALIFY n = 1) ORDER BY price, key LIMIT 100",
)
def deals_feed_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deals(spark, sf_dir, "last").where("at_low").withColumn("url", F.concat(F.lit("https://shop.example/"), F.col("key").cast("string")))
    return pr.deals_feed(d, "url", F.col("model"), [F.col("price").asc(), F.col("key").asc()]).select("key", "model", "price", "low")


@query("series_preference_coalesce", "SELECT user_id AS key, coalesce(arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase'), arg_max(value, (ts, event_id)) FILTER (event_type = 'view'), arg_max(value, (ts, event_id)) FILTER (event_type = 'click')) AS price FROM events WHERE value > 0 GROUP BY 1")
def series_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last positive value of the preferred channel."""
    e = table(spark, sf_dir, "events").where("value > 0")
    last = [F.max_by(F.when(F.col("event_type") == c, F.col("value")), F.when(F.col("event_type") == c, F.struct("ts", "event_id"))).alias(c) for c in ("purchase", "view", "click")]
    return e.groupBy(F.col("user_id").alias("key")).agg(*last).select("key", pr.current_price([F.col("purchase"), F.col("view"), F.col("click")]).alias("price"))


@query("json_props_parse", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("json_any_true", "SELECT user_id AS key, bool_or(event_type = 'purchase') AS in_stock FROM events GROUP BY 1")
def json_any_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability maps as JSON text, any channel true."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = e.groupBy(F.col("user_id").alias("key")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", (F.col("event_type") == "purchase").alias("v"))))).alias("payload"))
    return m.select("key", pr.any_true(F.col("payload")).alias("in_stock"))


@query("tracker_series", "SELECT key, epoch_us(ts) AS us, price FROM (SELECT p_partkey AS key, TIMESTAMP '2011-01-01' + INTERVAL (p_size) MINUTE AS ts, p_size / 100.0::DOUBLE AS price FROM part UNION ALL SELECT p_partkey, TIMESTAMP '2011-01-01' + INTERVAL (p_size + 60) MINUTE, -1.0 FROM part)")
def tracker_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat minute/cent arrays to rows; -1 stays out of stock."""
    p = table(spark, sf_dir, "part")
    base = 1293840000 // 60 - pr.TRACKER_MINUTES  # 2011-01-01 on the tracker's clock
    flat = F.array(F.col("p_size") + base, F.col("p_size"), F.col("p_size") + base + 60, F.lit(-1))
    t = p.select(F.col("p_partkey").alias("key"), F.explode(pr.from_tracker(flat)).alias("x"))
    return t.select("key", F.unix_micros("x.ts").alias("us"), F.col("x.price").alias("price"))


@query("mode_value", "SELECT key, mode, n FROM (SELECT l_partkey AS key, l_quantity AS mode, count(*) AS n, min(l_orderkey * 100 + l_linenumber) AS f FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, f, mode DESC) = 1")
def mode_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), "l_quantity", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at"))
    return pr.modal(t, "key", "l_quantity", "at")


@query("min_per_key", "SELECT l_partkey AS key, min(l_extendedprice / l_quantity) AS low FROM lineitem WHERE l_extendedprice / l_quantity BETWEEN 50 AND 5000 GROUP BY 1")
def min_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest price inside the bounds of each key."""
    t = table(spark, sf_dir, "lineitem")
    return t.where((F.col("l_extendedprice") / F.col("l_quantity")).between(50, 5000)).groupBy(F.col("l_partkey").alias("key")).agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("low"))


@query("alert_thresholds", "SELECT p_partkey AS key, CAST(floor(p_retailprice * 100 * 0.9 + 0.5) AS BIGINT) AS cents FROM part")
def alert_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), pr.alert_threshold(F.col("p_retailprice")).alias("cents"))


@query("si_format", "SELECT o_orderkey AS key, CASE WHEN v >= 100 THEN printf('%.0f', v) WHEN v >= 10 THEN printf('%.1f', v) ELSE printf('%.2f', v) END || p AS txt FROM (SELECT o_orderkey, CASE WHEN o_totalprice >= 1e6 THEN o_totalprice / 1e6 WHEN o_totalprice >= 1e3 THEN o_totalprice / 1e3 ELSE o_totalprice END AS v, CASE WHEN o_totalprice >= 1e6 THEN 'M' WHEN o_totalprice >= 1e3 THEN 'k' ELSE '' END AS p FROM orders)")
def si_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), si_text(F.col("o_totalprice")).alias("txt"))


@query("log_slider", "SELECT p_partkey AS key, round(pow(91.0, p_size / 50.0) + 9.0, 6) AS v FROM part")
def log_slider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.round(slider_value(F.col("p_size") / 50.0, 10, 100), 6).alias("v"))


@query("round_half_up", "SELECT l_orderkey, l_linenumber, CAST(floor((l_tax - 0.05) * 100 / 2 + 0.5) AS BIGINT) AS r FROM lineitem")
def round_half_up_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", round_half_up((F.col("l_tax") - 0.05) * 100 / 2).alias("r"))


@query("fl1_derive", "SELECT l_orderkey, l_linenumber, round(pow(l_quantity / 2, 2), 4) AS candela, round(2 * sqrt(l_extendedprice), 4) AS throw_m FROM lineitem")
def fl1_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(candela_from_throw(F.col("l_quantity")), 4).alias("candela"), F.round(throw_from_candela(F.col("l_extendedprice")), 4).alias("throw_m"))
