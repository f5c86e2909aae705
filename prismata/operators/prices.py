"""Price series: reading, statistics, as-of buckets, sparklines, deals.

A series is a long table (key, ts, price); a price of 0 or less means out of
stock.  Everything relative to "now" takes an ``as_of`` timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import pairs_of
from ..functions.numbers import fixed_text, percent_below, round_half_up

# fixed values: the tracker's clock starts this many minutes before the Unix epoch counts; -1 is out of stock
TRACKER_MINUTES = 21564000
BUCKETS = 24
FLAT = 0.05
SANE = 0.3
CHANNELS = ["Amazon", "Amazon Buy Box", "Amazon 3P New"]


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp, whatever the session's time zone."""
    t = ts.cast("timestamp_ntz")
    seconds = F.unix_date(t.cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
    return seconds * 1000000 + (F.extract(F.lit("SECOND"), t) * 1000000).cast("long")


def from_tracker(flat: Column) -> Column:
    """Flat [minutes, cents, ...] as array of struct (ts, price); out of stock keeps a negative price."""
    return F.transform(pairs_of(flat), lambda s: F.struct(F.timestamp_millis((s["t"].cast("long") + TRACKER_MINUTES) * 60000).alias("ts"), F.when(s["p"] < 0, F.lit(-1.0)).otherwise(s["p"] / 100.0).alias("price")))


def preferred_series(payload: Column, channels: list[str] = CHANNELS) -> Column:
    """The first channel present in a JSON map of channel to [[unix ms, price], ...]."""
    m = F.from_json(payload, "map<string, array<array<double>>>")
    pairs = F.coalesce(*[F.try_element_at(m, F.lit(c)) for c in channels])
    return F.transform(pairs, lambda p: F.struct(F.timestamp_millis(F.get(p, 0).cast("long")).alias("ts"), F.get(p, 1).alias("price")))


def any_true(payload: Column) -> Column:
    """Whether a JSON map of name to boolean holds a true; null where it cannot be read."""
    return F.exists(F.map_values(F.from_json(payload, "map<string, boolean>")), lambda x: F.coalesce(x, F.lit(False)))


def current_price(prices: list[Column]) -> Column:
    """The first positive one by preference."""
    return F.coalesce(*[F.when(p > 0, p) for p in prices])


def statistics(series: DataFrame, key: str, as_of: Column, days: int = 90) -> DataFrame:
    """key, low, low_recent (``low`` without a recent price), last: one pass, map-side combined."""
    t = series.where("price > 0")
    recent = F.min(F.when(F.col("ts") >= as_of - F.make_interval(days=F.lit(days)), F.col("price")))
    return t.groupBy(key).agg(F.min("price").alias("low"), F.coalesce(recent, F.min("price")).alias("low_recent"), F.max_by("price", F.struct("ts", "price")).alias("last"))


def bucketed(series: DataFrame, key: str, start: Column, seconds: float, buckets: int = BUCKETS) -> DataFrame:
    """key and ``prices``: for each bucket the last positive price at or before its end, gaps at the front filled backwards.

    An observation goes to the first bucket whose end it precedes, so one
    partially aggregated row per (key, bucket) is all that moves; the as-of
    fill then runs over ``buckets`` array items of a key.  No row is copied to
    later buckets.
    """
    t = series.where("price > 0")
    at = F.greatest(F.ceil((micros(F.col("ts")) - micros(start)) / F.lit(seconds * 1e6)) - 1, F.lit(0)).cast("int")
    t = t.withColumn("_b", at).where(F.col("_b") < buckets)
    last = t.groupBy(key, "_b").agg(F.max_by("price", F.struct("ts", "price")).alias("p"))
    m = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_b", "p"))).alias("m"))  # at most ``buckets`` entries
    seen = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.try_element_at(F.col("m"), i))
    ahead = F.aggregate(seen, F.array().cast("array<double>"), lambda acc, p: F.concat(acc, F.array(F.coalesce(p, F.get(acc, F.size(acc) - 1)))))
    return m.withColumn("_f", ahead).select(key, F.transform("_f", lambda p: F.coalesce(p, F.get(F.array_compact("_f"), 0))).alias("prices"))


def sparkline(prices: Column, width: float = 50, height: float = 20, pad: float = 2, flat: float = FLAT) -> Column:
    """SVG path of a series; empty where it varies by less than ``flat``."""
    low, high = F.array_min(prices), F.array_max(prices)
    inner = height - 2 * pad

    at = F.transform(prices, lambda p, i: F.struct((i * F.lit(width) / (F.size(prices) - 1)).alias("x"), (F.lit(pad + inner) - (p - low) / (high - low) * inner).alias("y")))
    point = lambda p, i: F.concat(F.when(i == 0, "M").otherwise("L"), fixed_text(p.x, 1), F.lit(","), fixed_text(p.y, 1))
    path = F.array_join(F.transform(at, point), " ")
    return F.when((high > low) & ((high - low) / low >= flat), path).otherwise("")


def with_deal(stats: DataFrame, price: str = "price", in_stock: str | None = None) -> DataFrame:
    """``at_low``, ``pct_below_low``, ``pct_below_recent`` beside the statistics.

    A price is judged when it is positive, not known to be out of stock and at
    least ``SANE`` of the last one.
    """
    p = F.col(price)
    ok = (p > 0) & (p >= SANE * F.col("last"))
    if in_stock:
        ok = ok & F.coalesce(F.col(in_stock), F.lit(True))
    ok = F.coalesce(ok, F.lit(False))
    return stats.select("*", (ok & (p <= F.col("low"))).alias("at_low"), F.when(ok, percent_below(F.col("low"), p)).alias("pct_below_low"), F.when(ok, percent_below(F.col("low_recent"), p)).alias("pct_below_recent"))


def first_of(df: DataFrame, key: Column, order: list[Column], keep_null: bool = False) -> DataFrame:
    """The first row of each key in ``order``; rows without a key all stay if ``keep_null``."""
    t = df.withColumn("_k", key)
    ranked = t.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(*order)))
    return ranked.where((F.col("_n") == 1) | (F.lit(keep_null) & F.col("_k").isNull())).drop("_k", "_n")


def deals_feed(deals: DataFrame, url: str, model_key: Column, order: list[Column], most: int = 100) -> DataFrame:
    """Cheapest deals: one per url, then one per model, then the first ``most`` in order."""
    once = first_of(deals, F.col(url), order, keep_null=True)
    return first_of(once, model_key, order).orderBy(*order).limit(most)


def alert_threshold(price: Column, share: float = 0.9) -> Column:
    """Cents below which a price raises an alert."""
    return round_half_up(price * 100 * share)


def modal(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each key; the one seen first among equals."""
    t = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return t.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("mode"), F.max("n").alias("n"))
