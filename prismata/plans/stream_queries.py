"""Structured Streaming over ``events``; each result equals the batch SQL beside it.

Windows run in append mode: a window comes out when the watermark has passed
its end, so the SQL keeps those windows only; state goes with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming import events as ev
from ..streaming import state as st
from .registry import query, table

_SUMS = "count(*) AS n, round(sum(value), 4) AS total"
#: The watermark at the end of the stream.
_FINAL = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"


def _aggs() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")]


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, with a watermark-ready timestamp."""
    e = ev.read_events(spark, f"{sf_dir}/events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_tumbling", f"SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS \"end\", event_type, {_SUMS} FROM events GROUP BY 1, 2, 3 HAVING \"end\" <= {_FINAL}")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(ev.run_available(ev.tumbling(_stream(spark, sf_dir), "ts", "6 hours", ["event_type"], _aggs(), "1 day")))


@query("stream_sliding", f"SELECT start, start + INTERVAL 6 HOUR AS \"end\", event_type, {_SUMS} FROM (SELECT *, unnest([time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 4 HOUR, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 2 HOUR, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01')]) AS start FROM events) GROUP BY 1, 2, 3 HAVING start + INTERVAL 6 HOUR <= {_FINAL}")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(ev.run_available(ev.sliding(_stream(spark, sf_dir), "ts", "6 hours", "2 hours", ["event_type"], _aggs(), "1 day")))


@query(
    "stream_session",
    f"""SELECT min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", user_id, {_SUMS} FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
            SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 12 HOUR <= {_FINAL}""",
)
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user: at most twelve hours between neighbours."""
    return _plain(ev.run_available(ev.sessions(_stream(spark, sf_dir), "ts", "12 hours", ["user_id"], _aggs(), "1 day")))


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once although every one is delivered twice; an id is forgotten a day after its last event time."""
    e = _stream(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")
    again = _stream(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")
    return ev.run_available(ev.deduplicated(e.unionByName(again), ["event_id"], "ts", "1 day").drop("ts"))


_BUCKET = "time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')"


@query(
    "stream_late_drop",
    f"""SELECT {_BUCKET} AS start, {_BUCKET} + INTERVAL 6 HOUR AS "end", event_type, {_SUMS} FROM events
        WHERE event_id % 2 = 0 OR {_BUCKET} + INTERVAL 6 HOUR > (SELECT max(ts) - INTERVAL 1 DAY FROM events WHERE event_id % 2 = 0) GROUP BY 1, 2, 3 HAVING "end" <= {_FINAL}""",
)
def stream_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with odd ids arrive after a restart: those whose window the watermark has passed are dropped."""
    landed, name = ev.landing(spark), f"late-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        e.where(part).write.mode("append").parquet(landed)
        late = ev.read_events(spark, landed).withColumn("ts", F.col("ts").cast("timestamp"))
        out = ev.run_available(ev.tumbling(late, "ts", "6 hours", ["event_type"], _aggs(), "1 day"), name=name)
    return _plain(out)


@query("stream_latest", "SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last seen time and value of every key, kept as state."""
    out = ev.run_available(ev.latest(_stream(spark, sf_dir), ["user_id"], "ts", ["value"], "event_id"), "complete")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_START = "SELECT user_id, floor(arg_min(value, (ts, event_id)) * 90 + 0.5) AS threshold FROM events GROUP BY user_id"


@query("stream_price_alert", f"SELECT e.event_id, e.user_id, e.value, t.threshold::DOUBLE AS threshold FROM events e JOIN ({_START}) t USING (user_id) WHERE round(e.value * 100) <= t.threshold")
def stream_price_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices at or below nine tenths of the price at which a key's tracking began, which is held in state."""
    hits = st.run_stateful(st.price_watch(_stream(spark, sf_dir), "user_id", "ts", "value", "event_id"))
    return hits.select(F.col("id").alias("event_id"), F.col("key").cast("long").alias("user_id"), "value", "threshold")


_KEY = "user_id || ':' || event_type"


@query("stream_stale_keys", f"SELECT key, last, row_number() OVER (ORDER BY last, key) AS place FROM (SELECT {_KEY} AS key, max(ts) AS last FROM events GROUP BY 1) WHERE last + INTERVAL 3 DAY <= {_FINAL}")
def stream_stale_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events that a user has not shown for three days, oldest first, by timers."""
    e = _stream(spark, sf_dir).withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    stale = st.run_stateful(st.gone_stale(e, "key", "ts"))
    stale = stale.withColumn("hour", F.floor(F.unix_seconds("last") / 3600))
    before = stale.groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("hour", (F.sum("n").over(Window.orderBy("hour")) - F.col("n")).alias("before"))  # one row per hour
    place = F.col("before") + F.row_number().over(Window.partitionBy("hour").orderBy("last", "key"))
    return stale.join(before, "hour").select("key", F.col("last").cast("timestamp_ntz").alias("last"), place.cast("long").alias("place"))
