"""State per key: price alerts against the price at which tracking began, and keys that went silent.

Both are stateful processors on RocksDB.  ``price_watch`` keeps a key's first
price, one entry per key, and answers each later price at or below its share of
it.  ``gone_stale`` keeps when a key was last seen, one list per bucket of keys
with a timer for the first of them that can fall silent; when the watermark
passes ``silence`` after a key's last event, the key comes out and goes from its
list, so state holds active keys only.  A batch reads and writes the buckets its
keys are in.  Progress and state lie in the stream's checkpoint, so a restart
goes on where it stopped.

Defined cases: rows with a null key, time or value are ignored; of rows that
come together the earliest by (time, id) begins the tracking, and rows that come
in a later batch do not change it, whatever their time; a key that comes back
after it went silent is tracked anew.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .events import run_available

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no path to this package

#: Groups of keys whose last sightings lie together.
BUCKETS = 4096
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rounded(x: pd.Series) -> pd.Series:
    """To the nearest whole number, halves away from zero as in SQL (numpy: to the even one)."""
    whole = np.trunc(x)
    return whole + np.sign(x) * ((x - whole).abs() >= 0.5)


class PriceWatch(StatefulProcessor):
    """(id, key, value, threshold) of prices at or below ``share`` of a key's first, in cents."""

    def __init__(self, share: float) -> None:
        self.share = share

    def init(self, handle) -> None:
        self.first = handle.getValueState("threshold", "cents double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(rows).sort_values(["ts", "id"])
        if self.first.exists():
            cents = self.first.get()[0]
        else:
            cents = float(math.floor(got["value"].iloc[0] * (100 * self.share) + 0.5))
            self.first.update((cents,))
        hits = got[_rounded(got["value"] * 100) <= cents]
        if len(hits):
            yield pd.DataFrame({"id": hits["id"], "key": key[0], "value": hits["value"], "threshold": cents})

    def close(self) -> None:
        pass


class Staleness(StatefulProcessor):
    """(key, last) of keys that were not seen for ``silence`` milliseconds of event time; times are microseconds.

    Rows are grouped by buckets of keys: what Python does for a group it does
    once for all its keys.  The state of a bucket is a list of its active keys.
    """

    def __init__(self, silence: int) -> None:
        self.silence = silence

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "key string, micros long")
        self.timer = handle.getValueState("timer", "due long")

    def due(self, micros: int) -> int:
        return -(-micros // 1000) + self.silence

    def keep(self, seen: dict[str, int], fired: bool = False) -> None:
        """Store what a bucket holds, and one timer for the first of its keys."""
        had = self.timer.get()[0] if self.timer.exists() else None
        first = self.due(min(seen.values())) if seen else None
        if first != had or fired:
            if had is not None and not fired:  # one that has fired is gone
                self.handle.deleteTimer(had)
            if first is not None:
                self.handle.registerTimer(first)
                self.timer.update((first,))
            else:
                self.timer.clear()
        if seen:
            self.seen.put(list(seen.items()))
        else:
            self.seen.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = dict(self.seen.get()) if self.seen.exists() else {}
        for r in rows:
            for k, micros in zip(r["key"].tolist(), r["micros"].tolist(), strict=True):
                if micros > seen.get(k, micros - 1):
                    seen[k] = micros
        self.keep(seen)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, seen = timerValues.getCurrentWatermarkInMs(), dict(self.seen.get())
        gone = {k: micros for k, micros in seen.items() if self.due(micros) <= now}
        self.keep({k: micros for k, micros in seen.items() if k not in gone}, fired=True)
        yield pd.DataFrame({"key": list(gone), "last": list(gone.values())})

    def close(self) -> None:
        pass


def _told(stream: DataFrame, key: str, ts: str, value: str, id_: str) -> DataFrame:
    t = stream.select(F.col(id_).cast("long").alias("id"), F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))
    return t.where("key is not null and ts is not null and value is not null")


def price_watch(stream: DataFrame, key: str, ts: str, value: str, id_: str, share: float = 0.9) -> DataFrame:
    """id, key, value, threshold (cents) of every price at or below ``share`` of the price its key began with."""
    keys = _told(stream, key, ts, value, id_).groupBy("key")
    return keys.transformWithStateInPandas(PriceWatch(share), "id long, key string, value double, threshold double", "Append", "None")


def gone_stale(stream: DataFrame, key: str, ts: str, silence_days: float = 3, watermark: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """key, last: keys whose last event lies ``silence_days`` behind the watermark.

    ``buckets``: groups that keys are dealt into; a stream goes on from its
    checkpoint with the number it began with.
    """
    t = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")).where("key is not null and ts is not null")
    t = t.select("key", "ts", F.unix_micros("ts").alias("micros"), F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    keys = t.withWatermark("ts", watermark).groupBy("bucket")
    stale = keys.transformWithStateInPandas(Staleness(int(silence_days * 86_400_000)), "key string, last long", "Append", "EventTime")
    return stale.select("key", F.timestamp_micros("last").alias("last"))


def run_stateful(df: DataFrame, name: str | None = None) -> DataFrame:
    """``run_available`` with the state store that these processors need."""
    spark: SparkSession = df.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, PROVIDER)
    try:
        return run_available(df, "append", name)
    finally:
        spark.conf.set(setting, before)
