"""Streams of events: windows, sessions, de-duplication, alerts, refresh queues.

Every transformation takes and gives a DataFrame, so the same expression runs on
a batch and on a stream.  State is bounded by a watermark or by the number of
keys; ``run_available`` drains what has arrived into Parquet in the folder that
all executors share and keeps its progress in a checkpoint beside it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a table, one file or a folder; the schema is the table's own."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, a single file is accepted too


def landing(spark: SparkSession) -> str:
    """A new folder, shared by all executors, for files that a stream will read."""
    return f"{shared_dir(spark)}/landing-{uuid.uuid4().hex}"


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], aggs: list[Column], watermark: str | None = None) -> DataFrame:
    return sliding(df, ts, width, None, keys, aggs, watermark)


def sliding(df: DataFrame, ts: str, width: str, step: str | None, keys: list[str], aggs: list[Column], watermark: str | None = None) -> DataFrame:
    """start, end, keys and aggregates of each window; each event counts in ``width / step`` windows."""
    if watermark and df.isStreaming:
        df = df.withWatermark(ts, watermark)
    t = df.groupBy(F.window(ts, width, step) if step else F.window(ts, width), *keys).agg(*aggs)
    names = [c for c in t.columns if c != "window"]
    return t.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *names)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: list[Column], watermark: str | None = None) -> DataFrame:
    """Runs of events of a key with less than ``gap`` between neighbours."""
    if watermark and df.isStreaming:
        df = df.withWatermark(ts, watermark)
    t = df.groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(*aggs)
    names = [c for c in t.columns if c != "window"]
    return t.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *names)


def deduplicated(df: DataFrame, keys: list[str], ts: str, watermark: str | None = None) -> DataFrame:
    """One row per key; with a watermark the state of a key goes after it."""
    if watermark and df.isStreaming:
        return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)


def latest(df: DataFrame, keys: list[str], ts: str, values: list[str], tie: str) -> DataFrame:
    """Per key the last values by time; the larger ``tie`` among equals."""
    return df.groupBy(*keys).agg(F.max(ts).alias(ts), *[F.max_by(v, F.struct(ts, tie)).alias(v) for v in values])


def with_outcome(df: DataFrame, error: Column) -> DataFrame:
    """Every item is done at most once: ``scraped`` is true whether it succeeded or not, ``error`` says why not."""
    return df.withColumn("error", error).withColumn("scraped", F.lit(True))


def run_available(df: DataFrame, mode: str = "append", name: str | None = None) -> DataFrame:
    """Drain a stream and give its result as a table.

    append: rows are added as they become final.  complete: each micro-batch
    writes the whole result anew, and the last one counts.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{name or uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/rows").start().awaitTermination()
    else:
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/rows")).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/rows")


def drain(queue: DataFrame, work, sink: str, name: str) -> None:
    """Micro-batches of a queue through ``work`` (DataFrame to DataFrame), appended to ``sink``.

    A batch that is run again after a failure replaces its own rows, so nothing
    is written twice.
    """
    spark = queue.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    queue.writeStream.option("checkpointLocation", f"{shared_dir(spark)}/stream-{name}").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
