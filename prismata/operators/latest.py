"""The latest request wins: a search that a newer one has overtaken is cancelled.

Requests of one name carry a job tag each.  A new request cancels the jobs of
the one before it; the overtaken call gives an empty result instead of an error.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, Row, SparkSession


class Latest:
    """One place that shows results, such as a search box."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.lock, self.tag = spark, threading.Lock(), None

    def rows(self, df: DataFrame) -> list[Row]:
        """The rows of ``df``, or none if a newer request came meanwhile; call it from a thread of its own for each request."""
        sc, tag = self.spark.sparkContext, f"latest-{uuid.uuid4().hex}"
        with self.lock:
            overtaken, self.tag = self.tag, tag
        if overtaken:
            sc.cancelJobsWithTag(overtaken)
        sc.addJobTag(tag)
        try:
            out = df.collect()
        except Exception:
            if self.tag == tag:
                raise
            return []
        finally:
            sc.removeJobTag(tag)
        return out if self.tag == tag else []
