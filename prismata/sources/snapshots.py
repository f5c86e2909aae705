"""A snapshot that grows: a bucketed table in partitions, of which an upsert writes the changed ones only.

The table is partitioned by ``slot``, the hash of the key, and bucketed by the
key.  An upsert reads the slots its new rows fall into (partition pruning),
meets them bucket by bucket (the old side is read as it lies, without a shuffle)
and overwrites these partitions only, dynamically.  Other partitions keep their
files.  Upserts give the same rows when they are run again, so a run that failed
halfway is simply repeated.

The folder must be one that all executors share; the table is external, so that
dropping it from the catalogue keeps the files.

Defined cases: a null key is refused by an error, as it would never be met
again; of several new rows with one key the last by ``order`` counts; an empty
upsert writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 16
BUCKETS = 8


class Snapshot:
    """``name``: the table in the session's catalogue; ``path``: its folder."""

    def __init__(self, spark: SparkSession, name: str, path: str, key: str, slots: int = SLOTS, buckets: int = BUCKETS) -> None:
        self.spark, self.name, self.path, self.key, self.slots, self.buckets = spark, name, path, key, slots, buckets

    def slot(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.slots)).cast("int")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _placed(self, df: DataFrame) -> DataFrame:
        key = F.when(F.col(self.key).isNull(), F.raise_error(F.lit("a row of a snapshot has no key"))).otherwise(F.col(self.key))
        return df.withColumn(self.key, key.cast(df.schema[self.key].dataType)).withColumn("slot", self.slot(F.col(self.key)))

    def create(self, first: DataFrame) -> None:
        """The table with its first rows, whose keys are unique."""
        placed = self._placed(first).repartition(self.buckets, self.key)
        placed.write.format("parquet").mode("overwrite").option("path", self.path).partitionBy("slot").bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(self.name)

    def merged(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], order: list[str] | None = None) -> tuple[DataFrame, list[int]]:
        """What the changed slots will hold, and these slots; ``merge`` gives the rows after an upsert of its second argument into its first."""
        placed = self._placed(new)
        if order:
            last = placed.groupBy(self.key).agg(F.max_by(F.struct(*placed.columns), F.struct(*order)).alias("_r"))
            placed = last.select(*[F.col("_r").getField(c).alias(c) for c in placed.columns])
        changed = sorted(r["slot"] for r in placed.select("slot").distinct().collect())  # at most ``slots`` numbers
        old = self.rows().where(F.col("slot").isin(changed)).drop("slot")
        return merge(old, placed.drop("slot")), changed

    def upsert(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], order: list[str] | None = None) -> list[int]:
        """Write the changed slots anew; gives their numbers."""
        out, changed = self.merged(new, merge, order)
        if not changed:
            return []
        placed = self._placed(out).select(*self.rows().columns)
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            placed.write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set(mode, before)
        self.spark.catalog.refreshTable(self.name)
        return changed
