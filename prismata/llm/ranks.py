"""Gapless ranks without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def ranked_in_order(df: DataFrame, group: list[str], order: list[Column], rank: str) -> DataFrame:
    """``df`` with ``rank``: 1, 2, 3 ... by ``order`` within each value of the ``group`` columns.

    Rows are dealt by ranges of (group, order), so a large group lies in many
    partitions.  A partition's rows are numbered by themselves; what a group has
    in the partitions before is a sum over one number per (partition, group).
    Rows that are equal in ``order`` get their ranks in any order.
    """
    by = [*[F.col(c).asc_nulls_first() for c in group], *order]
    dealt = common.saved(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))
    sizes = dealt.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"))
    before = (F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")).cast("long")
    sizes = sizes.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], before.alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return dealt.withColumn(rank, inside.cast("long")).join(sizes, same).withColumn(rank, F.col(rank) + F.col("_before")).select(*df.columns, rank)
