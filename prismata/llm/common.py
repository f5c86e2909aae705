"""Session helpers shared by the operators."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cast(df: DataFrame, types: dict[str, str]) -> list[Column]:
    have = {c.lower(): c for c in df.columns}
    return [(F.col(f"`{have[n.lower()]}`").cast(t) if n.lower() in have else F.lit(None).cast(t)).alias(n) for n, t in types.items()]


def with_columns(df: DataFrame, **types: str) -> DataFrame:
    """The named columns, cast; a missing one is null.  Other columns go."""
    return df.select(*_cast(df, types))


def boxed(docs: DataFrame, **types: str) -> DataFrame:
    """The named columns, cast, beside ``_row``: each row of ``docs`` whole, so that no name can clash with its columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *_cast(docs, types))


def inside(df: DataFrame, name: str, kind: str) -> Column:
    """A column of the rows that ``boxed`` has packed, cast; a missing one is null."""
    have = {c.lower(): c for c in df.schema["_row"].dataType.names}
    return (F.col("_row").getField(have[name.lower()]) if name.lower() in have else F.lit(None)).cast(kind)


def unboxed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def workers_import(spark: SparkSession) -> None:
    """Make the package importable on executors when no path leads to it."""
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in paths or os.getcwd() == str(ROOT) or getattr(spark.sparkContext, "_prismata_sent", False):
        return
    target = Path(tempfile.mkdtemp(), "prismata_llm.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in (ROOT / "prismata").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._prismata_sent = True
    if str(ROOT) not in sys.path:
        sys.path.insert(0, str(ROOT))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` or the context's checkpoint folder.

    A session that has neither, such as a local one, must set one: a machine's
    own temporary folder would be lost with its executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="prismata-checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _save(df: DataFrame, small: bool = False) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{_run_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd" if small else None)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again."""
    return _save(df)[0]


class Scratch:
    """Saved tables that an operator is done with before it returns, so that its result never reads them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def saved(self, df: DataFrame, small: bool = False) -> DataFrame:
        """``df`` as a stored table; a ``small`` one takes less disk and more time."""
        table_, path = _save(df, small)
        self.paths.append(path)
        return table_

    def release(self) -> None:
        """Delete the tables; what was made from them must have been saved."""
        for path in self.paths:
            _delete(self.spark, path)
        self.paths = []


def _run_folder(spark: SparkSession) -> str:
    """One folder for each application, so that what a run has left can be deleted after it (``forget``)."""
    return f"prismata-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def forget(spark: SparkSession) -> None:
    """Delete the tables this application has saved; results that were not yet written need them."""
    _delete(spark, f"{shared_dir(spark).rstrip('/')}/{_run_folder(spark)}")


def numbered(df: DataFrame, number: str, **types: str) -> DataFrame:
    """The named columns of a stored table, cast, and ``number``: each row's place in the table, gapless from 0.

    The order of a stored table is that of its part files (which Spark numbers
    by the partition they were written from), and inside a file that of its
    rows; it does not depend on how the files are split for reading.
    """
    meta = df.metadataColumn("_metadata")
    part = lambda i: F.regexp_extract(meta["file_name"], r"^part-(\d+)(?:.*-c(\d+))?", i).cast("long")
    d = df.select(*_cast(df, types), meta["file_name"].alias("_file"), part(1).alias("_part"), F.coalesce(part(2), F.lit(0)).alias("_file_of_part"), meta["row_index"].alias("_row_index"))
    files = d.groupBy("_part", "_file_of_part", "_file").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per file
    first, before = [], 0
    for r in sorted(files, key=lambda r: (r["_part"] is None, r["_part"] or 0, r["_file_of_part"], r["_file"])):
        first.append((r["_file"], before))
        before += r["n"]
    starts = df.sparkSession.createDataFrame(first, "_file string, _start long")
    return d.join(F.broadcast(starts), "_file").select(*types, (F.col("_start") + F.col("_row_index")).alias(number))


def learning_fold(doc_id: Column) -> Column:
    """True for rows whose labels may be learnt from: crc32(doc_id as text) mod 3 is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(labels: DataFrame, value: str, limit: int, only: int | None = None) -> DataFrame:
    """At most ``limit`` (doc_id, label) rows of the learning folds, in hash order; of one label if ``only`` is given.

    Contradicting labels of one doc_id meet in their maximum; rows without id
    or label go.  The bound is what makes the result safe to broadcast.
    """
    t = with_columns(labels, doc_id="long", **{value: "int"}).where(F.col("doc_id").isNotNull() & F.col(value).isNotNull() & learning_fold(F.col("doc_id")))
    t = t.groupBy("doc_id").agg(F.max(value).alias("label"))
    if only is not None:
        t = t.where(F.col("label") == only)
    return t.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def ranked(df: DataFrame, group: str, order: list[str], rank: str, per_bucket: int = 2000) -> DataFrame:
    """``df`` with ``rank``, a gapless number from 0 within each value of ``group``.

    Numbering one group in one task would gather a hot group.  Instead rows are
    dealt into hash buckets of about ``per_bucket`` rows; bucket sizes, added up
    over (group, bucket), give each bucket its first number and a window numbers
    rows inside a bucket only.  ``order`` columns seed the bucket hash and
    settle the order, so equal input gives equal numbers up to identical rows.
    Rows whose first ``order`` column is null, which may be many, are told apart
    by all their columns.
    """
    buckets = max(1, -(-df.count() // per_bucket))
    whole = F.when(F.col(order[0]).isNull(), F.xxhash64(*[c for c in df.columns if c != group]))
    df = df.withColumn("_h", F.xxhash64(*order, whole)).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)))
    sizes = df.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.select(group, "_b", (F.sum("_n").over(Window.partitionBy(group).orderBy("_b")) - F.col("_n")).alias("_o"))
    inside = F.row_number().over(Window.partitionBy(group, "_b").orderBy("_h", *order)) - 1
    return df.join(first, [group, "_b"]).withColumn(rank, F.col("_o") + inside).drop("_h", "_b", "_o")
