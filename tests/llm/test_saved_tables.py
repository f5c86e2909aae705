"""Saved tables: scratch ones go when an operator is done, all of them when asked."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from prismata.llm import common, jaccard_join

from .fixtures import PROSE


def folder(spark) -> Path:
    return Path(common.shared_dir(spark).removeprefix("file:").replace("///", "/").replace("//", "/")) / common._run_folder(spark)


def test_scratch_tables_go_and_others_stay(spark):
    scratch = common.Scratch(spark)
    one, two = scratch.saved(spark.range(5)), common.saved(spark.range(6))
    made = common.saved(one.withColumn("x", F.col("id") * 2))
    scratch.release()
    assert made.count() == 5 and two.count() == 6
    with pytest.raises(Exception, match="exist"):
        one.count()
    scratch.release()  # nothing left to do


def test_the_join_leaves_no_texts_but_its_numbered_rows(spark):
    docs = spark.createDataFrame([(i, f"{PROSE} {PROSE} {i % 3}") for i in range(30)], "doc_id long, text string")
    before = set(folder(spark).iterdir()) if folder(spark).exists() else set()
    got = jaccard_join.classes(docs)
    assert got.count() == 30
    left = [p for p in folder(spark).iterdir() if p not in before]
    texts = [p for p in left if "text" in spark.read.parquet(str(p)).columns]
    assert len(texts) == 1
    assert got.select("class_id").distinct().count() == 1


def test_the_stage_leaves_each_text_once(spark):
    """What the join leaves lies on the disk until the last stage; a second copy of the texts would take as much again."""
    docs = common.saved(spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2((F.col("id") * 40 + k).cast("string"), 256) for k in range(40)]).alias("text")))
    size = lambda p: sum(f.stat().st_size for f in p.rglob("*.parquet"))
    once = max(size(p) for p in folder(spark).iterdir())
    before = set(folder(spark).iterdir())
    got = jaccard_join.one_per_class(docs)
    assert got.count() == 2000 and got.schema == docs.schema
    assert sum(size(p) for p in folder(spark).iterdir() if p not in before) < 1.6 * once


def test_forget_deletes_all(spark):
    t = common.saved(spark.range(3))
    assert t.count() == 3 and folder(spark).exists()
    common.forget(spark)
    assert not folder(spark).exists()


def test_small_tables_take_less_disk(spark):
    t = spark.range(3000).select("id", F.concat_ws(" ", *[F.sha2((F.col("id") + k).cast("string"), 256) for k in range(5)]).alias("text"))
    scratch = common.Scratch(spark)
    plain, small = scratch.saved(t), scratch.saved(t, small=True)
    size = lambda df: sum(Path(f.removeprefix("file:").replace("///", "/")).stat().st_size for f in df.inputFiles())
    assert size(small) < 0.9 * size(plain)
    assert sorted(small.collect()) == sorted(plain.collect())
    scratch.release()
