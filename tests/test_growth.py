"""Work that must not grow faster than the tables: pairs in blocks, cells once each, two candidates a name, postings by size."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from prismata.operators import entities as en
from prismata.operators import search_index
from prismata.operators import vocabulary as vo


def test_blocks_lose_no_pair(spark):
    rows = [("a", i % 9) for i in range(11)] + [("b", 1), ("b", 2), ("c", 1), (None, 1), (None, 2), ("a", None)]
    got = en.pairs(spark.createDataFrame(rows, "k string, id long"), ["k"], "id", block=2)
    want = sorted((x[0], x[1], y[1]) for x in rows for y in rows if x[0] and x[0] == y[0] and None not in (x[1], y[1]) and x[1] < y[1])
    assert sorted(map(tuple, got.select("k", "a", "b").collect())) == want
    assert got.select("k", "a").rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_cell_is_read_once_for_all_rows_that_hold_it(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def slow(cell):
        seen.add(1)
        return [x.upper() for x in cell]

    cells = [["x", "y"], ["z"], None, []]
    t = spark.createDataFrame([(i, cells[i % 4]) for i in range(400)], "id long, cell array<string>")
    got = vo.once_each(t, "cell", lambda c: slow(c), "new").collect()
    assert len(got) == 400 and all(r.new == (None if r.cell is None else [x.upper() for x in r.cell]) for r in got)
    assert seen.value == 3


def test_two_ids_of_a_name_answer_every_row(spark):
    rows = [(i, "b", "red x") for i in (5, 3, 3, 9)] + [(4, "b", "blue x"), (2, "b", "blue x"), (None, "b", "blue x"), (8, None, "red x"), (1, "c", "red x")]
    t = spark.createDataFrame(rows, "id long, brand string, name string")
    got = en.variant_candidates(t, t, "brand", "name", "id", [F.replace("name", F.lit("red"), F.lit("blue")), F.col("name")])
    assert {r.id: r.candidate for r in got.collect()} == {5: 2, 3: 2, 9: 2, 4: 2, 2: 4}
    wide = spark.range(3000).select("id", F.lit("b").alias("brand"), F.lit("n").alias("name"))
    many = en.variant_candidates(wide, wide, "brand", "name", "id", [F.col("name")])
    assert {r.candidate: r["count"] for r in many.groupBy("candidate").count().collect()} == {0: 2999, 1: 1}
    assert "dense_rank" in many._jdf.queryExecution().optimizedPlan().toString()  # before the join, which then makes one row for each


def test_postings_of_a_frequent_pair_are_split(spark, tmp_path):
    rows = [(i, f"ab{i}") for i in range(4000)] + [(7, "ab7"), (8, "zz"), (None, "ab"), (9, None)]
    path, size = str(tmp_path / "index"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "4KB")
    try:
        search_index.build(spark.createDataFrame(rows, "id long, text string").coalesce(1), "id", F.col("text"), path)
    finally:
        spark.conf.set(size, before)
    index = spark.read.parquet(path)
    want = {(i, t[k : k + 2]) for i, t in rows if i is not None and t for k in range(len(t) - 1)}
    got = [(r.id, r.pair) for r in index.select("id", "pair").collect()]
    assert len(got) == len(want) and set(got) == want
    slot = index.where("pair = 'ab'").select("slot").first().slot
    assert len(glob.glob(f"{path}/slot={slot}/*.parquet")) > 1
