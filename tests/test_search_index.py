"""The index prunes and never loses a row."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from prismata.operators import facets as fc
from prismata.operators import search_index as si

WORDS = ["widget", "wi dget", "w-i-d-g-e-t", "beacon", "beacons", "lighthouse", "light house", "li-ght-hou-se", "x", "", None, "aa", "été", "ét é", "\\q.e", "wid", "dget wi"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(2)
    texts = WORDS + [" ".join(rng.choice([w for w in WORDS if w]) for _ in range(3)) for _ in range(60)] + ["".join(rng.choice("widget -") for _ in range(12)) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "beacon again"), (None, "widget")], "id long, t string")
    path = str(tmp_path_factory.mktemp("index"))
    si.build(df, "id", F.col("t"), path)
    return df, spark.read.parquet(path)


@pytest.mark.parametrize("query", ["widget", "wdget", "lighthouse", "wi", "x", "beacon widget", "été", "ete widget", "lghthouse beacon", "q.e", ""])
def test_same_rows_as_a_test_of_all(indexed, query):
    df, index = indexed
    want = sorted((r.id, r.t) for r in df.where("id is not null").where(fc.words_match(F.col("t"), query)).collect()) if query else None
    got = si.search(df, "id", F.col("t"), query, index)
    if want is None:
        assert got.count() == df.count()
    else:
        assert sorted((r.id, r.t) for r in got.where("id is not null").collect()) == want


def test_few_rows_are_left_and_few_partitions_read(indexed):
    df, index = indexed
    assert si.pieces("lighthouse") == ["lig", "hth", "ouse"] and si.pieces("wdget") == ["wd", "get"]
    some = si.candidates(index, "lighthouse")
    assert 0 < some.count() < df.count() / 2
    assert si.candidates(index, "x") is None
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "slot" in plan.split("PartitionFilters: [")[1].split("]")[0]
