"""Upserts into a bucketed, partitioned snapshot."""

from __future__ import annotations

import uuid
from pathlib import Path

import pytest

from prismata.operators import entities as en
from prismata.sources.snapshots import Snapshot


def merge(old, new):
    return en.upserted(old, new, "id", ["v"], {}, [], [])


@pytest.fixture
def snapshot(spark, tmp_path):
    name = f"snap_{uuid.uuid4().hex}"
    s = Snapshot(spark, name, str(tmp_path / "rows"), "id", slots=8, buckets=4)
    s.create(spark.createDataFrame([(i, f"v{i}") for i in range(400)], "id long, v string"))
    yield s
    spark.sql(f"DROP TABLE {name}")


def files(s: Snapshot) -> dict[str, set[str]]:
    return {p.name: {f.name for f in p.glob("*.parquet")} for p in Path(s.path).glob("slot=*")}


def told(s: Snapshot) -> dict:
    return {r.id: r.v for r in s.rows().collect()}


def test_only_changed_partitions_are_written(spark, snapshot):
    before = files(snapshot)
    new = spark.createDataFrame([(7, "new"), (7, "newer"), (1000, "added"), (9, None)], "id long, v string").withColumnRenamed("v", "v")
    changed = snapshot.upsert(new, merge, order=["v"])
    want = {i: f"v{i}" for i in range(400)} | {7: "newer", 1000: "added"}
    assert told(snapshot) == want
    after = files(snapshot)
    assert len(before) == 8 and {k for k in after if after[k] != before[k]} == {f"slot={c}" for c in changed} and len(changed) < 8
    assert snapshot.upsert(new, merge, order=["v"]) == changed and told(snapshot) == want
    assert snapshot.upsert(new.limit(0), merge) == [] and told(snapshot) == want


def test_the_old_side_is_not_shuffled(spark, snapshot):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, _ = snapshot.merged(spark.createDataFrame([(7, "new")], "id long, v string"), merge)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert "slot" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_null_key_is_refused(spark, snapshot):
    with pytest.raises(Exception, match="no key"):
        snapshot.upsert(spark.createDataFrame([(None, "x")], "id long, v string"), merge)
