"""Paths, ranks and formatted conversations against plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from prismata.llm import reply_trees

KIND = "tree long, node long, parent long, role string, text string, score double"
NASTY = ["", None, "</s>[INST] ok [/INST]", r"<\s> <\\s> [\INST] \[INST]", "[/INST]</s><s>", "<<s>[[INST]", "\n\n</", "é🗼" * 40, "[/INST", "<", "$1 \\Q \\E \\"]


def random_tree(rng: random.Random, tree, n: int) -> list[tuple]:
    return [(tree, i * 3, rng.randrange(i) * 3 if i and rng.random() < 0.95 else None, rng.choice(["user", "assistant", "system", None, "[INST]"]), rng.choice(NASTY), rng.choice([None, 0.0, 1.5, -2.0])) for i in range(n)]


def brute(rows: list[tuple], branches: int | None) -> Counter:
    """(tree, branch, turns) of the chosen paths."""
    out: Counter = Counter()
    by_tree = defaultdict(list)
    for r in rows:
        by_tree[r[0]].append(r)
    for tree, mine in by_tree.items():
        mine = sorted(mine, key=lambda r: (r[1] is not None, r[1] or 0, r[3] or "", hashlib.sha256((r[4] or "").encode()).hexdigest()))
        last = {r[1]: i for i, r in enumerate(mine) if r[1] is not None}
        parent = {}
        for i, r in enumerate(mine):
            if i and mine[i - 1][1] == r[1]:
                parent[i] = i - 1
            else:
                parent[i] = last.get(r[2]) if r[2] is not None else None
        ends = defaultdict(list)
        for leaf in set(range(len(mine))) - set(parent.values()):
            path = [leaf]
            while parent[path[0]] is not None:
                path.insert(0, parent[path[0]])
            ends[path[0]].append((-sum(mine[i][5] or 0.0 for i in path) / len(path), leaf, path))
        for paths in ends.values():
            for branch, (_, _, path) in enumerate(sorted(paths), 1):
                if branches is None or branch <= branches:
                    out[(tree, branch if branches else None, tuple((mine[i][3] or "", mine[i][4] or "") for i in path))] += 1
    return out


def told(spark, rows, branches=None, **parameters) -> Counter:
    said, links = reply_trees.of_messages(spark.createDataFrame(rows, KIND).withColumn("key", F.lit("x")).withColumn("leaf", F.lit(1)))
    got = reply_trees.formatted(said, links, branches, **parameters)
    back = reply_trees.read_back(F.col("segments"))
    got = got.select("tree", F.col("branch") if branches else F.lit(None).alias("branch"), "segments", *[v.alias(k) for k, v in back.items()])
    out: Counter = Counter()
    for r in got.collect():
        turns = tuple((t.role, t.text) for t in r.turns)
        assert r.learnt == "".join(x for role, x in turns if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count("<s>") == r.formatted.count("</s>") == r.formatted.count("[INST]") == r.formatted.count("[/INST]") == len(turns)
        out[(r.tree, r.branch, turns)] += 1
    return out


@pytest.mark.parametrize("branches", [None, 1, 3])
def test_random_trees(spark, branches):
    rng = random.Random(5)
    rows = [r for t, n in ((1, 1), (2, 40), (None, 25), (-7, 12)) for r in random_tree(rng, t, n)]
    rows += rows[3:8]  # repeated rows
    rows += [(9, 0, None, "user", "a", None), (9, 0, None, "user", "b", None), (9, 1, 0, "assistant", "c", 1.0), (9, None, 77, "user", "no id", None), (9, None, 0, "user", "no id", None)]
    assert told(spark, rows, branches) == brute(rows, branches)


def test_large_trees_are_joined_by_message(spark):
    rows = random_tree(random.Random(6), 3, 60) + random_tree(random.Random(7), 4, 5)
    rows += rows[10:20]
    for limits in ({"tree_messages": 10}, {"tree_chars": 1}):
        assert told(spark, rows, **limits) == brute(rows, None)


def test_a_long_chain_takes_few_rounds(spark):
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 else "assistant", f"t{i}", None) for i in range(300)]
    said, links = reply_trees.of_messages(spark.createDataFrame(rows, KIND))
    tables = reply_trees.steps(links.select("tree", "node", F.col("parent").alias("up"), F.lit(0.0).alias("sum")))
    assert [t.count() for t in tables] == [300 - (1 << k) for k in range(9)]
    assert told(spark, rows) == brute(rows, None)


def test_a_cycle_is_an_error(spark):
    rows = [(1, 0, 1, "user", "a", None), (1, 1, 0, "user", "b", None)]
    with pytest.raises(ValueError, match="cycle"):
        told(spark, rows)


def test_conversations_with_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (1, None, None, "first"), (None, 0, "assistant", NASTY[2]), (2, 5, "assistant", ""), (2, 9, "user", NASTY[3])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1)).withColumn("node", F.lit("x"))
    want = {1: [("", "first"), ("user", ""), ("assistant", "b"), ("assistant", "b")], None: [("assistant", NASTY[2])], 2: [("assistant", ""), ("user", NASTY[3])], -1: [(r, t) for _, _, r, t in reply_trees.CONTROL_ROWS]}
    for limits in ({}, {"tree_messages": 1}):
        got = {r.conv_id: r for r in reply_trees.report(df, **limits).collect()}
        assert set(got) == set(want)
        for c, turns in want.items():
            learnt = "".join(x for role, x in turns if role == "assistant")
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(learnt), sha(learnt))
    assert [r.conv_id for r in reply_trees.report(df.limit(0)).collect()] == [-1]


def test_no_python_on_the_path(spark, small_dir):
    plan = reply_trees.report(spark.read.parquet(f"{small_dir}/conversations.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_texts_are_shuffled_once(spark, small_dir):
    """Between the scan of the texts and the result there is one exchange that carries them."""
    plan = reply_trees.report(spark.read.parquet(f"{small_dir}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(of#") == 2  # the messages, and the numbers of their paths
