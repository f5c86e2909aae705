"""Weights, keys and draws against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prismata.llm import importance

from .fixtures import EDGES, edge_docs, no_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TARGET = ["the lazy dog sleeps", None, "", "Nine WISE owls — 東京タワー", "word1 and1 word2"]


def features(text: str | None, orders: int, buckets: int) -> list[int]:
    w = WORD.findall((text or "").translate(UPPER))
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, orders=1, buckets=10_000, least=20, percent=10) -> Counter:
    s = Counter(b for r in rows for b in features(r[1], orders, buckets))
    t = Counter(b for x in target for b in features(x, orders, buckets))
    ss, tt = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in s}
    out = []
    for r in rows:
        f = features(r[1], orders, buckets)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(features(r[1], 1, buckets)) >= least])
    enough = sorted((o for o in out if o[4]), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    take = percent * len(enough) // 100
    rank = {id(o): i for i, o in enumerate(enough, 1) if i <= take}
    return Counter((*o[:4], rank.get(id(o))) for o in out)


def told(df) -> Counter:
    return Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize(("orders", "buckets", "percent"), [(1, 10_000, 10), (3, 500, 70), (2, 7, 100)])
def test_edges_match_brute_force(spark, orders, buckets, percent):
    target = spark.createDataFrame([(x, 1) for x in TARGET], "text string, rid int")
    got = told(importance.resample(edge_docs(spark), target, orders=orders, buckets=buckets, percent=percent))
    assert got == brute(EDGES, TARGET, orders, buckets, percent=percent)


def test_small_tables_match_brute_force(spark, small_dir):
    docs, bench = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    texts = [r.text for r in bench.collect()]
    for orders in (1, 2):
        assert told(importance.resample(docs, bench, orders=orders)) == brute(rows, texts, orders)


def test_drawn_keeps_rows_and_columns(spark):
    docs, target = edge_docs(spark), spark.createDataFrame([(x,) for x in TARGET], "text string")
    ranks = {r.doc_id for r in importance.resample(docs, target, percent=50).where("rank is not null").collect()}
    got = importance.drawn(docs, target, percent=50)
    assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert {r.doc_id for r in got.collect()} == ranks and got.exceptAll(docs).isEmpty()


def test_empty_tables(spark):
    assert importance.resample(no_docs(spark), no_docs(spark)).collect() == []
    assert told(importance.resample(edge_docs(spark), no_docs(spark))) == brute(EDGES, [])


def test_no_window_of_words_for_order_one(spark):
    docs = edge_docs(spark).withColumn("rid", F.monotonically_increasing_id())
    plan = importance.position_table(docs, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    assert importance.position_table(docs, 2)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
