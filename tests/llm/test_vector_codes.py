"""Nearest entries, codebooks and codes against a search of all entries in Python integers."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.llm import vector_codes as vc

KIND = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=8, entries=16, rounds=6) -> Counter:
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not good:
        return Counter()
    clamp = lambda x: min(max(math.floor(x * 4096), -vc.LIMIT), vc.LIMIT)
    good = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[clamp(x) for x in r[1]] for r in good]
    width = len(whole[0])
    at = [i * width // parts for i in range(parts + 1)]
    cut = [[w[at[p] : at[p + 1]] for p in range(parts)] if len(w) == width else None for w in whole]
    books = [[c[p] for c in cut[:entries] if c] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            got = defaultdict(list)
            for c in cut:
                if c:
                    got[near(p, c[p])[1]].append(c[p])
            new.append([[sum(v) // len(got[i]) for v in zip(*got[i], strict=True)] if got[i] else e for i, e in enumerate(books[p])])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(p, c[p]) for p in range(parts)] if c else None for c in cut]
    errors = [sum(d for d, _ in f) if f else None for f in found]
    by_label = Counter()
    for r, e in zip(good, errors, strict=True):
        by_label[r[2]] += e or 0
    return Counter((r[0], "".join(f"{i:02x}" for _, i in f) if f else None, e, by_label[r[2]], sha) for r, f, e in zip(good, found, errors, strict=True))


def told(df) -> Counter:
    return Counter(tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_tree_search_equals_search_of_all_entries():
    rng = np.random.default_rng(1)
    for high in (2, 5, 1000):  # few values: many equal distances
        for n in (1, 2, 3, 16, 60):
            entries, queries = rng.integers(-high, high, (n, 3)), rng.integers(-high, high, (500, 3))
            d = ((queries[:, None, :] - entries[None]) ** 2).sum(2)
            at, best = vc.nearest((entries, vc.kd_tree(entries)), queries)
            assert (at == d.argmin(1)).all() and (best == d.min(1)).all()


def odd_rows() -> list[tuple]:
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.integers(-3, 4, 16) / 4).tolist(), int(i) % 3 if i % 5 else None) for i in rng.permutation(60)]
    rows += [(None, rows[0][1], 1), (7, rows[1][1], 0), (7, rows[1][1], 0), (70, None, 1), (71, [1.0, None] * 8, 1), (72, [float("nan")] * 16, 1), (73, [float("inf")] * 16, 2)]
    return [*rows, (74, [1e300] * 16, 2), (75, [-1e300] * 16, None), (76, [0.5] * 5, 2), (77, [], 2), (-3, [0.1] * 16, 9)]


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(8, 16, 6), (3, 5, 2), (8, 200, 1)])
def test_odd_rows_match_brute_force(spark, parts, entries, rounds):
    df = spark.createDataFrame(odd_rows(), KIND).withColumn("code", F.lit("x")).withColumn("of", F.lit(1)).repartition(5)
    assert told(vc.report(df, parts, entries, rounds)) == brute(odd_rows(), parts, entries, rounds)


def test_small_table_matches_brute_force(spark, small_dir):
    df = spark.read.parquet(f"{small_dir}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    assert told(vc.report(df)) == brute(rows)


def test_nothing_to_code(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [float("nan")], 1)], KIND)
    assert vc.report(df).collect() == [] and vc.report(df.limit(0)).collect() == []
