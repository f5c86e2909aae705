"""Fingerprints and edited texts against plain Python, neighbours against all pairs."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from prismata.llm import simhash

from .fixtures import EDGES, SCHEMA, edge_docs, no_docs, words


def chained(*parts: str | None) -> int:
    """Spark's xxhash64 over strings: each value is hashed with the last hash as seed."""
    h = 42
    for p in parts:
        if p is not None:
            h = xxhash.xxh64_intdigest(p.encode(), h)
    return h


def fingerprint(text: str | None) -> str:
    w = words(text)
    votes = [0] * 128
    for a, b in zip(w, [*w[1:], None], strict=False):
        lo, hi = chained(a, b), chained(b, "simhash", a)
        for s in range(64):
            votes[s] += 1 if lo >> s & 1 else -1
            votes[64 + s] += 1 if hi >> s & 1 else -1
    return f"{sum(1 << i for i, v in enumerate(votes) if v > 0):032x}"


def alike(a: str, b: str) -> float:
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128


def brute(rows: list[tuple]) -> Counter:
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    prints = [fingerprint(r[1]) for r in order]
    out = Counter()
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        e, n = fingerprint(edited), prints[(i + 1) % len(order)]
        within = sum((int(prints[i], 16) ^ int(p, 16)).bit_count() <= 3 for p in prints) - 1 if r[0] is not None and r[0] % 100 == 0 else None
        out[(r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[i], e, alike(prints[i], e), alike(prints[i], n), within)] += 1
    return out


def told(df) -> Counter:
    return Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.n_within) for r in df.collect())


def test_edges_match_brute_force(spark):
    assert told(simhash.report(edge_docs(spark))) == brute(EDGES)


@pytest.mark.parametrize("parts", ["4", "1"])
def test_documents_match_brute_force(spark, small_dir, parts):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").where("length(text) < 4000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert told(simhash.report(docs)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_row_and_no_row(spark):
    one = [(7, "a b c d e f", None, None)]
    assert told(simhash.report(spark.createDataFrame(one, SCHEMA))) == brute(one)
    assert simhash.report(no_docs(spark)).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 3, 6])
def test_blocks_find_all_within_the_radius(spark, radius):
    import random

    rng = random.Random(radius)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = []
    for _ in range(60):
        base = rng.getrandbits(128)
        for _ in range(6):
            flips = sum(1 << b for b in rng.sample(range(128), rng.randint(0, 8)))
            prints.append(base ^ flips)
    prints += prints[:5]
    df = spark.createDataFrame([(i, signed(p & (1 << 64) - 1), signed(p >> 64)) for i, p in enumerate(prints)], "doc_id long, lo long, hi long")
    found = simhash.near(df.where(F.col("doc_id") % 10 == 0), df, radius).collect()
    got = {(r.lo, r.hi): (r.n_within, r.first_within) for r in found}
    within = {p: [i for i, o in enumerate(prints) if (p ^ o).bit_count() <= radius] for p in prints[::10]}
    want = {(signed(p & (1 << 64) - 1), signed(p >> 64)): (len(w), w[0]) for p, w in within.items()}
    assert got == want
