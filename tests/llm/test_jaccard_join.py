"""Near-duplicate classes against all pairs by brute force."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from prismata.llm import jaccard_join

from .fixtures import EDGES, SCHEMA, edge_docs, no_docs, shingles


def brute(rows: list[tuple]) -> Counter:
    """(doc_id, class_id, n_links, n_texts) of each row, by comparing all pairs."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    links, texts = [0] * len(rows), [set() for _ in rows]
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= 0.8 * len(a | b):
            links[i] += 1
            links[j] += 1
            if a != b:
                texts[i].add(b)
                texts[j].add(a)
            root[find(j)] = find(i)
    least: dict[int, int] = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], least.get(find(i), r[0]) if sets[i] else r[0], links[i], len(texts[i])) for i, r in enumerate(rows))


def told(df) -> Counter:
    return Counter((r.doc_id, r.class_id, r.n_links, r.n_texts) for r in df.collect())


def test_edges_match_brute_force(spark):
    assert told(jaccard_join.classes(edge_docs(spark))) == brute(EDGES)


def test_empty_table(spark):
    assert told(jaccard_join.classes(no_docs(spark))) == Counter()


def test_documents_match_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert told(jaccard_join.classes(docs)) == brute(rows)


@pytest.mark.parametrize("crowd", [64, 5])
def test_chains_and_large_group(spark, crowd):
    """A chain of gradual edits, and a group larger than a block: nothing is lost to the blocks."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = rng.choices(vocabulary, k=120)
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(120)] = f"edit{i}"
        rows.append((i, " ".join(w), None, None))
    chain = rng.choices(vocabulary, k=100)
    for i in range(12):
        chain[i * 6] = f"step{i}"
        rows.append((1000 + i, " ".join(chain), None, None))
    rows += [(5000 + i, " ".join(rng.choices(vocabulary, k=40)), None, None) for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert told(jaccard_join.classes(docs, block=16, crowd=crowd)) == brute(rows)


def test_one_per_class_keeps_the_smallest(spark):
    docs = edge_docs(spark)
    kept = jaccard_join.one_per_class(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids) == Counter([1, 3, None, 4, 5, 6, 7, 100, -200, 9])


def test_base_depth_reaches_the_recall():
    d = jaccard_join.base_depth(16, 8, 0.8, 0.999)
    met = lambda d: 1 - (1 - 0.8**d) ** 16
    assert met(d) >= 0.999 > met(d + 1)
    assert jaccard_join.base_depth(16, 8, 0.99, 0.999) > d


def test_prefixes_are_shortened_until_the_recall_is_reached():
    rng = np.random.default_rng(2)
    base, depth, trees = 4, 8, 16
    under = np.sort(rng.integers(1, 1000, (50, trees, depth - base + 1)), axis=2)[:, :, ::-1].copy()
    got = jaccard_join.shortened(under, base)
    recall = 1 - np.prod(1 - 0.8 ** got.astype(float), axis=1)
    assert (recall >= 0.999).all()
    assert (got >= base).all() and (got > base).any()
    for u, g in zip(under, got, strict=True):  # step by step, one node at a time
        at = [depth] * trees
        while 1 - np.prod([1 - 0.8**d for d in at]) < 0.999:
            _, t = min((u[t][at[t] - 1 - base], t) for t in range(trees) if at[t] > base)
            at[t] -= 1
        assert g.tolist() == at


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs between 0.80 and 0.85, beside a crowd that shares a passage with all of them."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(150):
        w = rng.choices(vocabulary, k=100)
        rows.append((2 * i, " ".join(w), None, None))
        for at in range(2):
            w[25 + 50 * at] = f"x{i}y{at}"
        rows.append((2 * i + 1, " ".join(w), None, None))
    shared = rng.choices(vocabulary, k=80)
    rows += [(1000 + i, " ".join(shared + rng.choices(vocabulary, k=40)), None, None) for i in range(120)]
    got = {r.doc_id: r.class_id for r in jaccard_join.classes(spark.createDataFrame(rows, SCHEMA), crowd=8, block=32).collect()}
    assert all(0.8 <= len(shingles(rows[2 * i][1]) & shingles(rows[2 * i + 1][1])) / len(shingles(rows[2 * i][1]) | shingles(rows[2 * i + 1][1])) < 0.85 for i in range(150))
    assert sum(got[2 * i + 1] == 2 * i for i in range(150)) >= 149
    assert all(got[1000 + i] == 1000 + i for i in range(120))


def test_links_by_matrix_equal_links_by_pair():
    rng = np.random.default_rng(3)
    base = rng.choice(1 << 40, 60, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.97], rng.choice(1 << 40, 2).astype(np.uint64)])) for _ in range(40)]
    at = np.arange(40)
    many = {(int(a), int(b)) for i, j in jaccard_join.links_within(sets, at, at) for a, b in zip(i, j)}
    want = {(i, j) for i, j in combinations(range(40), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert many == want
