"""Base counts and the likelihood ratio against plain loops."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from prismata.llm import quality_rules as q

from .fixtures import EDGES, edge_docs, labels, no_docs, words


def base(text: str | None) -> tuple[int, int, int, int, int]:
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def bucket(gram: bytes) -> int:
    x = 0
    for b in gram:
        x = (x * 0x01000193 + b) & 0xFFFFFFFF
    x = ((x ^ (x >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
    return x >> 16


def grams(text: str | None) -> list[int]:
    raw = (text or "").encode()
    return [bucket(raw[i : i + q.GRAM]) for i in range(len(raw) - q.GRAM + 1)]


def check(got, rows, trusted: set[int]):
    raw, good = Counter(), Counter()
    for i, t, *_ in rows:
        g = grams(t)
        raw.update(g)
        if i in trusted:
            good.update(g)
    n_raw, n_good = sum(raw.values()), sum(good.values())
    want = Counter()
    for i, t, *_ in rows:
        b = base(t)
        g = grams(t)
        llr = sum(math.log((good[x] + 1) / (n_good + q.BUCKETS)) - math.log((raw[x] + 1) / (n_raw + q.BUCKETS)) for x in g) / max(1, len(g)) if n_good else 0
        failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
        want[(i, *b, round(llr, 5), failed, not failed and llr >= q.MIN_SCORE)] += 1
    have = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, round(r.llr, 5), r.base_failed, r.kept) for r in got)
    assert have == want


def test_edges_match_brute_force(spark):
    learnt = [i for i in (1, 7, 100) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert learnt
    marks = labels(spark, [(i, 1, 0) for i in (1, 7, 100, 2)] + [(9, 0, 0), (None, 1, 0), (8, None, None)])
    trusted = {i for i in (1, 7, 100, 2) if zlib.crc32(str(i).encode()) % 3 != 1}
    check(q.score(edge_docs(spark), marks).collect(), EDGES, trusted)


def test_documents_match_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").where("length(text) < 3000")
    marks = spark.read.parquet(f"{small_dir}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = {r.doc_id for r in marks.where("quality = 1").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    check(q.score(docs, marks).collect(), rows, good)


def test_without_trusted_rows_the_ratio_is_zero(spark):
    got = q.score(edge_docs(spark), labels(spark)).collect()
    assert len(got) == len(EDGES) and all(r.llr == 0 for r in got)
    assert q.score(no_docs(spark), labels(spark)).count() == 0


def test_accept_keeps_the_kept_rows_whole(spark):
    docs = edge_docs(spark)
    kept = {r.doc_id for r in q.score(docs, labels(spark)).collect() if r.kept}
    got = q.accept(docs, labels(spark))
    assert got.columns == docs.columns
    want = [str(r) for r in docs.collect() if r.doc_id in kept]
    assert sorted(map(str, got.collect())) == sorted(want)


def test_clean_labelled_documents_stay(spark):
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    marks = table("labels")
    got = q.score(table("documents"), marks).join(marks, "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good[~good.base_failed].kept.mean() > 0.98
    assert bad.kept.mean() < 0.1


@pytest.mark.parametrize("text", ["a\n\na\n", "\n", "x", "a b c d e a b c d e a b c d e", "Ünï #*$%&|<> x"])
def test_counts_of_one_text(text):
    import pyarrow as pa

    from prismata.llm import textbytes as tb

    (_, _, buf, off), = tb.chunks(pa.array([text]))
    got = q.base_counts(buf, off)
    assert tuple(int(np.asarray(got[c])[0]) for c in q.COUNTS) == base(text)
