"""Repeated strings against a dictionary of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prismata.llm import induced, suffix_dedup

from .fixtures import EDGES, SCHEMA, edge_docs, no_docs


def brute(rows: list[tuple], length: int) -> Counter:
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(hash(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    out = Counter()
    for r, t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[hash(t[i : i + length])] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[(r[0], len(t), int(gone.sum()), len(suffix_dedup.spans_of(gone)), hashlib.sha256(kept).hexdigest())] += 1
    return out


def told(df) -> Counter:
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_edges_match_brute_force(spark):
    assert told(suffix_dedup.report(edge_docs(spark))) == brute(EDGES, 200)


def test_documents_match_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 200)
    assert told(suffix_dedup.report(docs)) == want
    assert any(k[2] for k in want)


@pytest.mark.parametrize("parameters", [{}, {"split_contents": 2}, {"split_contents": 1, "split_windows": 3}, {"shard_bytes": 200}, {"queue_bytes": 64}])
def test_shared_passages(spark, parameters):
    """Passages inside other texts, overlaps, repeats inside one text, periodic texts; also with split anchors, small shards and queues on disk."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    passage = [" ".join(word() for _ in range(30)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for p in rng.sample(passage, rng.randint(0, 2)):
            a = rng.randint(0, 20)
            parts += [p[a : a + rng.randint(20, 120)], " ".join(word() for _ in range(rng.randint(0, 9)))]
        rows.append((i, "".join(parts), None, None))
    rows += [(100, "ab" * 200, None, None), (101, "ba" * 30, None, None), (102, rows[3][1], None, None), (103, rows[3][1], None, None), (104, "z" * 50, None, None), (105, "z" * 49, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert told(suffix_dedup.report(docs, length=50, **parameters)) == brute(rows, 50)


def test_empty_table_and_rows_kept(spark):
    assert suffix_dedup.report(no_docs(spark)).count() == 0
    docs = edge_docs(spark)
    got = suffix_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    by = {r.score: r for r in got.collect()}
    for r in docs.collect():
        assert {k: v for k, v in by[r.score].asDict().items() if k != "text"} == {k: v for k, v in r.asDict().items() if k != "text"}
    assert by["score3"].text is None and by["score7"].text == "short"
    assert len(by["score9"].text) < 300


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=60).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=8), st.integers(2, 9), st.sampled_from([1 << 20, 16]))
def test_induced_sorting_finds_repeats(pieces, length, memory):
    seen = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
    want = [[seen[p[i : i + length]] > 1 for i in range(max(0, len(p) - length + 1))] for p in pieces]
    assert [list(map(bool, x)) for x in induced.repeated(pieces, length, memory)] == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=120), st.sampled_from([1 << 20, 16]))
def test_names_are_sorted_recursively(names, memory):
    order = induced.sorted_suffixes(np.array(names, np.int32), memory)
    assert order.tolist() == sorted(range(len(names)), key=lambda i: names[i:])


def test_many_names_in_batches():
    names = np.random.default_rng(3).integers(0, 4000, 30_000).astype(np.int32)
    names[9000:15_000] = names[:6000]
    order = induced.sorted_suffixes(names, 1 << 12)
    assert order.tolist() == sorted(range(len(names)), key=lambda i: names[i : i + 7000].tolist())


def test_common_prefixes():
    t = np.frombuffer(b"abcabcabd" * 5 + b"\0" * 8, np.uint8)
    raw = t.tobytes()
    a, b = (x.reshape(-1) for x in np.meshgrid(np.arange(45), np.arange(45)))
    plain = lambda x, y: next(k for k in range(45) if k == 20 or raw[x + k : x + k + 1] != raw[y + k : y + k + 1])
    keep = (a != b) & (np.maximum(a, b) < 25)
    assert induced.common(t, a[keep], b[keep], 20).tolist() == [plain(x, y) for x, y in zip(a[keep], b[keep], strict=True)]


def test_a_shard_far_larger_than_its_memory_spills():
    rng = random.Random(5)
    passage = bytes(rng.choices(b"abcd ", k=500))
    pieces = [bytes(rng.choices(b"abcd ", k=2000)) + passage[rng.randrange(300) :] + bytes(rng.choices(b"abcd ", k=200)) for _ in range(100)]
    raw = b"\0".join(pieces) + b"\0"
    t = np.frombuffer(raw, np.uint8)
    hit, spilled = induced.repeated_suffixes(t, 60, 4096)
    assert spilled > 4 * len(t)
    seen = Counter(p[i : i + 60] for p in pieces for i in range(len(p) - 59))
    assert hit.sum() == sum(n for n in seen.values() if n > 1)
    assert all(seen[raw[i : i + 60]] > 1 for i in np.flatnonzero(hit).tolist())


@pytest.mark.parametrize("look", [1, 2, 256])
def test_batches_do_not_depend_on_how_far_is_looked(monkeypatch, look):
    """A batch of names looks at the next few tuples only, not at its whole bucket again."""
    monkeypatch.setattr(induced, "LOOK", look)
    monkeypatch.setattr(induced, "BUCKET", 50)
    rng = np.random.default_rng(look)
    for most in (2, 30, 900):
        names = np.append(rng.integers(1, most + 1, 1500), 0).astype(np.int32)
        got = induced.sorted_suffixes(names, 0)
        assert got.tolist() == sorted(range(len(names)), key=lambda i: names[i:].tolist())


def test_covered_bytes_of_a_chunk_equal_those_of_its_texts():
    rng = random.Random(3)
    size = [0, 30, 5, 0, 64, 9, 200, 0]
    off = np.concatenate([[0], np.cumsum(size)])
    found = []
    for n in size:
        blocks = [{"lo": lo, "spans": [{"a": a, "b": a + rng.randint(1, 4)} for a in (0, 5)[: rng.randint(0, 2)]]} for lo in range(0, n - 20, 11)]
        found.append(rng.choice([None, [], blocks, blocks, [*blocks, {"lo": -1, "spans": [{"a": 0, "b": 0}]}]]))
    for shift in range(3):
        lists = found[shift:] + found[:shift]
        whole = pa.array([[], *[f if n >= 10 or not f else None for f, n in zip(lists, size, strict=True)]], pa.list_(pa.struct([("lo", pa.int32()), ("spans", suffix_dedup.SPANS)])))
        lists = whole.slice(1)
        fit = [[b for b in f or [] if b["lo"] + 18 <= n] for f, n in zip(lists.to_pylist(), size, strict=True)]
        lists = pa.array([[], *fit], whole.type).slice(1)
        want = np.concatenate([suffix_dedup.covered(n, f, 10) for n, f in zip(size, fit, strict=True)])
        assert (suffix_dedup.all_covered(off, lists, 10) == want).all()
