"""Mixing schedules against the definition of Pfair windows."""

from __future__ import annotations

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

import pytest

from prismata.llm import mixing

from .fixtures import SCHEMA, edge_docs, no_docs


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 40), min_size=1))
def test_period_keeps_windows_and_deviation(weights):
    slots = mixing.period(weights)
    q = sum(weights.values())
    assert sorted(s for v in slots.values() for s in v) == list(range(q))
    for name, own in slots.items():
        a = weights[name]
        assert len(own) == a
        for k, s in enumerate(own):
            assert k * q // a <= s < -(-(k + 1) * q // a)
        for t in range(q + 1):
            assert abs(sum(s < t for s in own) - a * t / q) < 1


def test_given_weights_are_exact():
    sizes = {"a": 10, "b": 20, "c": 30}
    assert mixing.shares(sizes, {"a": 1, "b": 2}) == {"a": 1, "b": 2, "c": 1}
    assert mixing.shares(sizes, {"a": 0.2, "b": 0.35, "c": 0.45}) == {"a": 4, "b": 7, "c": 9}
    with pytest.raises(ValueError, match="coarser"):  # refused, not rounded
        mixing.shares(sizes, {"a": 1 / 3, "b": 0.123456789, "c": 1})
    # hundreds of thousands of slots on, no source has drifted by a block
    weights = mixing.shares(sizes, {"a": 1, "b": 2, "c": 4})
    blocks = {"a": 100_000, "b": 200_000, "c": 400_000}
    rows = {r[0]: r for r in mixing.plan(blocks, weights) if r[1] == 0}
    for name, w in weights.items():
        _, _, k0, k1, slot0, q, a, own = rows[name]
        for k in (1, 999, 77_777, k1 - 1):
            slot = slot0 + (k - k0) // a * q + own[(k - k0) % a]
            assert k * 7 // w <= slot < -(-(k + 1) * 7 // w)


def test_plan_runs_every_block_once():
    blocks, weights = {"a": 37, "b": 5, "c": 1, "d": 0}, {"a": 3, "b": 2, "c": 4, "d": 9}
    rows = mixing.plan(blocks, weights)
    done = Counter()
    slots = []
    for s, _, k0, k1, slot0, q, w, own in rows:
        assert k0 == done[s]
        slots += [slot0 + (k - k0) // w * q + own[(k - k0) % w] for k in range(k0, k1)]
        done[s] = k1
    assert done == Counter({"a": 37, "b": 5, "c": 1})
    assert sorted(slots) == list(range(43))


def test_documents_follow_their_weights(spark):
    rows = [(i, "t", "en", "big" if i % 10 else "small") for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.schedule(docs, {"big": 3, "small": 1}, block_docs=8).orderBy("position").collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    assert len({r.position for r in got}) == 3000
    first = [r for r in got if r.phase == 0]
    slots = {r.slot: r.source for r in first}
    for t in (8, 40, 100, len(slots)):
        assert abs(sum(s == "small" for k, s in slots.items() if k < t) - t / 4) <= 1
    for r in got:
        assert 0 <= r.place < 8
    again = mixing.schedule(docs, {"big": 3, "small": 1}, block_docs=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_edges(spark):
    docs = edge_docs(spark)
    got = mixing.schedule(docs).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r.doc_id, r.source) for r in docs.collect())
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))
    assert mixing.schedule(no_docs(spark)).count() == 0
    assert mixing.mixed(no_docs(spark)).count() == 0
