"""The mixing schedule shows in the packed sequences."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from prismata.llm import common, mixing, packing

from .fixtures import SCHEMA, edge_docs, no_docs
from .test_packing import check_places, pieces_of, told, tokenizer  # noqa: F401

STRETCH = 64


def hot(spark):
    """Nine of ten rows of one source; texts of many lengths."""
    return spark.createDataFrame([(i, " ".join(["word"] * (1 + i * 37 % 900)), "en", "small" if i % 10 == 0 else "big") for i in range(1500)], SCHEMA)


def places(rows) -> list:
    return sorted((r.doc_id, r.piece, r.sequence_id, r.offset) for r in rows)


def packed(docs):
    return packing.packed_in_order(docs, stretch_docs=STRETCH).collect()


def test_stretches_hold_the_schedule(spark):
    docs = hot(spark)
    weights = {"big": 1, "small": 1}
    rows = packed(common.saved(mixing.mixed(docs, weights)))
    check_places(rows)
    last = max(r.sequence_id for r in rows)
    assert {r.sequence_id for r in rows} == set(range(last + 1))
    position = {r.doc_id: r.position for r in mixing.schedule(docs, weights).collect()}
    turn = {d: n for n, d in enumerate(sorted(position, key=position.get))}
    of: dict[int, set[int]] = {}
    for r in rows:
        of.setdefault(r.sequence_id, set()).add(turn[r.doc_id] // STRETCH)
    stretches = [of[s] for s in range(last + 1)]
    assert all(len(s) == 1 for s in stretches)
    assert [min(s) for s in stretches] == sorted(min(s) for s in stretches)
    # while both sources last, each has its half of every stretch
    source = {r.doc_id: r.source for r in docs.collect()}
    for k in range(256 // STRETCH):
        got = Counter(source[d] for d in turn if turn[d] // STRETCH == k)
        assert abs(got["small"] - STRETCH / 2) <= mixing.BLOCK_DOCS


def test_leaving_out_or_reweighting_the_stage_changes_the_sequences(spark):
    docs = common.saved(hot(spark))
    plain = places(packed(docs))
    even = places(packed(common.saved(mixing.mixed(docs, {"big": 1, "small": 1}))))
    skew = places(packed(common.saved(mixing.mixed(docs, {"big": 5, "small": 1}))))
    assert plain != even and even != skew and plain != skew
    assert [p[:2] for p in plain] == [p[:2] for p in even] == [p[:2] for p in skew]


def test_the_pipeline_packs_in_the_stored_order(spark):
    docs = common.saved(hot(spark))
    mixed = common.saved(corpus_pipeline.mixture(spark, docs, ""))
    assert places(corpus_pipeline.packing_plan(spark, mixed, "").collect()) != places(corpus_pipeline.packing_plan(spark, docs, "").collect())


def test_splits_of_the_files_do_not_matter(spark):
    mixed = common.saved(mixing.mixed(hot(spark)))
    whole = places(packed(mixed))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert places(packed(mixed)) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_edges(spark, tokenizer):  # noqa: F811
    docs = common.saved(edge_docs(spark))
    got = packing.packed_in_order(docs, stretch_docs=3).collect()
    assert told(got) == pieces_of(tokenizer, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    check_places(got)
    assert packing.packed_in_order(common.saved(no_docs(spark))).count() == 0
