"""The pipeline's stages on odd rows, clashing names and empty tables."""

from __future__ import annotations

import corpus_pipeline
from prismata.llm import common

from .fixtures import CLASHES, edge_docs, no_docs


def stages(spark, docs, sf_dir):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = common.saved(stage(spark, docs, sf_dir))
        out.append(docs)
    return out


def test_odd_rows_go_through(spark, small_dir):
    docs = edge_docs(spark)
    *kept, packed = stages(spark, docs, small_dir)
    assert all(k.columns == docs.columns for k in kept)
    first = kept[0].collect()
    assert all(r.text and len(r.text.split()) >= 10 for r in first)
    assert {r.doc_id for r in kept[2].collect()} <= {r.doc_id for r in first}
    own = {r.score: r.asDict() for r in docs.collect()}
    for r in kept[3].collect():  # the other columns of a row are its own
        assert all(r[c] == own[r.score][c] for c in ["doc_id", "lang", "source", *CLASHES])
    lengths = [(r.sequence_id, r.offset, r.length) for r in packed.collect()]
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in kept[3].collect()}
    ends = {}
    for s, offset, n in sorted(lengths):
        assert offset == ends.get(s, 0)
        ends[s] = offset + n
    assert all(n <= 4096 for n in ends.values())


def test_an_empty_table(spark, small_dir):
    assert all(r.count() == 0 for r in stages(spark, no_docs(spark), small_dir))
