"""The pipeline: every stage against a plain reading of its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import __spark_entry__ as entry
from prismata.llm import common, quality_rules, secret_scan

from .fixtures import shingles
from .test_packing import check_places, ids_of, tokenizer  # noqa: F401


def test_stages_one_by_one(spark, small_dir, tokenizer):  # noqa: F811
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "n-gram jaccard join", "secret scans", "mixing to target weights", "best-fit packing"]
    docs = common.table(spark, small_dir, "documents")
    columns = docs.columns
    results = []
    for _, stage in corpus_pipeline.STAGES:
        docs = common.saved(stage(spark, docs, small_dir))
        results.append(docs)
    assert all(r.columns == columns for r in results[:-1])

    source = common.table(spark, small_dir, "documents")
    kept = {r.doc_id for r in quality_rules.score(source, common.table(spark, small_dir, "labels")).collect() if r.kept}
    first = results[0].collect()
    assert {r.doc_id for r in first} == kept

    # brute force: classes of the survivors, their smallest ids
    sets = sorted((r.doc_id, shingles(r.text)) for r in first)
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id for r in results[1].collect()} == {i for i, _ in sets if find(i) == i}

    before, after = ({r.doc_id: r.text for r in x.collect()} for x in results[1:3])
    assert before.keys() == after.keys()
    dirty = {r.doc_id for r in secret_scan.scan(results[1]).collect() if r.spans}
    assert all((before[i] != after[i]) == (i in dirty) for i in before)
    assert not [r for r in secret_scan.scan(results[2]).collect() if r.spans]

    assert Counter(map(str, results[3].collect())) == Counter(map(str, results[2].collect()))

    packed = results[4].collect()
    check_places(packed)
    assert Counter((r.doc_id, r.length) for r in packed) == Counter((i, min(4096, n - a)) for i, t in after.items() for n in [len(ids_of(tokenizer, t))] for a in range(0, n, 4096))


def test_run_and_entry(spark, small_dir):
    got = entry.queries()["pipeline"](spark, small_dir)
    assert got.count() > 0
    assert "pipeline" not in entry.oracle_sql()


def test_sequences_hold_the_ids_of_the_plan(spark, small_dir, tokenizer):  # noqa: F811
    docs = corpus_pipeline.prepared(spark, small_dir)
    plan = corpus_pipeline.packing_plan(spark, docs, small_dir).collect()
    got = {r.sequence_id: r for r in corpus_pipeline.packing.sequences(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == {r.sequence_id for r in plan}
    for p in plan:
        s = got[p.sequence_id]
        assert s.ids[p.offset : p.offset + p.length] == ids_of(tokenizer, texts[p.doc_id])[p.start : p.start + p.length]
        assert p.doc_id in s.doc_ids and len(s.ids) <= 4096
    assert sum(len(s.ids) for s in got.values()) == sum(p.length for p in plan)


def test_operator_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
