"""Toxicity and PU quality: held-out accuracy, folds, defined cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from prismata.llm import pu_quality, toxicity

from .fixtures import EDGES, edge_docs, labels, no_docs

DATA = "/root/testdata/sf0.01"


def auc(y: np.ndarray, s: np.ndarray) -> float:
    a, b = s[y == 1][:, None], s[y == 0][None, :]
    return float(((a > b) + 0.5 * (a == b)).mean())


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.mark.parametrize(("operator", "label", "least_auc", "least_accuracy"), [(toxicity, "toxic", 0.9, 0.9), (pu_quality, "quality", 0.97, 0.9)])
def test_held_out_accuracy(tables, operator, label, least_auc, least_accuracy):
    docs, marks = tables
    got = operator.score(docs, marks).toPandas()
    assert len(got) == docs.count()
    assert got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= operator.THRESHOLD)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out].merge(marks.toPandas(), on="doc_id")
    y = held[label].to_numpy()
    assert auc(y, held.score.to_numpy()) >= least_auc
    assert (held.predicted == y).mean() >= least_accuracy


@pytest.mark.parametrize("operator", [toxicity, pu_quality])
def test_held_out_labels_say_nothing(tables, operator):
    """Turning every held-out label round changes no score."""
    docs, marks = tables
    docs = docs.where("doc_id % 4 = 0")
    rows = [(r.doc_id, r.quality, r.toxic) for r in marks.collect()]
    turned = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, q, t) for i, q, t in rows]
    spark = docs.sparkSession
    a, b = (sorted((r.doc_id, round(r.score, 6)) for r in operator.score(docs, labels(spark, x), steps=12).collect()) for x in (rows, turned))
    assert a == b


@pytest.mark.parametrize("operator", [toxicity, pu_quality])
def test_edges(spark, operator):
    some = labels(spark, [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 1, 1), (4, 0, 1), (7, 1, 0), (8, 0, 1), (9, None, None), (None, 1, 1)])
    for marks in (some, labels(spark)):
        got = operator.score(edge_docs(spark), marks, steps=5).collect()
        assert len(got) == len(EDGES)
        assert all(0 <= r.score <= 1 for r in got)
        assert [r.held_out for r in got if r.doc_id is None] == [False]
        twins = {r.score for r in got if r.doc_id in (1, 2)}
        assert len(twins) == 1
    assert operator.score(no_docs(spark), some, steps=3).count() == 0


def test_no_labels(spark):
    assert {r.score for r in toxicity.score(edge_docs(spark), labels(spark)).collect()} == {0.0}
    assert {r.score for r in pu_quality.score(edge_docs(spark), labels(spark)).collect()} == {0.5}


def test_unseen_misspellings_are_near_their_word():
    rng = np.random.default_rng(1)
    filler = [f"word{i}".encode() for i in range(300)]
    docs = []
    for i in range(300):
        ws = list(rng.choice(filler, 25, replace=False))
        docs.append((int(i % 3 == 0), sorted({*ws, *([b"grobnik"] if i % 3 == 0 else [])})))
    model = toxicity.train(docs)

    def score(text: bytes) -> float:
        low, start, end, _ = toxicity.spaced(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        return float(1 / (1 + np.exp(-(toxicity.word_logits(low, start, end, model.weight).max() + model.bias))))

    assert score(b"word1 grobnik word2") > 0.9
    assert score(b"word1 Gr0bnik word2") > 0.7
    assert score(b"word1 grobnnik word2") > 0.7
    assert score(b"word1 word2 word3") < 0.3


def test_prior_is_the_smallest_ratio_of_tails():
    rng = np.random.default_rng(2)
    edges = np.linspace(-12, 12, 401)
    positive = rng.normal(3, 1, 4000)
    unlabelled = np.concatenate([rng.normal(3, 1, 6000), rng.normal(-3, 1, 4000)])
    prior = pu_quality.estimate_prior(positive, np.histogram(unlabelled, edges)[0], edges)
    assert abs(prior - 0.6) < 0.06


def test_risk_does_not_go_negative():
    """With more parameters than positives, the bracket of the risk stays near or above zero."""
    rng = np.random.default_rng(3)
    width = pu_quality.WIDTH
    positive, u = rng.normal(0.3, 1, (8, width)), rng.normal(0, 1, (400, width))
    start = pu_quality.Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.4)
    model = pu_quality.descend(start, lambda m: pu_quality._part(m, u), positive, 60, 0.4)
    bracket = np.logaddexp(0, model.logits(u)).mean() - 0.4 * np.logaddexp(0, model.logits(positive)).mean()
    assert bracket > -0.3
