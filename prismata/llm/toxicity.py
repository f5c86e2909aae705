"""Toxicity scores from subword-bag embeddings and a linear softmax.

Method.  A word is the bag of its byte n-grams, markers for its ends included,
hashed into ``BUCKETS`` rows of an embedding table E, and its vector is the mean
of those rows.  A document's vector is the weighted average of its words'
vectors; it goes through a two-class linear softmax.  Weights are a softmax over
the words' own logits whose sharpness grows during training: at first all words
weigh alike, at the end the words that make a document toxic weigh most, as a few
of them in 20,000 others must decide.  Scoring takes the limit, the most toxic
word.  E and the softmax are trained together in numpy by full-batch Adagrad.  An
unseen misspelling shares n-grams, hence vectors, with the words that were seen.

Every ``REFRESH`` steps words whose weight has vanished are set aside and only
the rows of E that the others use are updated, so a step's cost falls with the
sharpness.

Labels come from at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled rows of the
learning folds, in hash order; of each sampled text the executors return its
distinct words.
For two classes E and the softmax reduce to one number per bucket, which is what
is broadcast for scoring: all texts, whole, in one scan without a shuffle.

Defined cases: null and empty texts have no word and score by the bias alone;
null doc_ids are never learnt from and are not held out; contradicting labels of
a doc_id count as toxic; without labels of both classes every score is 0;
repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb

BUCKETS = 1 << 17
DIM = 16
GRAMS = (3, 4, 5)
TOXIC_ROWS = 1000
CLEAN_ROWS = 2000
STEPS = 90
REFRESH = 6
#: Sharpness at the end; it is reached after ``RAMP`` of the steps.
SHARP = 6.0
RAMP = 0.4
THRESHOLD = 0.7

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[tb.WHITE] = 32


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # per bucket: its vector times the difference of the softmax's rows
    bias: float


def spaced(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with a blank around every text, and (start, end, text) of its words."""
    n = len(off) - 1
    out = np.full(len(buf) + n + 1, 32, np.uint8)
    out[np.arange(len(buf)) + 1 + np.repeat(np.arange(n), np.diff(off))] = _FOLD[buf]
    start, end, _ = tb.words(out, np.array([0, len(out)]))
    return out, start, end, np.searchsorted(off[:-1] + np.arange(n) + 1, start, "right") - 1


def buckets_at(buf: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each byte."""
    size = max(0, len(buf) - n + 1)
    x = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for j in range(n):
        x = (x ^ buf[j : j + size]) * np.uint32(0x01000193)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return x >> np.uint32(32 - (BUCKETS.bit_length() - 1))


def word_logits(buf: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mean weight of each word's n-grams."""
    total, count = np.zeros(len(start)), np.zeros(len(start), np.int64)
    for n in GRAMS:
        c = np.zeros(len(buf) + 2)
        got = weight[buckets_at(buf, n)]
        np.cumsum(got, out=c[1 : len(got) + 1])
        c[len(got) + 1 :] = c[len(got)]
        a, b = start - 1, np.maximum(start - 1, end + 2 - n)
        total += c[b] - c[a]
        count += b - a
    return total / np.maximum(1, count)


def bags(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams on end, and the offsets of each word."""
    buf = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    size = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(size + 1) - size - 1  # of the blank before each word
    grams = np.stack([np.maximum(0, size + 3 - n) for n in GRAMS], 1)
    off = np.concatenate([[0], np.cumsum(grams.sum(1))])
    ids = np.empty(off[-1], np.int32)
    into = off[:-1].copy()
    for i, n in enumerate(GRAMS):
        k = grams[:, i]
        inside = np.arange(k.sum(), dtype=np.int32) - np.repeat((np.cumsum(k) - k).astype(np.int32), k)
        ids[np.repeat(into.astype(np.int32), k) + inside] = buckets_at(buf, n)[np.repeat(first.astype(np.int32), k) + inside]
        into += k
    return ids, off


def _ranges(off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the given rows' entries, and the new offsets."""
    size = off[rows + 1] - off[rows]
    new = np.concatenate([[0], np.cumsum(size)])
    return np.repeat((off[rows] - new[:-1]).astype(np.int32), size) + np.arange(new[-1], dtype=np.int32), new


def train(docs: list[tuple[int, list[bytes]]], steps: int = STEPS, dim: int = DIM, rate: float = 0.5, seed: int = 7, refresh: int = REFRESH) -> Model:
    """Fit on (label, distinct words) documents."""
    docs = [(y, ws) for y, ws in docs if ws]
    y = np.array([v for v, _ in docs], np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), -1e9)
    vocab: dict[bytes, int] = {}
    member = np.fromiter((vocab.setdefault(w, len(vocab)) for _, ws in docs for w in ws), np.int32)
    owner = np.repeat(np.arange(len(docs), dtype=np.int32), [len(ws) for _, ws in docs])
    del docs
    ids, off = bags(list(vocab))
    del vocab
    size = np.maximum(1, np.diff(off)).astype(np.float32)
    balance = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    table -= table.mean(1, keepdims=True)
    rows = np.full((2, dim), 0.5, np.float32)  # the softmax; row 1 is toxic
    rows[0] = -0.5
    bias, g_table, g_rows, g_bias = 0.0, np.full((BUCKETS, 1), 1e-6, np.float32), np.full_like(rows, 1e-6), 1e-6
    sharpness = lambda step: min(1.0, step / (RAMP * steps)) ** 2 * SHARP
    for begin in range(0, steps, refresh):
        # the words that still weigh something, and the rows of E they use
        z = np.add.reduceat((table @ (rows[1] - rows[0]))[ids], off[:-1])[member] / size[member]
        top = np.maximum.reduceat(z, np.flatnonzero(np.diff(owner, prepend=-1)))
        alive = np.flatnonzero(sharpness(begin) * (top[owner] - z) < 8)
        words = np.flatnonzero(np.bincount(member[alive], minlength=len(size)))
        at = np.searchsorted(words, member[alive]).astype(np.int32)
        held = owner[alive]
        first = np.flatnonzero(np.diff(held, prepend=-1))
        place, start = _ranges(off, words)
        used = np.flatnonzero(np.bincount(ids[place], minlength=BUCKETS))
        number = np.zeros(BUCKETS, np.int32)
        number[used] = np.arange(len(used))
        local = number[ids[place]]
        del place
        e, g = table[used], g_table[used]
        per, word_of = size[words], np.repeat(np.arange(len(words), dtype=np.int32), np.diff(start))
        for step in range(begin, min(begin + refresh, steps)):
            v = rows[1] - rows[0]
            z = (np.add.reduceat((e @ v)[local], start[:-1]) / per)[at]
            share = np.exp(sharpness(step) * (z - np.maximum.reduceat(z, first)[held]))
            share /= np.add.reduceat(share, first)[held]
            pooled = np.add.reduceat(share * z, first) + bias
            slope = (1 / (1 + np.exp(-np.clip(pooled, -30, 30))) - y) * balance
            per_word = np.bincount(at, share * slope[held], len(words)) / per
            c = np.bincount(local, per_word[word_of], len(used)).astype(np.float32)
            d_rows = c @ e
            g += (c**2 * (v**2).mean())[:, None]
            e -= rate * c[:, None] * v[None, :] / np.sqrt(g)
            for k, sign in ((1, 1), (0, -1)):
                g_rows[k] += (sign * d_rows) ** 2
                rows[k] -= 0.1 * sign * d_rows / np.sqrt(g_rows[k])
            g_bias += float(slope.sum()) ** 2
            bias -= 0.5 * float(slope.sum()) / g_bias**0.5
        table[used], g_table[used] = e, g
    seen = np.zeros(BUCKETS, bool)
    seen[ids] = True
    return Model(np.where(seen, table @ (rows[1] - rows[0]), 0.0), bias)  # an n-gram never seen says nothing


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, off in tb.chunks(batch.column("text")):
            low, start, end, text = spaced(buf, off)
            raw, sets = low.tobytes(), [set() for _ in range(b - a)]
            for i, j, t in zip(start.tolist(), end.tolist(), text.tolist(), strict=True):
                sets[t].add(raw[i:j])
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.array([b" ".join(sorted(s)) for s in sets], pa.binary())], names=["label", "words"])


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, **options) -> Model:
    t = common.with_columns(labels, doc_id="long", toxic="int").withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    chosen = common.labelled_sample(t, "toxic", toxic_rows, 1).unionByName(common.labelled_sample(t, "toxic", clean_rows, 0))
    d = common.with_columns(docs, doc_id="long", text="string").where(F.col("doc_id").isNotNull())
    got = d.join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(_distinct_words, "label int, words binary").collect()
    rows = sorted((r["label"], bytes(r["words"])) for r in got)
    del got
    return train([(y, w.split()) for y, w in rows], **options)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    spark = docs.sparkSession
    common.workers_import(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, buf, off in tb.chunks(batch.column("text")):
                low, start, end, text = spaced(buf, off)
                z = np.zeros(b - a)
                if len(start):
                    head = np.flatnonzero(np.diff(text, prepend=-1))
                    z[text[head]] = np.maximum.reduceat(word_logits(low, start, end, m.weight), head)  # the most toxic word
                p = 1 / (1 + np.exp(-np.clip(z + m.bias, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.round(p, 9))], names=["doc_id", "score"])

    d = common.with_columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")
    return d.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    common.workers_import(docs.sparkSession)
    return scored(docs, fit(docs, labels, **options), threshold)
