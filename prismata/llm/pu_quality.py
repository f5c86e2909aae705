"""Quality scores by positive-unlabelled learning.

Method.  A linear model is fitted to the non-negative unbiased risk

    prior * R_P(+1) + max(0, R_U(-1) - prior * R_P(-1)),

with the logistic loss; where the bracket is negative, the step climbs it
instead, which keeps the fit from treating trusted texts as bad.  P are trusted
positives, at most ``TRUSTED_ROWS`` rows labelled good in the learning folds
(negative labels are never read).  U is the whole corpus without labels: means,
deviations, the prior and every gradient are sums over all documents, one row
per task, so the driver holds a model and P, never documents.

The class prior is estimated from the tails of a first discriminator of P
against U: no share of U above a score can be less than prior times that of P,
so the smallest ratio of the two tails bounds the prior.

Features are shares of byte classes, words and lines of the whole text; they are
written once to the shared folder and read by each step.

Defined cases: null and empty texts have zero features and are scored like any
other; null doc_ids are never trusted and are not held out; without a trusted
row every score is 0.5; repeated rows each give a row and each count in U; other
columns are ignored.
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

TRUSTED_ROWS = 20_000
STEPS = 24
RATE = 0.4
DECAY = 3e-3
BINS = 400
THRESHOLD = 0.5


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


SHARES = {
    "upper": _class(bytes(range(65, 91))),
    "lower": _class(bytes(range(97, 123))),
    "digit": _class(b"0123456789"),
    "high": _class(bytes(range(128, 256))),
    "blank": tb.WHITE,
    "stop": _class(b".,;:?"),
    "shout": _class(b"!"),
    "bar": _class(b"|"),
    "symbol": _class(b"#*$%&<>=@^~_+/\\{}[]"),
}
NAMES = [*SHARES, "word_length", "long_words", "odd_words", "capital_words", "distinct_words", "distinct_pairs", "repeated_windows", "repeated_lines", "line_words"]
WIDTH = 2 * len(NAMES)


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Feature rows of a chunk's texts: each feature and its square root."""
    n = len(off) - 1
    bytes_ = np.maximum(1, np.diff(off))
    out = {name: tb.per_text(c[buf], off) / bytes_ for name, c in SHARES.items()}
    h, start, end, text = tb.word_hashes(buf, off)
    count = np.bincount(text, minlength=n)
    some = np.maximum(1, count)
    size = end - start
    share = lambda flags: np.bincount(text[flags], minlength=n) / some
    out["word_length"] = np.minimum(1, np.bincount(text, size, n) / some / 20)
    out["long_words"] = share(size > 20)
    odd = SHARES["symbol"] | SHARES["bar"] | SHARES["shout"]
    c = np.concatenate([[0], np.cumsum(odd[buf])])
    out["odd_words"] = share(c[end] > c[start])
    out["capital_words"] = share(SHARES["upper"][buf[start]]) if len(start) else np.zeros(n)

    def distinct(h: np.ndarray, of: np.ndarray) -> np.ndarray:
        at = tb.unique(tb.keyed(h, of))[1]
        return np.bincount(of[at], minlength=n) / np.maximum(1, np.bincount(of, minlength=n))

    out["distinct_words"] = distinct(h, text)
    pair, at = tb.windows(h, text, 2)
    out["distinct_pairs"] = distinct(pair, text[at])
    five, at = tb.windows(h, text, 5)
    out["repeated_windows"] = np.where(np.bincount(text[at], minlength=n) > 0, 1 - distinct(five, text[at]), 0)
    cuts = np.flatnonzero(buf == 10)
    a, b = np.sort(np.concatenate([off[:-1], cuts + 1])), np.sort(np.concatenate([cuts, off[1:]]))
    of = np.minimum(n - 1, np.searchsorted(off, a, "right") - 1)
    full = b > a
    a, b, of = a[full], b[full], of[full]
    lines = np.bincount(of, minlength=n)
    out["repeated_lines"] = np.where(lines > 0, 1 - distinct(tb.span_hash(buf, a, b), of), 0)
    out["line_words"] = np.minimum(1, np.log1p(count / np.maximum(1, lines)) / 8)
    x = np.stack([out[k] for k in NAMES], 1)
    return np.concatenate([x, np.sqrt(np.maximum(0, x))], 1).astype(np.float32)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight + self.bias


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(np.float64)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, off in tb.chunks(batch.column("text")):
            x = features(buf, off)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * WIDTH), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), rows], names=["doc_id", "x"])


def table(docs: DataFrame) -> DataFrame:
    """doc_id and feature row of each document, written to the shared folder."""
    common.workers_import(docs.sparkSession)
    d = common.with_columns(docs, doc_id="long", text="string")
    return common.saved(d.mapInArrow(_featured, "doc_id long, x array<float>"))


def summed(rows: DataFrame, width: int, per_batch) -> np.ndarray:
    """Sum over all rows of ``per_batch(matrix)``, a vector of ``width``; tasks send one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += per_batch(_matrix(batch))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["i", "v"])

    got = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(width)
    out[got.i.to_numpy(int)] = got.v
    return out


def _soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _part(model: Model, x: np.ndarray) -> np.ndarray:
    """Sum of the loss and gradient of softplus(z), and the number of rows."""
    s = np.clip((x - model.mean) / model.scale, -6, 6)
    z = s @ model.weight + model.bias
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return np.concatenate([[len(x), _soft(z).sum(), p.sum()], p @ s])


def descend(start: Model, unlabelled, positive: np.ndarray, steps: int, rate: float) -> Model:
    """Adam on the non-negative risk; ``unlabelled(model)`` gives ``_part`` summed over U."""
    model = start
    theta = np.append(model.weight, model.bias)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    s = np.clip((positive - model.mean) / model.scale, -6, 6)
    for step in range(1, steps + 1):
        u = unlabelled(model)
        u_risk, u_grad = u[1] / u[0], np.append(u[3:], u[2]) / u[0]
        z = s @ model.weight + model.bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        minus_risk, minus_grad = _soft(z).mean(), np.append(p @ s, p.sum()) / len(s)
        plus_grad = np.append((p - 1) @ s, (p - 1).sum()) / len(s)
        if u_risk - model.prior * minus_risk >= 0:
            grad = model.prior * plus_grad + u_grad - model.prior * minus_grad
        else:
            grad = model.prior * minus_grad - u_grad
        grad[:-1] += DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) / (1 + step / 12)
        model = Model(model.mean, model.scale, theta[:-1], float(theta[-1]), model.prior)
    return model


def estimate_prior(positive: np.ndarray, histogram: np.ndarray, edges: np.ndarray) -> float:
    """Smallest ratio of U's to P's share above a score, over scores that enough of P reach."""
    tail_u = histogram[::-1].cumsum()[::-1] / max(1, histogram.sum())
    tail_p = np.array([(positive >= e).mean() for e in edges[:-1]])
    ok = tail_p >= 0.2
    ratio = tail_u[ok] / tail_p[ok]
    return float(np.clip(ratio.min(), 0.05, 0.98))


def fit(rows: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS, steps: int = STEPS, rate: float = RATE) -> Model | None:
    good = common.labelled_sample(labels, "quality", trusted_rows, only=1).select("doc_id")
    got = rows.join(F.broadcast(good), "doc_id", "left_semi").select("x").toPandas()
    if not len(got):
        return None
    positive = np.array(got.x.tolist(), np.float64)
    sums = summed(rows, 2 * WIDTH + 1, lambda x: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]))
    mean = sums[1 : WIDTH + 1] / sums[0]
    scale = np.sqrt(np.maximum(1e-8, sums[WIDTH + 1 :] / sums[0] - mean**2))
    unlabelled = lambda model: summed(rows, WIDTH + 3, lambda x: _part(model, x))
    # a discriminator of P against U: the same risk, P weighing as much as U and U wholly negative
    start = Model(mean, scale, np.zeros(WIDTH), 0.0, 0.5)
    first = descend(start, unlabelled, positive, max(4, steps // 3), rate)
    edges = np.linspace(-12, 12, BINS + 1)
    histogram = summed(rows, BINS, lambda x: np.histogram(np.clip(first.logits(x), -11.99, 11.99), edges)[0])
    prior = estimate_prior(np.clip(first.logits(positive), -11.99, 11.99), histogram, edges)
    return descend(Model(mean, scale, np.zeros(WIDTH), 0.0, prior), unlabelled, positive, steps, rate)


def scored(rows: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = model.logits(_matrix(batch)) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(1 / (1 + np.exp(-np.clip(z, -500, 500))), 9))], names=["doc_id", "score"])

    d = rows.mapInArrow(run, "doc_id long, score double")
    return d.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    rows = table(docs)
    return scored(rows, fit(rows, labels, **options), threshold)
