"""Quality rules: base counts per text and a hashed n-gram likelihood ratio.

Method.  Every text is read as overlapping byte n-grams hashed into a fixed
number of buckets.  Two multinomials are counted over those buckets: one over
the whole raw corpus, one over trusted documents (a bounded sample of rows
labelled good in the learning folds).  A text's score is the mean over its
n-grams of ``log p_trusted - log p_raw``, so it does not grow with the length;
a document is kept when the score reaches ``min_score`` and no base rule fails.
The threshold is applied to every document alike and nothing is sampled but the
trusted rows, whose number ``TRUSTED_ROWS`` bounds.

Two scans, one shuffle of ``BUCKETS`` sums per task between them.  Only the
table of log ratios (``BUCKETS`` doubles) reaches the driver and is broadcast.

Defined cases: a null text counts as empty; an empty text has score 0 and fails
the base rule on words; a null doc_id is scored like any other; repeated rows
each give a row and each count in the corpus; without trusted rows the ratio is
0 everywhere; extra columns are ignored by ``score`` and kept by ``accept``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from . import textbytes as tb

GRAM = 4
BUCKETS = 1 << 16
TRUSTED_ROWS = 20_000
MIN_SCORE = -0.5
SMOOTHING = 1.0
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def gram_buckets(buf: np.ndarray, off: np.ndarray, n: int = GRAM, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte, and whether it lies inside one text."""
    size = len(buf) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    x = np.zeros(size, np.uint32)
    for j in range(n):
        x = x * np.uint32(0x01000193) + buf[j : j + size]
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    whole = np.ones(size, bool)
    for j in range(1, n):  # n-grams that begin less than n bytes before a text's end
        at = off[1:] - j
        whole[at[(at >= 0) & (at < size)]] = False
    return (x >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int64), whole


def base_counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rules for each text of a chunk."""
    h, start, end, text = tb.word_hashes(buf, off)
    n = len(off) - 1
    ink = ~tb.WHITE[buf]
    out = {
        "n_words": np.bincount(text, minlength=n),
        "word_chars": tb.per_text(ink & ((buf & 0xC0) != 0x80), off),
        "n_symbols": tb.per_text(SYMBOL[buf], off),
    }
    cuts = np.flatnonzero(buf == 10)
    a = np.concatenate([off[:-1], cuts + 1])
    b = np.concatenate([cuts, off[1:]])
    a.sort()
    b.sort()
    inked = np.concatenate([[0], np.cumsum(ink)])
    of = np.searchsorted(off, a, "right") - 1  # an empty text's line lands on a later text, and has no word
    full = inked[b] > inked[a]
    a, b, of = a[full], b[full], of[full]
    seen = tb.unique(tb.keyed(tb.span_hash(buf, a, b), of))[1]
    out["n_dup_lines"] = np.bincount(of, minlength=n) - np.bincount(of[seen], minlength=n)
    win, at = tb.windows(h, text, WINDOW)
    _, _, inverse = tb.unique(tb.keyed(win, text[at]))
    twice = at[np.bincount(inverse)[inverse] > 1] if len(at) else at
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(text[np.cumsum(cover)[:-1] > 0], minlength=n)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
        for a, b, buf, off in tb.chunks(batch.column("text")):
            x, whole = gram_buckets(buf, off)
            raw += np.bincount(x[whole], minlength=BUCKETS)
            if good[a:b].any():
                at = np.repeat(good[a:b], np.diff(off))[: len(x)]
                trusted += np.bincount(x[whole & at], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(trusted[at])], names=["bucket", "raw", "trusted"])


def fit(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of each bucket: trusted multinomial against the raw corpus."""
    d = common.with_columns(docs, doc_id="long", text="string")
    good = common.labelled_sample(labels, "quality", trusted_rows, only=1).select("doc_id", F.lit(True).alias("trusted"))
    d = d.join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    sums = d.mapInArrow(_count, "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    got = sums.toPandas()  # at most BUCKETS rows
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[got.bucket.to_numpy(int)], trusted[got.bucket.to_numpy(int)] = got.raw, got.trusted
    if not trusted.sum():
        return np.zeros(BUCKETS)
    share = lambda c: np.log((c + smoothing) / (c.sum() + smoothing * BUCKETS))
    return share(trusted) - share(raw)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judged(docs: DataFrame, ratio: np.ndarray, min_score: float = MIN_SCORE) -> DataFrame:
    """All columns of ``docs``, one of which is ``text``, plus the counts, score and verdict."""
    spark = docs.sparkSession
    common.workers_import(spark)
    shared = spark.sparkContext.broadcast(ratio)
    own = [*COUNTS, "llr", "base_failed", "kept"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            parts: dict[str, list[np.ndarray]] = {c: [] for c in own}
            for _, _, buf, off in tb.chunks(batch.column(batch.schema.get_field_index("text"))):
                got = base_counts(buf, off)
                x, whole = gram_buckets(buf, off)
                pad = np.zeros(len(buf))
                pad[: len(x)] = np.where(whole, table[x], 0.0)
                grams = np.maximum(1, np.diff(off) - GRAM + 1)
                got["llr"] = np.round(tb.per_text(pad, off) / grams, 9)
                got["base_failed"] = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > REPEAT_PERCENT * got["n_words"])
                got["kept"] = ~got["base_failed"] & (got["llr"] >= min_score)
                for c in own:
                    parts[c].append(got[c])
            kinds = [*[pa.int64()] * 5, pa.float64(), pa.bool_(), pa.bool_()]
            extra = [pa.array(np.concatenate(parts[c]) if parts[c] else [], k) for c, k in zip(own, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *own])

    added = T.StructType([*[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("llr", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, *added.fields]))


def score(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, the counts, ``llr``, ``base_failed`` and ``kept`` of each row."""
    d = common.with_columns(docs, doc_id="long", text="string")
    return judged(d, fit(docs, labels), min_score).drop("text")


def accept(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    return common.unboxed(judged(common.boxed(docs, text="string"), fit(docs, labels), min_score).where("kept"), docs.columns)
