"""Texts made so that a polynomial hash modulo 2**64 takes them for each other."""

from __future__ import annotations

import zlib

import numpy as np

from prismata.llm import anchors, jaccard_join, packing, pu_quality, quality_rules, suffix_dedup
from prismata.llm import textbytes as tb

from .test_suffix_dedup import brute, told


def twins(x: str = "a", y: str = "b", doublings: int = 10) -> tuple[str, str]:
    """A Thue-Morse word of 2**doublings letters, and the one with the letters exchanged."""
    a, b = x, y
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


A, B = twins()


def chunk(*texts: str) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def docs(spark, *texts: str):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_the_twins_collide_under_the_rolling_hash_only():
    buf, off = chunk(A, B)
    p = tb.rolling(buf)
    assert len(set(tb.rolled(p, off[:-1], off[1:]).tolist())) == 1
    assert len(set(tb.span_hash(buf, off[:-1], off[1:]).tolist())) == 2


def test_anchors_of_equal_windows_are_equal():
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 123, 500, dtype=np.uint8)
    noise = [rng.integers(97, 123, 300, dtype=np.uint8) for _ in range(3)]
    buf = np.concatenate([noise[0], passage, noise[1], passage, noise[2]])
    off = np.array([0, 800, len(buf)])
    got = anchors.blocks(buf, off, 200)
    of = {}
    for lo, n, text, anchor, reach in zip(*(got[k].tolist() for k in ("lo", "n", "text", "anchor", "reach")), strict=True):
        for i in range(n):
            of[off[text] + lo + i] = (anchor, lo + reach - lo - i)
    assert len(of) == 601 + len(buf) - 800 - 199
    for i in range(301):
        assert of[300 + i] == of[1100 + i]
    key = rng.integers(0, 50, 1000).astype(np.uint64)
    for width in (1, 2, 3, 7, 8, 177, 1000):
        assert (anchors.sliding_least(key, width) == [key[i : i + width].min() for i in range(1001 - width)]).all()


def test_equal_spans_have_equal_hashes_at_every_length():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 9, 16, 31, 32, 33, 127, 128, 129, 1000):
        word = rng.integers(0, 256, n, dtype=np.uint8)
        buf = np.concatenate([word, rng.integers(0, 256, 5, dtype=np.uint8), word, word[::-1]])
        at = np.array([0, n + 5, 2 * n + 5])
        h = tb.span_hash(buf, at, at + n)
        assert h[0] == h[1] and (n < 2 or h[0] != h[2])
        key = tb.Key(b"told")
        assert (tb.span_hash(buf, at, at + n, key) == tb.span_hash(buf, at, at + n, tb.Key(b"told"))).all()


def test_join(spark):
    got = jaccard_join.classes(docs(spark, f"one two three four {A}", f"one two three four {B}", f"one two three four {A}")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(0, 0, 1), (1, 1, 0), (2, 0, 1)]


def test_base_rules_and_features():
    buf, off = chunk(f"{A}\n{B}", f"{A}\n{A}")
    assert quality_rules.base_counts(buf, off)["n_dup_lines"].tolist() == [0, 1]
    at = pu_quality.NAMES.index("repeated_lines")
    assert pu_quality.features(buf, off)[:, at].tolist() == [0.0, 0.5]
    assert pu_quality.features(buf, off)[:, pu_quality.NAMES.index("distinct_words")].tolist() == [1.0, 0.5]


def test_suffix_dedup(spark):
    rng = np.random.default_rng(1)
    head = "".join(chr(c) for c in rng.integers(97, 123, 600))
    texts = [head + A, head + B]
    assert told(suffix_dedup.report(docs(spark, *texts))) == brute(list(enumerate(texts)), 200)


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [f"{A} {B}", A, B, f"{B}, {A}"]
    t = Tokenizer.from_file(packing.default_vocabulary())
    got = packing.pieces(docs(spark, *texts)).orderBy("doc_id").collect()
    want = [zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, packing.END_ID], "<u4").tobytes()) for x in texts]
    assert [r.ids_crc32 for r in got] == want


def test_keys_differ_between_runs():
    buf, off = chunk("a word")
    assert tb.span_hash(buf, off[:-1], off[1:], tb.Key())[0] != tb.span_hash(buf, off[:-1], off[1:], tb.Key())[0]
