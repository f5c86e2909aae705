"""Packing: ids against the tokenizer itself, places against the rules of a layout."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prismata.llm import packing
from prismata.llm import textbytes as tb

from .fixtures import EDGES, SCHEMA, edge_docs, no_docs


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_vocabulary())


def ids_of(tokenizer, text: str | None) -> list[int]:
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def pieces_of(tokenizer, rows, capacity=4096) -> Counter:
    out = Counter()
    for r in rows:
        ids = ids_of(tokenizer, r[1])
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], "<u4")
            out[(r[0], k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    return out


def check_places(rows, capacity=4096):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def told(rows) -> Counter:
    return Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)


def test_edges(spark, tokenizer):
    got = packing.packed(edge_docs(spark)).collect()
    assert told(got) == pieces_of(tokenizer, EDGES)
    check_places(got)
    assert packing.packed(no_docs(spark)).count() == 0


def test_documents(spark, small_dir, tokenizer):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = packing.packed(docs).collect()
    assert told(got) == pieces_of(tokenizer, rows)
    n = check_places(got)
    total = sum(r.length for r in got)
    assert n <= -(-total // 4096) + 1


TRICKY = ["don't can't we'll", "<|startoftext|> x <|endoftext|>", "a.b,c!d?e", "x1y2 3z", "ÀÉ ǅ İi ŉ", "日本語テキスト", "a b c", "\x00\x01 a\x7f", "é café", "🗼🗼x", "'s 's' ''", "A" * 300, "__init__ a_b", "<b>|</b>", "9" * 50, "İSTANBUL ẞ ﬁ", "|<|<|"]


def test_word_cache_equals_the_tokenizer(tokenizer):
    import pyarrow as pa

    words = packing.WordIds(packing.default_vocabulary(), most=3)
    for _ in range(2):
        for group in (TRICKY, TRICKY[::-1], *[[t] for t in TRICKY]):
            for a, b, buf, off in tb.chunks(pa.array(group)):
                ids, at = words.ids(buf, off, 1)
                assert [ids[x:y].tolist() for x, y in zip(at, at[1:], strict=False)] == [ids_of(tokenizer, t) for t in group[a:b]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=4))
def test_any_text_is_tokenised_alike(texts):
    import pyarrow as pa

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    tokenizer, words = _once()
    for _, _, buf, off in tb.chunks(pa.array(texts)):
        ids, at = words.ids(buf, off, 1)
        assert [ids[x:y].tolist() for x, y in zip(at, at[1:], strict=False)] == [ids_of(tokenizer, t) for t in texts]


def _once(keep=[]):  # noqa: B006
    if not keep:
        keep += [Tokenizer.from_file(packing.default_vocabulary()), packing.WordIds(packing.default_vocabulary())]
    return keep


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80), st.integers(40, 60))
def test_every_piece_has_its_place(lengths, capacity):
    counts = np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(capacity + 1, np.int64)
    patterns = packing.best_two_fit(counts, capacity)
    used = Counter()
    for times, bin_ in patterns:
        assert sum(bin_) <= capacity
        for n in bin_:
            used[n] += times
    assert used == Counter(lengths)
    bins, total = sum(t for t, _ in patterns), sum(lengths)
    assert bins <= 2 * -(-total // capacity) + 1


def test_two_pieces_replace_the_smallest():
    """Greedy leaves 100 = 60 + 35 + gap 5; two that fill 40 replace 35."""
    counts = np.bincount([60, 35, 22, 18], minlength=101)
    patterns = packing.best_two_fit(counts, 100)
    assert (1, [60, 22, 18]) in patterns


def test_capacity_is_a_parameter(spark, tokenizer):
    rows = [(i, "one two three four five six seven", None, None) for i in range(20)]
    got = packing.packed(spark.createDataFrame(rows, SCHEMA), capacity=16).collect()
    assert told(got) == pieces_of(tokenizer, rows, 16)
    assert check_places(got, 16) == 10
