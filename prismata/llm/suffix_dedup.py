"""Removal of repeated 200-byte strings: sharded external induced suffix sorting.

Method.  Equal strings ("windows") have equal anchors (``anchors``), so a text
is cut into blocks of windows with one anchor and the corpus into shards by
anchor: no repeat spans two shards.  A block's content is named by a 128-bit
cryptographic digest of its bytes.  Three cases are settled by partially
aggregated groups:

* an anchor that stands in one place of one text: nothing there repeats;
* a content that stands in two places: all its windows repeat;
* an anchor with several contents: one copy of each content goes to the anchor's
  shard, where external induced sorting (``induced``) orders all suffixes with
  their common prefixes; windows whose prefix reaches ``length`` repeat.

A shard's contents are sorted in pieces of about ``SHARD_BYTES`` that keep an
anchor whole; its queues spill to disk beyond ``QUEUE_BYTES``.  The contents of
an anchor with more than ``SPLIT_CONTENTS`` of them (an edge of a passage that a
large part of the corpus shares) are dealt into finer shards first: blocks of
``SPLIT_WINDOWS`` windows at equal distances from the anchor, keyed by the bytes
that all windows of such a block have.  They meet by content once more, and the
rest goes through the same sort.  Equal texts are one text until the end, where
all windows of a text with a copy repeat.

Rows are numbered once, in a stored table.  Positions come back as spans per
content, meet the texts by row number, and a byte is removed when a repeated
window covers it.

Defined cases: null and empty texts, and texts shorter than ``length``, lose
nothing; null and repeated doc_ids keep their rows; repeated rows are copies;
other columns are ignored by ``report`` and kept by ``deduplicated``, whose texts
may become empty.  A character whose bytes are only partly removed leaves bytes
that are not UTF-8; ``deduplicated`` replaces them.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import anchors, common, induced
from . import textbytes as tb

LENGTH = 200
SHARD_BYTES = 3 << 20
QUEUE_BYTES = induced.QUEUE_BYTES
SPLIT_CONTENTS = 20_000
#: Bytes whose hashes stay in a core's cache while anchors are chosen; the anchors do not depend on it.
CACHED = 1 << 17
SPLIT_WINDOWS = 8
#: What names a content.
CONTENT = ["anchor", "c1", "c2"]


def _numbered(docs: DataFrame) -> DataFrame:
    return common.saved(docs.withColumn("rid", F.monotonically_increasing_id()))


def _marks(buf: np.ndarray, off: np.ndarray, secret: bytes) -> np.ndarray:
    """A keyed digest of each text of a chunk: the places of its copies are one place."""
    view = memoryview(np.ascontiguousarray(buf))
    return np.frombuffer(b"".join([hashlib.blake2b(view[a:b], digest_size=8, key=secret).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]), np.uint64)


def _digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    """128 bits of each span, as two columns."""
    view = memoryview(raw)
    both = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    pair = np.frombuffer(both, np.int64).reshape(-1, 2)
    return [pa.array(pair[:, 0]), pa.array(pair[:, 1])]


def _places(length: int, secret: bytes):
    """anchor and a mark of the place, for every block and every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for a, b, buf, off in tb.chunks(batch.column("text"), CACHED):
                mark = _marks(buf, off, secret)
                got = anchors.blocks(buf, off, length)
                # the blocks of a text's copies are at one place
                occ = tb.mix(mark[got["text"]] + tb.mix(got["lo"].astype(np.uint64))).view(np.int64)
                long_ = np.flatnonzero(np.diff(off) >= length)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([got["anchor"], mark[long_].view(np.int64)])), pa.array(np.concatenate([occ, rid[a:b][long_]]))], names=["anchor", "occ"])

    return run


def _blocks(length: int, secret: bytes):
    """The blocks of each text, and the text itself as a block of no windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for a, b, buf, off in tb.chunks(batch.column("text"), CACHED):
                mark = _marks(buf, off, secret)
                got = anchors.blocks(buf, off, length)
                occ = tb.mix(mark[got["text"]] + tb.mix(got["lo"].astype(np.uint64))).view(np.int64)
                long_ = np.flatnonzero(np.diff(off) >= length)
                cat = lambda x, y, kind=np.int64: pa.array(np.concatenate([x, y]).astype(kind))
                none = np.zeros(len(long_))
                start = np.concatenate([got["start"], off[long_]])
                end = np.concatenate([got["start"] + got["n"] + length - 1, off[long_ + 1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        cat(rid[a:b][got["text"]], rid[a:b][long_]),
                        cat(got["lo"], none - 1, np.int32),
                        cat(got["n"], none, np.int32),
                        cat(got["reach"], none, np.int32),
                        cat(got["anchor"], mark[long_].view(np.int64)),
                        *_digests(buf.tobytes(), start, end),
                        cat(occ, rid[a:b][long_]),
                    ],
                    names=["rid", "lo", "n", "reach", *CONTENT, "occ"],
                )

    return run


def _contents(length: int):
    """The bytes of each wanted content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, wants in zip(batch.column("text").to_pylist(), batch.column("wants").to_pylist(), strict=True):
                raw = (text or "").encode()
                for w in wants:
                    for into, v in zip(out, (w["anchor"], w["c1"], w["c2"], w["reach"], raw[w["lo"] : w["lo"] + w["n"] + length - 1]), strict=True):
                        into.append(v)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())], names=[*CONTENT, "reach", "bytes"])

    return run


def _finer(length: int, windows: int):
    """Contents cut into blocks of at most ``windows`` windows at equal distances from the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for anchor, c1, c2, reach, raw in zip(*(batch.column(c).to_pylist() for c in (*CONTENT, "reach", "bytes")), strict=True):
                n, at = len(raw) - length + 1, 0
                while at < n:  # window i begins reach - i bytes before the anchor
                    group = (reach - at) // windows
                    upto = min(n, reach - group * windows + 1)
                    last = reach - group * windows  # the group's last window; it may lie beyond the content
                    shared = raw[max(last, 0) : last - windows + 1 + length]
                    shard = xxhash.xxh64_intdigest(shared, anchor & 0xFFFFFFFF ^ group) & 0x7FFFFFFFFFFFFFFF
                    for into, v in zip(out, (anchor, c1, c2, at, upto - at, shard, raw[at : upto + length - 1]), strict=True):
                        into.append(v)
                    at = upto
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.int32()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.int64()), pa.array(out[6], pa.binary())], names=[*CONTENT, "at", "n", "shard", "bytes"])

    return run


def spans_of(flags: np.ndarray) -> list[dict[str, int]]:
    """Runs of true flags as {a, b}."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _shard(length: int, most: int, memory: int):
    def settle(keys: list[tuple[int, int, int]], pieces: list[bytes]) -> pa.RecordBatch:
        hits = [(k, s) for k, r in zip(keys, induced.repeated(pieces, length, memory), strict=True) if (s := spans_of(r))]
        return pa.RecordBatch.from_arrays([*[pa.array([k[i] for k, _ in hits], pa.int64()) for i in range(3)], pa.array([s for _, s in hits], SPANS)], names=[*CONTENT, "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int, int]] = []
        pieces: list[bytes] = []
        held = 0
        for batch in batches:
            for *key, raw in zip(*(batch.column(x).to_pylist() for x in (*CONTENT, "bytes")), strict=True):
                if held >= most and key[0] != keys[-1][0]:
                    yield settle(keys, pieces)
                    keys, pieces, held = [], [], 0
                keys.append(tuple(key))
                pieces.append(raw)
                held += len(raw)
        if keys:
            yield settle(keys, pieces)

    return run


FOUND = "anchor long, c1 long, c2 long, spans array<struct<a:int,b:int>>"


def _sorted(contents: DataFrame, length: int, shard_bytes: int, memory: int) -> DataFrame:
    """Spans of the contents (anchor, c1, c2, bytes) that meet in their anchor's shard."""
    dealt = contents.select(*CONTENT, "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_shard(length, shard_bytes, memory), FOUND)


def _split(contents: DataFrame, length: int, shard_bytes: int, memory: int, windows: int) -> DataFrame:
    """Spans of the contents of too frequent anchors, by way of finer shards."""
    finer = contents.mapInArrow(_finer(length, windows), "anchor long, c1 long, c2 long, at int, n int, shard long, bytes binary")
    d = F.sha2("bytes", 256)
    half = lambda i: F.conv(F.substring(d, i, 15), 16, 10).cast("long")
    finer = common.saved(finer.select(*CONTENT, "at", "n", "shard", half(1).alias("d1"), half(16).alias("d2"), "bytes"))
    named = finer.groupBy("shard", "d1", "d2").agg(F.count(F.lit(1)).alias("times"), F.first("bytes").alias("bytes"))
    named = common.saved(named)
    several = named.groupBy("shard").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("shard")
    alone = named.where("times = 1").join(several, "shard", "left_semi")
    meets = named.join(several, "shard", "left_semi").select(F.col("shard").alias("anchor"), F.col("d1").alias("c1"), F.col("d2").alias("c2"), "bytes")
    told = _sorted(meets, length, shard_bytes, memory).select(F.col("anchor").alias("shard"), F.col("c1").alias("d1"), F.col("c2").alias("d2"), "spans")
    told = alone.select("shard", "d1", "d2").join(told, ["shard", "d1", "d2"])
    whole = named.where("times > 1").select("shard", "d1", "d2", F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"))
    told = common.saved(told.unionByName(whole))
    every = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    hit = finer.select(*CONTENT, "at", "n", "shard", "d1", "d2").join(told, ["shard", "d1", "d2"]).withColumn("spans", F.coalesce("spans", every))
    hit = hit.withColumn("spans", F.transform("spans", lambda x: F.struct((x["a"] + F.col("at")).alias("a"), (x["b"] + F.col("at")).alias("b"))))
    return hit.groupBy(*CONTENT).agg(F.flatten(F.collect_list("spans")).alias("spans"))  # the blocks of one content


def marks(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, split_contents: int = SPLIT_CONTENTS, queue_bytes: int = QUEUE_BYTES, split_windows: int = SPLIT_WINDOWS) -> DataFrame:
    """rid and ``found``: array of (lo, spans) blocks with repeated windows; lo -1: the whole text repeats.

    ``docs`` is a stored table with rid and text.
    """
    common.workers_import(docs.sparkSession)
    secret = secrets.token_bytes(32)
    texts = docs.select("rid", "text")
    seen = texts.mapInArrow(_places(length, secret), "anchor long, occ long")
    seen = seen.groupBy("anchor").agg(F.min("occ").alias("x"), F.max("occ").alias("y")).where("x <> y").select("anchor")
    seen = common.saved(seen)  # as a table of its own, so that the join below can split a frequent anchor
    blocks = texts.mapInArrow(_blocks(length, secret), "rid long, lo int, n int, reach int, anchor long, c1 long, c2 long, occ long")
    cands = common.saved(blocks.join(seen, "anchor"))
    named = cands.groupBy(*CONTENT).agg(F.min("occ").alias("x"), F.max("occ").alias("y"), F.min(F.struct("rid", "lo", "n", "reach")).alias("one"))
    named = common.saved(named.select(*CONTENT, (F.col("x") != F.col("y")).alias("whole"), "one"))
    several = named.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
    wants = named.join(several, "anchor").select(F.col("one.rid").alias("rid"), F.struct(*CONTENT, "one.lo", "one.n", "one.reach", (F.col("contents") > split_contents).alias("hot")).alias("w"))
    wants = wants.where("w.lo >= 0").groupBy("rid").agg(F.collect_list("w").alias("wants"))  # blocks of one text
    contents = texts.join(wants, "rid")

    def fetched(hot: bool) -> DataFrame:
        part = contents.withColumn("wants", F.filter("wants", lambda w: w.hot == F.lit(hot))).where(F.size("wants") > 0)
        return part.select("text", "wants").mapInArrow(_contents(length), "anchor long, c1 long, c2 long, reach int, bytes binary")

    found = _sorted(fetched(False), length, shard_bytes, queue_bytes)
    if several.where(F.col("contents") > split_contents).limit(1).count():
        found = found.unionByName(_split(fetched(True), length, shard_bytes, queue_bytes, split_windows))
    found = common.saved(found)
    told = named.join(found, CONTENT, "left")
    every = F.array(F.struct(F.lit(0).alias("a"), F.col("one.n").alias("b")))
    told = told.select(*CONTENT, F.when(F.col("whole"), every).otherwise(F.col("spans")).cast("array<struct<a:int,b:int>>").alias("spans")).where("spans is not null")
    told = common.saved(told)
    hit = cands.select(*CONTENT, "rid", "lo").join(told, CONTENT)
    return hit.groupBy("rid").agg(F.collect_list(F.struct("lo", "spans")).alias("found"))


def covered(n: int, found: list[dict] | None, length: int) -> np.ndarray:
    """Which of a text's ``n`` bytes repeated windows cover."""
    if not found:
        return np.zeros(n, bool)
    if any(f["lo"] < 0 for f in found):
        return np.full(n, n >= length)
    edge = np.zeros(n + 1, np.int32)
    a = np.array([f["lo"] + s["a"] for f in found for s in f["spans"]], np.int64)
    b = np.array([f["lo"] + s["b"] - 1 + length for f in found for s in f["spans"]], np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    return np.cumsum(edge)[:n] > 0


def all_covered(off: np.ndarray, found: pa.ListArray, length: int) -> np.ndarray:
    """``covered`` for a chunk of texts (``off``: where each begins), one after the other."""
    sizes = lambda lists: lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    blocks = found.flatten()
    row, lo, spans = np.repeat(np.arange(len(found)), sizes(found)), blocks.field("lo").to_numpy(zero_copy_only=False).astype(np.int64), blocks.field("spans")
    whole = np.unique(row[lo < 0])
    whole = whole[np.diff(off)[whole] >= length]
    each = sizes(spans)
    span, own = spans.flatten(), np.repeat(lo >= 0, each)
    base = np.repeat(off[row] + lo, each)[own]
    a, b = (span.field(x).to_numpy(zero_copy_only=False)[own] + base for x in ("a", "b"))
    count = lambda first, more: np.bincount(np.concatenate([first, more]), minlength=int(off[-1]) + 1)
    return np.cumsum(count(a, off[whole]) - count(b - 1 + length, off[whole + 1]))[: off[-1]] > 0


def _report(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in tb.chunks(batch.column("text")):
                gone = all_covered(off, batch.column("found").slice(a, b - a), length)
                removed = tb.per_text(gone, off)
                first = gone.copy()  # of each removed run
                first[1:] &= ~gone[:-1]
                head = off[:-1][off[1:] > off[:-1]]
                first[head] = gone[head]
                kept, upto = memoryview(buf[~gone]), off - np.concatenate([[0], np.cumsum(removed)])
                digest = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(off)), pa.array(removed), pa.array(tb.per_text(first, off)), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def report(docs: DataFrame, length: int = LENGTH, **parameters) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    d = _numbered(common.with_columns(docs, doc_id="long", text="string"))
    m = marks(d, length, **parameters)
    return d.join(m, "rid", "left").select("doc_id", "text", "found").mapInArrow(_report(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = LENGTH, **parameters) -> DataFrame:
    """``docs`` with repeated strings taken out of ``text``; its columns unchanged."""
    d = _numbered(common.boxed(docs, text="string"))
    m = marks(d, length, **parameters)
    cut = lambda text, found: np.frombuffer(raw := (text or "").encode(), np.uint8)[~covered(len(raw), found, length)].tobytes().decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else cut(t, f) for t, f in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], names=["_row", "text"])

    schema = T.StructType([d.schema["_row"], T.StructField("text", T.StringType())])
    kept = d.join(m, "rid", "left").select("_row", "text", "found").mapInArrow(run, schema)
    return kept.select(*[(F.col("text") if c.lower() == "text" else F.col("_row").getField(c)).alias(c) for c in docs.columns])
