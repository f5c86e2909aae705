"""Best-fit packing of tokenised documents by best-two-fit.

Method.  A document's ids (the tokenizer's, then the end id) are cut into
pieces of the capacity; only longer documents are cut.  Packing looks at the
histogram of piece lengths, which has one entry per length up to the capacity
however many pieces there are.  A bin is filled greedily: the longest waiting
length, then the longest that fits, until none does.  Then the bin's smallest
piece gives way to the two waiting pieces that fill its place and the gap most
tightly, again while that helps.  The bin is applied as often as all its
lengths last, so the plan has a few thousand patterns at any scale.  Pieces of
one length are interchangeable: each is numbered inside its length
(``common.ranked``) and looks its number up in the plan.

``packed_in_order`` keeps the order of the rows: it packs each stretch of
``STRETCH_DOCS`` consecutive rows by itself, from the histogram of the stretch,
and numbers the sequences through the stretches, so the first sequences hold the
first rows.  The order is that of a stored table (``common.numbered``).  A
stretch is of bounded size, so it is packed inside one task.

Tokenising.  White space ends every token of this vocabulary, as does the
border between an ASCII letter and most ASCII punctuation, and case is folded.
So a worker tokenises each distinct folded unit between such borders once and
keeps its ids by the unit's 64-bit hash under a key of its own (at most ``CACHED_WORDS`` units, then it
starts anew); a text's ids are gathered from there.  New units of letters only
are one word each for the vocabulary's own splitting, so they are tokenised on
end and told apart by the marks of word ends.  The vocabulary file is a parameter and is read where it is
installed.

Defined cases: null and empty texts are one piece with the end id alone; null
and repeated doc_ids keep their pieces; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb

CAPACITY = 4096
END_ID = 1
#: Consecutive rows that are packed together where the order of rows is kept.
STRETCH_DOCS = 1024
CACHED_WORDS = 1_500_000


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Punctuation beside which a letter always ends a token: no apostrophe, and nothing that special tokens contain.
BORDER = np.zeros(256, bool)
BORDER[list(b'.,!?;:#$%&*()[]{}"=+-/@~^')] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPECIAL = b"<|"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of words by hash; ``pool`` holds the ids of all known words on end."""

    def __init__(self, path: str, most: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.closes[i] = piece.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def tokenised(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts on end, and how many each has."""
        plain = [i for i, t in enumerate(texts) if t.isalpha() and t.lower().isalpha()]
        size = np.zeros(len(texts), np.int64)
        ids: list[np.ndarray] = []
        order: list[np.ndarray] = []
        if plain:
            run = np.array(self.tokenizer.encode(" ".join([texts[i] for i in plain]), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.closes[run]) + 1
            if len(ends) == len(plain):
                size[plain] = np.diff(ends, prepend=0)
                ids.append(run)
                order.append(np.repeat(np.array(plain), size[plain]))
            else:
                plain = []
        done = set(plain)
        rest = [i for i in range(len(texts)) if i not in done]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            ids.append(np.array(e.ids, np.uint32))
            size[i] = len(ids[-1])
            order.append(np.full(size[i], i))
        if not ids:
            return np.zeros(0, np.uint32), size
        return np.concatenate(ids)[np.argsort(np.concatenate(order), kind="stable")], size

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Tokenise new units, given in the order of their hashes."""
        flat, size = self.tokenised(texts)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        start = self.used + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.used += len(flat)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.start, self.size = np.insert(self.start, at, start), np.insert(self.size, at, size)

    def ids(self, buf: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk's texts on end, each closed by ``end_id``, and their offsets."""
        raw = buf.tobytes()
        if SPECIAL not in raw:
            buf = LOWER[buf]
            raw = buf.tobytes()
        cut = np.zeros(len(buf), bool)
        letter, border = LETTER[buf], BORDER[buf]
        cut[1:] = (letter[1:] & border[:-1]) | (border[1:] & letter[:-1])
        h, first, last, text = tb.word_hashes(buf, off, cut)
        if len(self.hashes) > self.most:
            self.clear()
        want, at, inverse = tb.unique(h)
        have = np.searchsorted(self.hashes, want)
        known = (have < len(self.hashes)) & (self.hashes[np.minimum(have, len(self.hashes) - 1)] == want) if len(self.hashes) else np.zeros(len(want), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            self.learn(want[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(first[at[new]].tolist(), last[at[new]].tolist(), strict=True)])
            have = np.searchsorted(self.hashes, want)
        start, size = self.start[have][inverse], self.size[have][inverse]
        stop = np.searchsorted(text, np.arange(len(off) - 1), "right")
        start, size = np.insert(start, stop, -1), np.insert(size, stop, 1)
        begin = np.cumsum(size) - size
        place = np.repeat(start - begin, size) + np.arange(int(size.sum()))
        out = self.pool[np.maximum(place, 0)]
        ends = begin[start < 0]
        out[ends] = end_id
        return out, np.concatenate([[0], ends + 1])


_known: dict[str, WordIds] = {}


def _cut(path: str, capacity: int, end_id: int, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _known.get(path) or _known.setdefault(path, WordIds(path))
        for batch in batches:
            for a, b, buf, off in tb.chunks(batch.column("text")):
                ids, at = words.ids(buf, off, end_id)
                ids = ids.astype("<u4")
                length = np.diff(at)
                pieces = -(-length // capacity)
                row = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                size = np.minimum(capacity, length[row] - start)
                first = at[row] + start
                crc = [zlib.crc32(ids[i : i + n].data) for i, n in zip(first.tolist(), size.tolist(), strict=True)]
                more = [pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32)))] if with_ids else []  # pieces lie on end
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(a, b - a).take(pa.array(row)) for c in keep], pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), *more],
                    names=[*keep, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])],
                )

    return run


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""
    common.workers_import(docs.sparkSession)
    d = common.with_columns(docs, doc_id="long", text="string")
    return d.mapInArrow(_cut(vocabulary or default_vocabulary(), capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths of one bin) patterns that use every piece; ``counts`` by length from 0."""
    left = np.zeros(capacity + 1, np.int64)
    left[: len(counts)] = counts
    out = []
    numbers = np.arange(capacity + 1)

    def below() -> np.ndarray:
        """The longest waiting length up to each length; 0: none."""
        return np.maximum.accumulate(np.where(left > 0, numbers, 0))

    def take(bin_: list[int], n: int) -> None:
        bin_.append(n)
        left[n] -= 1

    left[0] = 0
    while longest := int(below()[-1]):
        bin_: list[int] = []
        take(bin_, longest)
        gap = capacity - longest
        reach = below()
        while gap and (n := int(reach[gap])):
            take(bin_, n)
            gap -= n
            if not left[n]:
                reach = below()
        while gap and len(bin_) > 1:
            small = min(bin_)
            room = small + gap
            bin_.remove(small)
            left[small] += 1
            reach = below()
            one = numbers[1:room][left[1:room] > 0]
            two = reach[room - one]
            lone = (two == one) & (left[one] < 2)
            two = np.where(lone, reach[one - 1], two)
            total = np.where(two > 0, one + two, 0)
            best = int(total.argmax()) if len(total) else -1
            if best < 0 or total[best] <= small:
                take(bin_, small)
                break
            take(bin_, int(one[best]))
            take(bin_, int(two[best]))
            gap = room - int(total[best])
        used = np.bincount(bin_, minlength=capacity + 1)
        times = 1 + int((left[used > 0] // used[used > 0]).min())
        left -= (times - 1) * used
        out.append((times, sorted(bin_, reverse=True)))
    return out


def layout(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Where the r-th piece of each length goes: ranges of numbers, by (length, first number)."""
    rows, next_of, sequence = [], {}, 0
    for times, bin_ in patterns:
        offset = 0
        for n in bin_:
            rows.append((n, next_of.get(n, 0), sequence, offset))
            next_of[n] = next_of.get(n, 0) + times
            offset += n
        sequence += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": a[:, 0] << 44 | a[:, 1], "first": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    spark = docs.sparkSession
    cut = common.saved(pieces(docs, vocabulary, capacity, end_id))
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per length
        counts[r["length"]] = r["n"]
    shared = spark.sparkContext.broadcast(layout(best_two_fit(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(where["key"], length << 44 | rank, "right") - 1
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(where["sequence"][at] + rank - where["first"][at]), pa.array(where["offset"][at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranks = common.ranked(cut, "length", ["doc_id", "piece", "ids_crc32"], "_rank")
    return ranks.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _pack_stretch(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        """``table`` with ``sequence``, numbered from 0 inside the stretch, and ``offset``."""
        number, piece, length = (table.column(c).to_numpy().astype(np.int64) for c in ("number", "piece", "length"))
        where = layout(best_two_fit(np.bincount(length, minlength=capacity + 1), capacity))
        order = np.lexsort((piece, number, length))
        n = length[order]
        rank = np.arange(len(n)) - np.searchsorted(n, n)  # its number among the pieces of its length
        at = np.searchsorted(where["key"], n << 44 | rank, "right") - 1
        sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        sequence[order] = where["sequence"][at] + rank - where["first"][at]
        offset[order] = where["offset"][at]
        # sequences follow each other by their earliest rows
        first = np.full(int(sequence.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, sequence, number)
        turn = np.empty(len(first), np.int64)
        turn[np.argsort(first, kind="stable")] = np.arange(len(first))
        return table.append_column("sequence", pa.array(turn[sequence])).append_column("offset", pa.array(offset))

    return run


def packed_in_order(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, stretch_docs: int = STRETCH_DOCS, with_ids: bool = False) -> DataFrame:
    """What ``packed`` gives, for a stored table: rows of one stretch of ``stretch_docs`` rows share sequences, those of two do not.

    ``with_ids``: also ``ids``, the tokens of each piece.
    """
    spark = docs.sparkSession
    common.workers_import(spark)
    d = common.numbered(docs, "number", doc_id="long", text="string")
    kept = "number long, doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    cut = d.mapInArrow(_cut(vocabulary or default_vocabulary(), capacity, end_id, ("number", "doc_id"), with_ids), kept)
    cut = cut.withColumn("stretch", F.floor(F.col("number") / stretch_docs).cast("long"))
    placed = common.saved(cut.groupBy("stretch").applyInArrow(_pack_stretch(capacity), f"{kept}, stretch long, sequence long, offset long"))
    sizes = {r["stretch"]: r["n"] for r in placed.groupBy("stretch").agg((F.max("sequence") + 1).alias("n")).collect()}  # one row per stretch
    counts = np.zeros(max(sizes, default=-1) + 1, np.int64)
    counts[list(sizes)] = list(sizes.values())
    shared = spark.sparkContext.broadcast(np.cumsum(counts) - counts)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = shared.value
        for batch in batches:
            stretch, sequence = (batch.column(c).to_numpy() for c in ("stretch", "sequence"))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            more = ["ids"] if with_ids else []
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(before[stretch] + sequence), *[batch.column(c) for c in ("offset", *more)]], names=[*names, "sequence_id", "offset", *more])

    return placed.mapInArrow(number, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<int>" if with_ids else ""))


def sequences(docs: DataFrame, **parameters) -> DataFrame:
    """sequence_id, ids (at most the capacity) and doc_ids (of its pieces, in order) of each sequence of a stored table, in its order."""
    p = packed_in_order(docs, with_ids=True, **parameters)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # the pieces of one sequence
    t = p.groupBy("sequence_id").agg(parts.alias("parts"))
    return t.select("sequence_id", F.flatten(F.transform("parts", lambda x: x.ids)).alias("ids"), F.transform("parts", lambda x: x.doc_id).alias("doc_ids"))
