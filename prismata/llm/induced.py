"""External induced suffix sorting of a shard, with common prefixes.

The shard's text is a uint8 array in which 0 ends each piece.  A suffix is of
type S when it is smaller than the next one, else L; the leftmost S of each run
(S*) is sorted first.  S* substrings are sorted by their symbols and get names;
unless all names differ, the string of names is sorted in turn by the same
method, recursively, until it is short enough to be sorted in memory.  From the sorted S* suffixes a sweep induces all L suffixes
and a sweep the other way all S suffixes.

A sweep is a priority queue over (first symbol, order of the rest).  The queue
holds suffix tuples in runs by bucket of first symbols; what exceeds ``memory``
bytes goes to a file, and so does a shard's text that exceeds it.  A bucket of
one symbol is read run by run in the order it was filled.  A bucket of several
symbols (strings of names have many) is taken in batches: as long as no suffix
induced by the batch belongs before its end.

On bytes, a tuple is (suffix, common prefix with the tuple before it in its
bucket).  Induced tuples get their prefix from the least prefix passed since the
last tuple of their bucket; where the two kinds of suffixes meet and between S*
suffixes, bytes are compared.  So prefixes, cut at ``length``, are exact, and
nothing is decided by a hash.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of tuples a queue keeps in memory; also what a text may have before it is mapped from a file.
QUEUE_BYTES = 8 << 20
#: Suffixes in a bucket of several symbols, about.
BUCKET = 8_000
#: Tuples of a bucket that are read at once, about.
BATCH = 1 << 16
#: Tuples of a bucket of several symbols that are looked at for the end of a batch, at least.
LOOK = 256

Run = tuple[np.ndarray, ...]


class Queue:
    """Runs of tuples by bucket, first in first out; beyond ``memory`` bytes they lie in a file."""

    def __init__(self, buckets: int, memory: int = QUEUE_BYTES):
        self.runs: list[list] = [[] for _ in range(buckets)]
        self.memory, self.held, self.spilled, self.file = memory, 0, 0, None

    def add(self, bucket: int, run: Run) -> None:
        size = sum(c.nbytes for c in run)
        if self.held + size > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            for c in run:
                self.file.write(np.ascontiguousarray(c).data)
            self.spilled += size
            self.runs[bucket].append((at, [(c.dtype, len(c)) for c in run]))
        else:
            self.held += size
            self.runs[bucket].append(run)

    def put(self, buckets: np.ndarray, run: Run) -> None:
        """Append tuples, in order, to their buckets."""
        if not len(buckets):
            return
        order = np.argsort(buckets, kind="stable")
        buckets = buckets[order]
        edges = np.flatnonzero(np.diff(buckets, prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(buckets)], strict=True):
            self.add(int(buckets[a]), tuple(c[order[a:b]] for c in run))

    def get(self, bucket: int, i: int) -> Run:
        run = self.runs[bucket][i]
        if isinstance(run[0], int):
            self.file.seek(run[0])
            return tuple(np.frombuffer(self.file.read(n * kind.itemsize), kind) for kind, n in run[1])
        return run

    def take(self, bucket: int, i: int, back: bool = False, most: int = BATCH) -> tuple[Run, int]:
        """The runs from the i-th on (``back``: before it) that hold about ``most`` tuples together, and the next i."""
        runs, n = [], 0
        while n < most and (i > 0 if back else i < len(self.runs[bucket])):
            i -= back
            runs.append(self.get(bucket, i))
            n += len(runs[-1][0])
            i += not back
        if back:
            runs.reverse()
        return (runs[0] if len(runs) == 1 else tuple(np.concatenate(c) for c in zip(*runs, strict=True))), i

    def all(self, bucket: int) -> Run | None:
        return self.take(bucket, 0, most=1 << 62)[0] if self.runs[bucket] else None

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def scratch(a: np.ndarray, memory: int) -> np.ndarray:
    """``a``, mapped from a temporary file where it exceeds ``memory`` bytes."""
    if a.nbytes <= memory:
        return a
    with tempfile.TemporaryFile() as f:
        out = np.memmap(f, a.dtype, "w+", shape=a.shape)
        out[:] = a
        return out


def types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last suffix is L."""
    n = len(t)
    at = np.full(n, n - 1, np.int32)
    differs = np.flatnonzero(t[1:] != t[:-1])
    at[differs] = differs
    at = np.minimum.accumulate(at[::-1])[::-1]
    s = np.zeros(n, bool)
    inside = at < n - 1
    s[inside] = t[at[inside]] < t[at[inside] + 1]
    return s


def named(t: np.ndarray, s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of the substrings [start, end), dense and in their order; a symbol's L comes before its S."""
    bits = (2 * int(t.max()) + 3).bit_length()
    per = 63 // bits
    rank = np.zeros(len(start), np.int64)
    active, done = np.arange(len(start)), 0
    while len(active):
        at, stop = start[active] + done, end[active]
        word = np.zeros(len(active), np.int64)
        for j in range(per):
            p = np.minimum(at + j, stop - 1)
            word = word << bits | np.where(at + j < stop, t[p].astype(np.int64) * 2 + s[p] + 1, 0)
        order = np.lexsort((word, rank[active])) if done else np.argsort(word)
        active, word = active[order], word[order]
        r = rank[active]
        old = np.ones(len(r), bool)
        old[1:] = r[1:] != r[:-1]
        new = old.copy()
        new[1:] |= word[1:] != word[:-1]
        place = np.arange(len(r))
        first = np.maximum.accumulate(np.where(new, place, 0))
        rank[active] = r + first - np.maximum.accumulate(np.where(old, place, 0))
        alone = new & np.append(new[1:], True)
        done += per
        active = active[~alone & (start[active] + done < end[active])]
    present = np.zeros(len(start) + 1, np.int64)
    present[rank] = 1
    return (np.cumsum(present) - 1)[rank]


def star_order(t: np.ndarray, s: np.ndarray, memory: int) -> np.ndarray:
    """The S* suffixes in order."""
    star = s.copy()
    star[1:] &= ~s[:-1]
    star[0] = False
    lms = np.flatnonzero(star).astype(np.int32)
    if len(lms) < 2:
        return lms
    names = named(t, s, lms, np.append(lms[1:] + 1, len(t)))
    if names.max() + 1 == len(lms):
        order = np.empty(len(lms), np.int64)
        order[names] = np.arange(len(lms))
        return lms[order]
    return lms[sorted_suffixes(names.astype(np.int32), memory)]


def _buckets(t: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each symbol, whether a bucket has one symbol only, and the first symbol of each bucket."""
    count = np.bincount(t)
    before = np.cumsum(count) - count
    new = np.ones(len(count), bool)
    new[1:] = (before[1:] // size != before[:-1] // size) | (count[1:] >= size) | (count[:-1] >= size)
    first = np.flatnonzero(new)
    return np.cumsum(new) - 1, np.diff(np.append(first, len(count))) == 1, first


def _sweep_names(w: np.ndarray, first: np.ndarray, stream: np.ndarray, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The (symbol, suffix) tuples induced from ``stream``, in order, by batches.

    ``stream`` (suffixes sorted by symbol) comes after the queue's tuples of the
    same symbol; ``first`` is in the queue from the start.
    """
    bucket_of, _, lowest = _buckets(w, BUCKET)
    queue = Queue(len(lowest), memory)
    queue.put(bucket_of[w[first]], (w[first], first))
    edges = np.searchsorted(w[stream], np.append(lowest, len(bucket_of)))
    for b in range(len(lowest)):
        given = stream[edges[b] : edges[b + 1]]
        waiting = queue.all(b) or (w[:0], first[:0])
        key = np.concatenate([waiting[0].astype(np.int64) * 2, w[given].astype(np.int64) * 2 + 1])
        suffix = np.concatenate([waiting[1], given])
        order = np.argsort(key, kind="stable")
        key, suffix = key[order], suffix[order]
        ahead, leaving = len(key), []
        while len(key):
            near, own = key[:ahead], suffix[:ahead]  # a batch ends early as a rule, so that looking at the whole bucket each time would be quadratic
            before = own - 1
            sym = w[before].astype(np.int64)  # of the suffix -1: any symbol, not used
            induces = (own > 0) & (sym * 2 >= near)
            least = np.minimum.accumulate(np.where(induces, sym * 2, np.iinfo(np.int64).max))
            late = np.flatnonzero(least[:-1] < near[1:])
            m = int(late[0]) + 1 if len(late) else len(near)
            ahead = max(LOOK, 2 * m)
            taken = near[:m] & 1 == 0
            yield near[:m][taken] >> 1, own[:m][taken]
            go = induces[:m]
            sym, before = sym[:m][go], before[:m][go]
            here = bucket_of[sym] == b
            leaving.append((sym[~here], before[~here]))
            key, suffix = key[m:], suffix[m:]
            if here.any():
                key, suffix = np.concatenate([key, sym[here] * 2]), np.concatenate([suffix, before[here]])
                order = np.argsort(key, kind="stable")
                key, suffix = key[order], suffix[order]
        if leaving:
            sym, before = (np.concatenate(c) for c in zip(*leaving, strict=True))
            queue.put(bucket_of[sym], (sym, before))
    queue.close()


def doubled(t: np.ndarray) -> np.ndarray:
    """All suffixes of a short string in order, by the ranks of ever longer prefixes."""
    rank, known = t.astype(np.int64) + 1, 1
    while True:
        follow = np.zeros(len(t), np.int64)
        follow[:-known] = rank[known:]
        key = rank << 32 | follow
        order = np.argsort(key)
        new = np.diff(key[order], prepend=-1) != 0
        rank[order] = np.cumsum(new)
        known *= 2
        if new.all() or known >= len(t):
            return order


def sorted_suffixes(t: np.ndarray, memory: int = QUEUE_BYTES) -> np.ndarray:
    """All suffixes of a string of names in order; a suffix that ends is smaller.

    The recursion ends with a string that takes no more than ``memory`` to sort.
    """
    if len(t) * 24 <= memory:
        return doubled(t)
    s = types(t)
    star = star_order(t, s, memory)
    larger = [np.concatenate(c) for c in zip(*_sweep_names(t, np.array([len(t) - 1], np.int32), star, memory), strict=True)]
    w = t.max() - t
    smaller = [np.concatenate(c) for c in zip(*_sweep_names(w, star[:0], larger[1][::-1], memory), strict=True)]
    symbols = np.concatenate([larger[0] * 2, (int(t.max()) - smaller[0][::-1]) * 2 + 1])
    return np.concatenate([larger[1], smaller[1][::-1]])[np.argsort(symbols, kind="stable")]


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Equal bytes at the starts of suffixes a and b of ``t`` (which ends with eight spare bytes), cut at ``most``."""
    words = np.ndarray((len(t) - 7,), "<u8", t, strides=(1,))
    out = np.full(len(a), most, np.int32)
    active = np.arange(len(a))
    for done in range(0, most, 8):
        x, y = a[active] + done, b[active] + done
        over = np.maximum(x, y) >= len(words)
        d = words[np.where(over, 0, x)] ^ words[np.where(over, 0, y)]
        same = (d == 0) & ~over
        end = active[~same]
        low = d[~same]
        out[end] = done + np.log2(np.maximum(1, low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int32) // 8
        active = active[same]
        if not len(active):
            break
    return np.minimum(out, most)


class _Least:
    """Least values of ranges of an array."""

    def __init__(self, a: np.ndarray):
        self.rows = [a]
        while 2 * (step := 1 << (len(self.rows) - 1)) <= len(a):
            up = self.rows[-1]
            self.rows.append(np.minimum(up[:-step], up[step:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of first..last, both in."""
        level = np.log2(last - first + 1).astype(np.int64)
        out = np.empty(len(first), self.rows[0].dtype)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.rows[k][first[at]], self.rows[k][last[at] - (1 << k) + 1])
        return out


class _Sweep:
    """A sweep over bytes with common prefixes; ``w`` is the text, with its order turned round for the second sweep."""

    def __init__(self, w: np.ndarray, t: np.ndarray, length: int, memory: int):
        self.w, self.t, self.length = w, t, length
        self.queue = Queue(256, memory)
        #: Least prefix passed since the last tuple of each bucket; -1 before the first.
        self.least = np.full(256, -1, np.int32)
        self.last = -1

    def passed(self, suffix: np.ndarray, prefix: np.ndarray, queued: bool) -> None:
        """Induce from tuples in order, of one first byte."""
        before = suffix - 1
        sym = self.w[before]
        own = self.w[suffix[0]]
        go = np.flatnonzero((suffix > 0) & ((sym >= own) if queued else (sym > own)))
        to = sym[go].astype(np.int64)
        order = np.argsort(to, kind="stable")
        place, to = go[order], to[order]
        head = np.ones(len(to), bool)
        head[1:] = to[1:] != to[:-1]
        since = np.zeros(len(to), np.int64)
        since[1:] = np.where(head[1:], 0, place[:-1] + 1)
        least = _Least(prefix)
        value = least.of(since, place)
        value[head] = np.minimum(value[head], self.least[to[head]])
        tail = np.append(head[1:], True)[: len(to)]
        self.least = np.minimum(self.least, prefix.min())
        rest = place[tail] + 1
        open_ = rest < len(prefix)
        fresh = np.full(len(rest), self.length, np.int32)
        fresh[open_] = least.of(rest[open_], np.full(open_.sum(), len(prefix) - 1))
        self.least[to[tail]] = fresh
        self.queue.put(to, (before[place], np.minimum(value + 1, self.length).astype(np.int32)))
        self.last = int(suffix[-1])

    def seam(self, suffix: int) -> int:
        """The prefix that a suffix shares with the last one, of the same first byte."""
        return int(common(self.t, np.array([self.last]), np.array([suffix]), self.length)[0])


def repeated_suffixes(t: np.ndarray, length: int, memory: int = QUEUE_BYTES) -> tuple[np.ndarray, int]:
    """Which suffixes of the bytes ``t`` share ``length`` bytes with another one, and how many bytes of tuples were spilled."""
    n = len(t)
    s = types(t)
    star = star_order(t, s, memory)
    padded = scratch(np.concatenate([t, np.zeros(8, np.uint8)]), memory)
    t = padded[:n]
    shared = np.zeros(len(star), np.int32)
    if len(star) > 1:
        shared[1:] = common(padded, star[:-1], star[1:], length)
    up = _Sweep(t, padded, length, memory)
    up.queue.add(int(t[n - 1]), (np.array([n - 1], np.int32), np.zeros(1, np.int32)))
    edges = np.searchsorted(t[star], np.arange(257))
    for c in range(256):
        i = 0
        while i < len(up.queue.runs[c]):
            run, i = up.queue.take(c, i)
            up.passed(*run, True)
        given = star[edges[c] : edges[c + 1]]
        if len(given):
            prefix = shared[edges[c] : edges[c + 1]].copy()
            prefix[0] = up.seam(int(given[0])) if i else 0
            up.passed(given, prefix, False)
    down = _Sweep(scratch(255 - t, memory), padded, length, memory)
    hit = np.zeros(n, bool)

    def emit(suffix: np.ndarray, prefix: np.ndarray, queued: bool) -> None:
        if prefix[0] >= length:
            hit[down.last] = True
        at = np.flatnonzero(prefix >= length)
        hit[suffix[at]] = True
        hit[suffix[at[at > 0] - 1]] = True
        down.passed(suffix, prefix, queued)

    for c in range(255, -1, -1):
        i = 0
        while i < len(down.queue.runs[255 - c]):
            run, i = down.queue.take(255 - c, i)
            emit(*run, True)
        after, j = None, len(up.queue.runs[c])
        while j > 0:
            (suffix, prefix), j = up.queue.take(c, j, back=True)
            if after is None:
                after = down.seam(int(suffix[-1])) if i else 0
            turned = np.concatenate([[after], prefix[:0:-1]]).astype(np.int32)
            emit(suffix[::-1], turned, False)
            after = int(prefix[0])
    spilled = up.queue.spilled + down.queue.spilled
    up.queue.close()
    down.queue.close()
    return hit, spilled


def repeated(pieces: list[bytes], length: int, memory: int = QUEUE_BYTES) -> list[np.ndarray]:
    """For each piece, which of its strings of ``length`` bytes (by start) also start elsewhere in the shard."""
    size = np.array([len(p) for p in pieces], np.int64)
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    start = np.cumsum(size + 1) - size - 1
    t = raw + np.uint8(1)  # UTF-8 has no byte above 0xF4
    t[start + size] = 0
    hit, _ = repeated_suffixes(t, length, memory)
    return [hit[a : a + max(0, n - length + 1)] for a, n in zip(start.tolist(), size.tolist(), strict=True)]
