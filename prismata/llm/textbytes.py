"""Vectorised text primitives over Arrow batches.

A chunk is one uint8 buffer with the UTF-8 bytes of several texts plus the
offsets of each text, so hashing, word splitting and counting are numpy passes
over bytes and never a Python loop over rows.  Chunks hold about ``CHUNK``
bytes, which bounds the temporaries whatever the batch size; one longer text
makes a chunk of its own.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
#: An odd multiplier, so that its powers have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
U64 = np.uint64

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: One random 64-bit value per byte value.
BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n, kept for the life of the worker."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", BASE), ("down", BASE_INV)):
            a = np.full(size, base, U64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix), in two arrays of its own."""
    y = x >> U64(30)
    y ^= x
    y *= U64(0xBF58476D1CE4E5B9)
    t = y >> U64(27)
    y ^= t
    y *= U64(0x94D049BB133111EB)
    t = np.right_shift(y, U64(31), out=t if isinstance(t, np.ndarray) else None)
    y ^= t
    return y


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as large binary without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return column.fill_null(b"").cast(pa.large_binary())
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    return column.fill_null("").cast(pa.large_string()).cast(pa.large_binary())


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a large binary column without nulls."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) pieces of about ``limit`` bytes."""
    buf, off = buffers(binary(column))
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` within each text."""
    c = np.zeros(len(flags) + 1, np.int64 if flags.dtype.kind in "biu" else flags.dtype)
    np.cumsum(flags, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def rolling(buf: np.ndarray) -> np.ndarray:
    """Sums from which ``rolled`` reads the hash of any span.

    A polynomial modulo 2**64: strings with one hash can be made on purpose, so
    it may choose where to look and never says that two strings are equal.
    """
    up, _ = powers(len(buf) + 1)
    p = np.zeros(len(buf) + 1, U64)
    x = BYTE_CODE[buf]
    x *= up[: len(buf)]
    np.cumsum(x, out=p[1:])
    return p


def rolled(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit rolling hash of bytes [start, end), the same wherever they stand."""
    _, down = powers(len(p))
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(U64))


def rolled_from_each(p: np.ndarray, n: int) -> np.ndarray:
    """``rolled`` of the ``n`` bytes from each byte on."""
    _, down = powers(len(p))
    x = p[n:] - p[:-n]
    x *= down[: len(x)]
    x += U64(n)
    return mix(x)


class Key:
    """Secret numbers of one hash function: nobody who writes a text knows them, so no two strings can be made to collide."""

    def __init__(self, secret: bytes | None = None) -> None:
        self.secret = secret or secrets.token_bytes(32)
        more = hashlib.blake2b(self.secret, digest_size=64).digest() + hashlib.blake2b(self.secret, digest_size=64, salt=b"more").digest()
        self.add = np.frombuffer(more, U64)
        self.length = self.add[0] ^ U64(len(self.secret))


#: Drawn anew in each process: for hashes that no other process sees.
OWN = Key()
#: Bytes of a span that are hashed in numpy; a longer one by a keyed cryptographic digest.
PLAIN = 128
_BELOW = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, key: Key = OWN) -> np.ndarray:
    """64-bit keyed hash of bytes [start, end), the same wherever they stand.

    Eight bytes at a time go through keyed bijective mixing, for as many spans
    as have so many bytes.
    """
    size = end - start
    h = mix(size.astype(U64) + key.length)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words8 = np.ndarray(len(buf) + 1, "<u8", padded.data, strides=(1,))
    rows = np.flatnonzero((size > 0) & (size <= PLAIN))
    for i in range(PLAIN // 8):
        if i:
            rows = rows[size[rows] > 8 * i]
        if not len(rows):
            break
        eight = words8[start[rows] + 8 * i] & _BELOW[np.minimum(size[rows] - 8 * i, 8)]
        h[rows] = mix(h[rows] ^ mix(eight + key.add[i]))
    long_ = np.flatnonzero(size > PLAIN)
    if len(long_):
        view = memoryview(np.ascontiguousarray(buf))
        told = b"".join([hashlib.blake2b(view[a:b], digest_size=8, key=key.secret).digest() for a, b in zip(start[long_].tolist(), end[long_].tolist(), strict=True)])
        h[long_] = np.frombuffer(told, U64)
    return h


def words(buf: np.ndarray, off: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each run of bytes other than ASCII white space.

    ``cut``: where true, a run ends before that byte.
    """
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~WHITE[buf]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    if cut is not None:
        first |= cut & ink
        last[:-1] |= cut[1:] & ink[:-1]
    head = off[:-1][off[1:] > off[:-1]]
    first[head] = ink[head]
    tail = off[1:][off[1:] > off[:-1]] - 1
    last[tail] = ink[tail]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_hashes(buf: np.ndarray, off: np.ndarray, cut: np.ndarray | None = None, key: Key = OWN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, text = words(buf, off, cut)
    return span_hash(buf, start, end, key), start, end, text


def windows(h: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words inside one text, and its first word's number."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    x = np.zeros(n, U64)
    for j in range(k):
        x = x * U64(BASE) + h[j : j + n]
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    return mix(x[at]), at


def keyed(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes made distinct between texts."""
    return mix(h ^ mix(text.astype(U64) + U64(0x51_7C_C1_B7_27_22_0A_95)))


def unique(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, where one of each stands, and each value's number; like numpy's, but not by its stable sort."""
    order = np.argsort(h)
    x = h[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    inverse = np.empty(len(x), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return x[new], order[new], inverse
