"""Anchors and blocks: which repeated strings can be where.

A window is a string of ``length`` bytes inside one text.  Its anchor is its
smallest ``gram``-byte substring by hash, the leftmost of equals, so equal
windows have equal anchors at equal places.  Consecutive windows with the same
anchor form a block; its bytes run from the first window's start to the last
one's end.
"""

from __future__ import annotations

import numpy as np

from . import textbytes as tb

GRAM = 24


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from minima of runs of powers of two."""
    n, have = len(key) - width + 1, 1
    least, spare = key, [np.empty_like(key), np.empty_like(key)]
    while have * 2 <= width:
        into = spare[0][: len(least) - have]
        np.minimum(least[:-have], least[have:], out=into)
        least, spare, have = into, spare[::-1], have * 2
    return np.minimum(least[:n], least[width - have : width - have + n])


def blocks(buf: np.ndarray, off: np.ndarray, length: int, gram: int = GRAM) -> dict[str, np.ndarray]:
    """text, lo (first window's start in the text), n (windows), anchor, reach (bytes from the first window to the anchor) and start in ``buf`` of each block."""
    none = {k: np.zeros(0, np.int64) for k in ("text", "lo", "n", "anchor", "reach", "start")}
    if len(buf) < length:
        return none
    h = tb.rolled_from_each(tb.rolling(buf), gram)
    least = sliding_least((h & tb.U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    place = (least & tb.U64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(off)
    long_ = np.flatnonzero(size >= length)
    if not len(long_):
        return none
    valid = np.zeros(len(place) + 1, np.int64)
    np.add.at(valid, off[long_], 1)
    np.add.at(valid, off[long_ + 1] - length + 1, -1)
    ok = np.cumsum(valid)[:-1] > 0
    new = ok.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~ok[:-1]
    new[off[long_]] = True
    last = ok.copy()
    last[:-1] &= (place[1:] != place[:-1]) | ~ok[1:]
    last[off[long_ + 1] - length] = True
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    text = np.searchsorted(off, lo, "right") - 1
    return {"text": text, "lo": lo - off[text], "n": hi - lo + 1, "anchor": h[place[lo]].view(np.int64), "reach": place[lo] - lo, "start": lo}
