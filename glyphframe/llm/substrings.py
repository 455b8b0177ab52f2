"""Finding the places of a corpus that could hold repeated strings, without looking at each pair of places.

A window is a string of `length` bytes. Its anchor is the place in it where the hash of the next GRAM bytes is smallest, the
first of equal ones. Equal windows have their anchors at the same distance, so a window can only repeat where its anchor's
gram does. Neighbouring windows mostly share an anchor: there is one for about (length - GRAM) / 2 bytes of text.
"""

from __future__ import annotations

import numpy as np

GRAM = 50
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
PLACES = np.uint64((1 << 24) - 1)
BUFFER = 1 << 19  # bytes looked at together, so that the arrays stay in the cache

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i below n or more."""
    size = max(BUFFER * 2, 1 << (n - 1).bit_length())
    if size not in _powers:
        made = []
        for base in (BASE, INVERSE):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        _powers.clear()
        _powers[size] = (made[0], made[1])
    return _powers[size]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A mixed hash of the GRAM bytes from each place."""
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(raw) - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    out = x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, gram hash) of each run of windows of raw that share an anchor, in order."""
    none = np.empty(0, np.int64)
    if len(raw) < length:
        return none, none, none, none
    if len(raw) > BUFFER + length:  # in parts that overlap by what a window needs; a run that a cut falls into is joined again
        parts = [[x + (i if k < 3 else 0) for k, x in enumerate(anchors(raw[i : i + BUFFER + length - 1], length))] for i in range(0, len(raw) - length + 1, BUFFER)]
        at, lo, hi, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        same = np.flatnonzero(at[1:] == at[:-1])
        keep_first, keep_last = np.ones(len(at), bool), np.ones(len(at), bool)
        keep_first[same + 1], keep_last[same] = False, False
        return at[keep_first], lo[keep_first], hi[keep_last], h[keep_first]
    h = gram_hashes(raw.astype(np.uint64))
    marked = (h & ~PLACES) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_min(marked, length - GRAM + 1) & PLACES).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    ends = np.concatenate((starts[1:] - 1, [len(at) - 1]))
    return at[starts], starts, ends, h[at[starts]].view(np.int64)
