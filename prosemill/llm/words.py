"""Words of many texts at once, as arrays of 64-bit hashes.

Texts come as bytes. Words are runs of anything but ASCII white space; a word's hash is a
polynomial over a random value for each of its bytes, taken from running sums, so no Python
object is made for a word. Texts are worked through in slices that end at white space:
memory follows the slice, or the longest word.
"""

from __future__ import annotations

import numpy as np

A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SLICE = 1 << 16
_ODD = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a permutation, so distinct values stay distinct."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


class WordHasher:
    """Word hashes of texts; ``lower`` folds A-Z first."""

    def __init__(self, lower: bool = False):
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * A)
        if lower:
            self.values[65:91] = self.values[97:123]
        self.up = self.down = np.zeros(0, np.uint64)

    def spans(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of these ranges of bytes, ascending, whatever they hold; meant for short ones (a few words)."""
        out, k = np.empty(len(start), np.uint64), 0
        while k < len(start):
            lo = int(start[k])
            j = max(k + 1, int(np.searchsorted(end, lo + SLICE, "right")))
            out[k:j] = self._spans(raw[lo : int(end[j - 1])], start[k:j] - lo, end[k:j] - lo)
            k = j
        return out

    def _spans(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(raw):
            self.up, self.down = _powers(_ODD, len(raw)), _powers(pow(_ODD, -1, 1 << 64), len(raw))
        run = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.up[: len(raw)], out=run[1:])
        return mix((run[end] - run[start]) * self.down[start] + (end - start).astype(np.uint64))

    def _slice(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        space = np.ones(len(raw) + 2, bool)
        space[1:-1] = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1])
        start, end = edge[::2], edge[1::2]
        return self._spans(raw, start, end), start, end

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end of every word in these bytes."""
        whole, parts, lo = np.frombuffer(raw, np.uint8), [], 0
        while lo < len(whole):
            hi = min(lo + SLICE, len(whole))
            while hi < len(whole) and not _SPACE[whole[hi - 1]]:
                gap = np.flatnonzero(_SPACE[whole[hi : hi + SLICE]])
                hi = hi + int(gap[0]) + 1 if len(gap) else min(hi + SLICE, len(whole))
            h, s, e = self._slice(whole[lo:hi])
            parts.append((h, s + lo, e + lo))
            lo = hi
        if not parts:
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), none, none
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def run_hashes(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each of these positions, order included."""
    out = np.full(len(at), n, np.uint64)
    for i in range(n):
        out = mix(out * A + h[at + i])
    return out
