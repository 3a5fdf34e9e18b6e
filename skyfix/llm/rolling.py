"""Vectorised hashes of words and of runs of words, for use inside tasks."""

from __future__ import annotations

import numpy as np

#: Odd, so that it has an inverse among 64-bit integers.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class ByteHash:
    """Hashes of byte ranges by prefix sums of a polynomial; keeps the powers it has needed."""

    def __init__(self):
        self.up, self.down = _powers(BASE, 1 << 16), _powers(INVERSE, 1 << 16)

    def ranges(self, text: bytes, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(text)
        if n >= len(self.up):
            self.up, self.down = _powers(BASE, 2 * n), _powers(INVERSE, 2 * n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        return mixed((sums[end] - sums[first]) * self.down[first])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the word."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def spans(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces; where each begins and ends there."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return b" ".join(words), ends - sizes, ends


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window, by doubling."""
    n, y, k = len(x) - width + 1, x, 1
    while 2 * k <= width:
        y, k = np.minimum(y[:-k], y[k:]), 2 * k
    return np.minimum(y[:n], y[width - k : width - k + n])
