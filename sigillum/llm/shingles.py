"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

from .common import mix64

# Sent with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEEDED = np.random.Generator(np.random.PCG64(20260112))
_BYTE = _SEEDED.integers(1, 2**63, 256, dtype=np.uint64)
PLACE = _SEEDED.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 2**64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int, powers: Powers) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.
    A text of fewer words than a shingle is one shingle; without words it has none.
    """
    n = len(raw)
    if n == 0:
        for _ in range(len(offsets) - 1):
            yield np.zeros(0, np.uint64)
        return
    in_word = (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D))
    lower = np.where((raw >= 0x41) & (raw <= 0x5A), raw + np.uint8(32), raw)
    breaks = np.zeros(n + 1, bool)  # a text ends its last word
    breaks[offsets] = True
    starts = in_word.copy()
    starts[1:] &= ~in_word[:-1] | breaks[1:n]
    ends = in_word.copy()
    ends[:-1] &= ~in_word[1:] | breaks[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers.of(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[lower] * up, out=sums[1:])
    hashed = mix64((sums[ends] - sums[starts]) * down[starts])
    first = np.searchsorted(starts, offsets)
    if len(hashed) >= words:
        rolled = np.zeros(len(hashed) - words + 1, np.uint64)
        for k in range(words):
            rolled += hashed[k : len(hashed) - words + 1 + k] * PLACE[k]
        rolled = mix64(rolled)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            found = np.sort(rolled[a : b - words + 1])
            keep = np.empty(len(found), bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif b > a:
            yield mix64((hashed[a:b] * PLACE[8 : 8 + b - a]).sum(keepdims=True) + PLACE[40 + b - a])
        else:
            yield np.zeros(0, np.uint64)
