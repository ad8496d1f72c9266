"""A set of offsets in the manner of Roaring bitmaps, made for select: the k-th smallest offset.

Offsets are split at their low 16 bits. The offsets that share their high bits are one container, in whichever
of three forms takes least room: a sorted array of 16-bit numbers, a bitmap of 65,536 bits, or runs of
consecutive numbers. Containers carry cumulative cardinalities: ``select`` finds the container by binary search
among them and then selects inside it. A bitmap and a run container have cumulative counts of their own, so no
select looks at more than a logarithm of the set.
"""

from __future__ import annotations

import numpy as np

ARRAY, BITMAP, RUNS = "array", "bitmap", "runs"
_WIDTH = 1 << 16
_WORDS = _WIDTH // 64


class _Array:
    form = ARRAY

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])

    def size(self) -> int:
        return 2 * len(self.low)


class _Bitmap:
    form = BITMAP

    def __init__(self, low: np.ndarray):
        bits = np.zeros(_WIDTH, dtype=bool)
        bits[low] = True
        self.words = np.packbits(bits, bitorder="little")
        self.before = np.concatenate([[0], np.cumsum(bits.reshape(_WORDS, 64).sum(axis=1))])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        own = np.flatnonzero(np.unpackbits(self.words[8 * word:8 * word + 8], bitorder="little"))
        return 64 * word + int(own[k - self.before[word]])

    def size(self) -> int:
        return len(self.words)


class _Runs:
    form = RUNS

    def __init__(self, low: np.ndarray):
        first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.start = low[first].astype(np.uint16)
        self.before = np.append(first, len(low))

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.start[run]) + k - int(self.before[run])

    def size(self) -> int:
        return 4 * len(self.start)


def _container(low: np.ndarray) -> _Array | _Bitmap | _Runs:
    n_runs = 1 + int(np.count_nonzero(np.diff(low) != 1))
    best = min((4 * n_runs, _Runs), (2 * len(low), _Array), (_WIDTH // 8, _Bitmap), key=lambda c: c[0])
    return best[1](low)


class BoundarySet:
    """An ascending array of distinct offsets (not negative)."""

    def __init__(self, offsets: np.ndarray):
        offsets = np.asarray(offsets, dtype=np.int64)
        high = offsets >> 16
        first = np.flatnonzero(np.diff(high, prepend=-1))
        stop = np.append(first[1:], len(offsets))
        self.high = high[first]
        self.before = np.append(first, len(offsets))  # cumulative cardinalities
        self.containers = [_container(offsets[a:b] & (_WIDTH - 1)) for a, b in zip(first.tolist(), stop.tolist())]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return (int(self.high[at]) << 16) + self.containers[at].select(k - int(self.before[at]))
