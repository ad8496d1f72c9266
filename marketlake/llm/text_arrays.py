"""Vectorised work on the UTF-8 bytes of an Arrow string column.

A batch is cut into slices of whole documents of at most ``SLICE_BYTES`` (a longer document
is a slice of its own), so that the arrays made from it stay small whatever the batch holds.
Word hashes are polynomials over the bytes, taken as differences of one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
#: Odd multipliers of the two polynomials.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[tuple[int, bool], np.ndarray] = {}

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data or b"", dtype=np.uint8), bounds


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def runs(kind: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of one nonzero ``kind`` inside one document;
    ``bounds`` are the documents' offsets, the first of them 0."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.empty(len(kind) + 1, dtype=bool)
    cut[0] = cut[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
    cut[bounds] = True
    edges = np.flatnonzero(cut)
    keep = kind[edges[:-1]] != 0
    return edges[:-1][keep], edges[1:][keep]


def _power(base: int, inverse: bool, n: int) -> np.ndarray:
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        step = np.full(max(n, SLICE_BYTES + 1), pow(base, -1, 1 << 64) if inverse else base, dtype=np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if n <= SLICE_BYTES + 1:
            _powers[(base, inverse)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: spreads the polynomials over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(base, False, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(base, True, len(data) + 1)[starts])


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the words ``[^\\x20\\x09-\\x0D]+``."""
    return runs((~SPACE[data]).view(np.uint8), bounds)


def single_spaced(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same words with one space between neighbours: (bytes, offsets)."""
    space = SPACE[data]
    keep = ~space
    keep[1:] |= keep[:-1]
    at = np.concatenate([[0], np.cumsum(keep)])
    return np.where(space, 0x20, data).astype(np.uint8)[keep], at[bounds]


def gram_hashes(word_hash: np.ndarray, n: int, base: int = BASES[1]) -> np.ndarray:
    """64-bit hash of every ``n`` consecutive words, by the place of the first; the last
    ``n - 1`` places are left out."""
    k = len(word_hash)
    if k < n:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(k + 1, dtype=np.uint64)
    np.cumsum(word_hash * _power(base, False, k), out=total[1:])
    return mix((total[n:] - total[:-n]) * _power(base, True, k)[:k - n + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x
