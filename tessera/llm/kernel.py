"""Vectorised text primitives over Arrow string columns.

A column is taken in slices of bounded size (one long text may exceed it); a
slice is a byte array plus text offsets, and every primitive is a few numpy
passes over it. Hashes are 64-bit polynomials over random byte codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE = 1 << 18
_rng = np.random.Generator(np.random.PCG64(20240229))
CODES = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
LOWER_CODES = CODES.copy()
LOWER_CODES[65:91] = CODES[97:123]
BASES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
INVERSES = tuple(U(pow(int(b), -1, 2**64)) for b in BASES)
WINDOW = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(U) * U(2) + U(1)
WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads polynomial hashes over all 64 bits."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of a base and of its inverse, modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) <= n:
        size = max(n + n // 4 + 1, SLICE + 1)
        up, down = np.full(size, BASES[which], U), np.full(size, INVERSES[which], U)
        up[0] = down[0] = U(1)
        have = _powers[which] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def prefix(data: np.ndarray, codes: np.ndarray = CODES, which: int = 0) -> np.ndarray:
    """Prefix hashes: H[i] covers data[:i]."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(codes[data] * powers(len(data), which)[0][: len(data)], out=out[1:])
    return out


def spans_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the byte ranges [start, end), equal for equal ranges."""
    return mix((h[end] - h[start]) * powers(len(h), which)[1][start] + (end - start).astype(U))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and per text the number of words before it."""
    space = WS[data]
    brk = np.zeros(len(data) + 1, bool)
    brk[offsets] = True
    left = np.empty(len(data) + 1, bool)
    left[0], left[1:] = True, space
    right = np.empty(len(data) + 1, bool)
    right[-1], right[:-1] = True, space
    starts = np.flatnonzero(~space & (left[:-1] | brk[:-1]))
    ends = np.flatnonzero(~space & (right[1:] | brk[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def owners(bounds: np.ndarray) -> np.ndarray:
    """Of each item the text it belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows that stay in one text, and the first word of each."""
    if len(hashes) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    h = hashes[:m] * WINDOW[0]
    for k in range(1, n):
        h += hashes[k : k + m] * WINDOW[k]
    of = owners(bounds)
    at = np.flatnonzero(of[:m] == of[n - 1 :])
    return mix(h[at]), at


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags over each text's range."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys
