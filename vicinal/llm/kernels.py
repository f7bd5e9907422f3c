"""Array kernels over UTF-8 bytes: word and shingle hashes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes worked on at once (a longer text is taken whole).
CHUNK = 1 << 18
_ODD, _SEED = U(0x9E3779B97F4A7C15), 20240607
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE = _BYTE[_LOWER]
_INVERSE = U(pow(int(_ODD), -1, 2**64))
_powers = (np.ones(1, U), np.ones(1, U))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, CHUNK)
        _powers = tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(n, m, U))]) for m in (_ODD, _INVERSE))
    return _powers


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its rows' offsets in them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``most`` bytes together, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of consecutive texts, and each text's first word's place, with the total last."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    b, at = data[lo:hi], offsets - lo
    n = len(b)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    space = _SPACE[b]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    up, down = _power_tables(n)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum(_BYTE[b] * up[:n], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts])
    return words, np.searchsorted(starts, at)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence; none without words."""
    for i, j in chunks(offsets):
        words, first = word_hashes(data, offsets[i : j + 1])
        m = len(words) - k + 1
        if m > 0:
            grams = words[:m].copy()
            for x in range(1, k):
                grams = mix(grams * _ODD + words[x : x + m])
        for r in range(j - i):
            a, z = int(first[r]), int(first[r + 1])
            if z - a >= k:
                yield np.unique(grams[a : z - k + 1])
            elif z > a:
                h = words[a : a + 1] + U(z - a)
                for x in range(a + 1, z):
                    h = mix(h * _ODD + words[x : x + 1])
                yield h
            else:
                yield np.zeros(0, U)
