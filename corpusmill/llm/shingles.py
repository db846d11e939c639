"""Hashed word shingles of many texts at once, on the bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the ``len + 1`` offsets of its values; NULL is empty."""
    wide = column.cast(pa.large_string())
    if wide.null_count:
        wide = wide.fill_null("")
    _, offsets, data = wide.buffers()
    bounds = np.frombuffer(offsets, np.int64)[wide.offset:wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def pieces(bounds: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of values of about ``most`` bytes together; a longer value is a range of its own."""
    first = 0
    while first < len(bounds) - 1:
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        yield first, end
        first = end


def lowered(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of every word (run of anything but ASCII white space)."""
    n = len(raw)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=total[1:])
    back = powers(inverse(_BASE), n)
    return mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64)), start, end


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words of each value."""
    hashes, start, _ = word_spans(raw, bounds)
    return hashes, np.searchsorted(start, bounds[1:]) - np.searchsorted(start, bounds[:-1])


def word_arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The hashes of the words of every value, letters A-Z lower-cased, in order of the values."""
    raw, bounds = string_bytes(column)
    for first, end in pieces(bounds):
        own = bounds[first:end + 1]
        hashes, counts = word_hashes(lowered(raw[own[0]:own[-1]]), own - own[0])
        yield from np.split(hashes, np.cumsum(counts)[:-1])


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct ``k``-word shingles of every value, as 64-bit hashes, in order of the values.

    Letters A-Z are lower-cased. A value of fewer words is one shingle, one without words has none.
    """
    raw, bounds = string_bytes(column)
    for first, end in pieces(bounds):
        own = bounds[first:end + 1]
        hashes, counts = word_hashes(lowered(raw[own[0]:own[-1]]), own - own[0])
        at = np.concatenate([[0], np.cumsum(counts)])
        rolled = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
        for j in range(k):
            rolled = rolled * _STEP + hashes[j:len(rolled) + j]
        rolled = mixed(rolled)
        for a, n in zip(at[:-1].tolist(), counts.tolist(), strict=True):
            if n >= k:
                yield np.unique(rolled[a:a + n - k + 1])
            elif n:
                short = np.zeros(1, np.uint64)
                for x in hashes[a:a + n]:
                    short = short * _STEP + x
                yield mixed(short + np.uint64(n))
            else:
                yield np.empty(0, np.uint64)
