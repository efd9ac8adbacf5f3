"""Array kernels over the UTF-8 bytes of Arrow string columns.

A batch of texts is one byte array with row offsets. Words are found, hashed and
counted for all rows at once; nothing here loops over characters in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that one pass of the kernels takes; memory is a small multiple of it.
PASS_BYTES = 4 << 20
#: Longer words are hashed whole, so that the tables of powers stay of fixed size.
LONG_WORD = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and the offsets of the rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def passes(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together; a longer row goes alone, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses a row's border."""
    n = mask.size
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    borders = offsets[(offsets > 0) & (offsets < n)]
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    before[borders] = False
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    after[borders - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that every bit depends on every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
                size = max(n, LONG_WORD + 1)
                cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]))
                cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]))
        return cls.up, cls.down


def byte_values(fold: np.ndarray | None = None) -> np.ndarray:
    """A fixed random value for each byte; ``fold`` maps bytes that count as equal."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return values if fold is None else values[fold]


#: Maps A-Z to a-z and every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    long_words = np.flatnonzero(ends - starts > LONG_WORD)
    stops = iter([*long_words.tolist(), n])
    stop = next(stops)
    while i < n:
        if i == stop:
            word = values[buf[starts[i] : ends[i]]]
            out[i] = xxhash.xxh3_64_intdigest(word.tobytes())
            i, stop = i + 1, next(stops)
            continue
        a = int(starts[i])
        j = min(stop, max(i + 1, int(np.searchsorted(ends, a + LONG_WORD, "right"))))
        b = int(ends[j - 1])
        up, down = _Powers.of(b - a + 1)
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[buf[a:b]] * up[: b - a], out=sums[1:])
        s = starts[i:j] - a
        out[i:j] = (sums[ends[i:j] - a] - sums[s]) * down[s]
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64))


def grams(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes (rows' borders are the caller's)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    base = np.uint64(0xC2B2AE3D27D4EB4F + 2 * salt)
    for i in range(k):
        out *= base
        out += words[i : i + n]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, in about log2(w) passes."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def group_ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


#: Words of lower-cased text: digits, letters a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Words of unchanged text: all but space and the control characters 9 to 13.
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False
