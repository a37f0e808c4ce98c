"""Words and shingles of whole texts, a batch at a time.

Words are what stands between ASCII white space, A-Z in lower case. A word is
hashed over its UTF-8 bytes and a shingle over the hashes of its words, in
order, to 64 bits. Everything is done on the bytes of a whole Arrow batch at
once; texts never meet, as a word ends with its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte, upper and lower case alike, and a base of powers.
BYTES = mix((_LOWER + 1).astype(np.uint64) * _STEP)
BASE = 0xD1342543DE82EF95
_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(BASE, n), _powers(_INVERSE, n)


def tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    return _tables(1 << max(16, int(n).bit_length()))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each text starts and the last one ends; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in order, and how many words stand before each text's first (and in all)."""
    white = _WHITE[data]
    first = ~white
    first[1:] &= white[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] |= ~white[begins]
    starts = np.flatnonzero(first)
    last = ~white
    last[:-1] &= white[1:]
    finals = offsets[1:][offsets[1:] > 0] - 1
    last[finals] |= ~white[finals]
    ends = np.flatnonzero(last) + 1
    up, down = tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=total[1:])
    hashed = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)
    return hashed, np.searchsorted(starts, offsets)


def shingles(hashed: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle; a text with fewer words than ``width`` is one shingle."""
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    owner = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][owner]
    value = np.zeros(len(owner), dtype=np.uint64)
    length = np.minimum(counts, width)[owner]
    for k in range(width):
        there = length > k
        value[there] = mix(value[there] * np.uint64(BASE) + hashed[at[there] + k] + np.uint64(k + 1))
    return value, owner


def _distinct(value: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.searchsorted(owner, np.arange(n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        value[a:b].sort()
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.searchsorted(owner[fresh], np.arange(n + 1))


def parts(column: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``size`` bytes together: number of the first, bytes, offsets.

    Keeps what is in memory at once near ``size``, or the longest text.
    """
    data, offsets = buffers(column)
    at = 0
    while at < len(column):
        after = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, data[offsets[at] : offsets[after]], offsets[at : after + 1] - offsets[at]
        at = after


def sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per run of texts: number of the first, the texts' distinct shingles, each text's sorted, and their bounds."""
    for at, data, offsets in parts(column):
        value, owner = shingles(*words(data, offsets), width)
        yield at, *_distinct(value, owner, len(offsets) - 1)
