"""Bytes of whole text columns in Arrow batches, and word hashes over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multiplier of the word hash; each byte has a fixed random symbol.
_ODD = 0x9E3779B97F4A7C15
_SYMBOL = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = {}
#: Bytes hashed at a time.
_BLOCK = 1 << 19


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each row's start, plus the end; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]] if body is not None and len(ends) else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def spans(ends: np.ndarray, limit: int):
    """Row ranges whose texts hold about ``limit`` bytes together (one row at least)."""
    at, n = 0, len(ends) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS.get("n", 0) < n:
        m = 1 << max(19, int(n).bit_length())
        for key, odd in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            p = np.full(m, odd, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
        _POWERS["n"] = m
    return _POWERS["up"], _POWERS["down"]


def word_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each row (rows + 1 values)."""
    word = ~_SPACE[data]
    left = np.empty(len(data), bool)
    left[:1] = True
    left[1:] = ~word[:-1]
    right = np.empty(len(data), bool)
    right[-1:] = True
    right[:-1] = ~word[1:]
    inner = ends[(ends > 0) & (ends < len(data))]
    left[inner] = True
    right[inner - 1] = True
    start = np.flatnonzero(word & left)
    stop = np.flatnonzero(word & right) + 1
    return start, stop, np.searchsorted(start, ends)


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z in lower case; it depends on the word's bytes only."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # a block of words at a time, so that the tables of powers stay small
        j = max(i + 1, int(np.searchsorted(stop, start[i] + _BLOCK, "right")))
        low, high = int(start[i]), int(stop[j - 1])
        up, down = _powers(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_SYMBOL[_LOWER[data[low:high]]] * up[: high - low], out=total[1:])
        out[i:j] = mix((total[stop[i:j] - low] - total[start[i:j] - low]) * down[start[i:j] - low])
        i = j
    return out
