"""Whole Arrow string columns as numpy byte buffers: words, pretokens and 64-bit hashes without a loop over rows.

Every function takes the UTF-8 bytes of many texts laid end to end (``data``) and the places where the
texts begin (``offsets``, one more than there are texts). Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
GOLDEN, MIX1, MIX2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)

#: Separators of words: space and U+0009 to U+000D.
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * MIX1
    x = (x ^ (x >> U64(27))) * MIX2
    return x ^ (x >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, body = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, offsets) of runs of rows with about ``limit`` bytes; a longer text comes alone."""
    data, offsets = utf8(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def span_hashes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight bytes at a step."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 8,), dtype="<u8", buffer=padded, strides=(1,))
    h = lens.astype(U64) * GOLDEN
    at, left, rows = starts, lens, None
    while len(at):
        word = eight[at] & _MASKS[np.minimum(left, 8)]
        if rows is None:
            h = mix(h ^ word)
        else:
            h[rows] = mix(h[rows] * GOLDEN ^ word)
        more = np.flatnonzero(left > 8)
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words, and for each text its first word's number (one more entry than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATORS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1 - starts, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k neighbours (also over the borders of texts); empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.full(n, U64(k))
    for j in range(k):
        h = h * GOLDEN + hashes[j : j + n]
    return mix(h)


def owners(ptr: np.ndarray) -> np.ndarray:
    """The text of each item, from the texts' first items."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def gram_rows(ptr: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k lie inside one text, by the number of their first item."""
    own = owners(ptr)
    n = len(own) - k + 1
    return np.flatnonzero(own[:n] == own[k - 1 :]) if n > 0 else np.zeros(0, np.int64)


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, laid end to end."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lens) - lens
    return np.arange(total) + np.repeat(starts - first, lens)
