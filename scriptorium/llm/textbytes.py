"""Whole texts of an Arrow batch as one byte array, and hashes of their words, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once, some hundred bytes of memory each; a longer text is handled alone.
SLICE = 1 << 18


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows; nulls are empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = splitmix((np.arange(1, 257, dtype=np.uint64)) * _STEP)


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and the count of words before each text (n + 1 numbers).

    gap: 256 booleans, true for the bytes between words. Letters A-Z are taken as a-z. With prefixes the hashes
    have a column for the word and one for each length of prefix in bytes (0: the word is no longer than that).
    """
    if not len(data):
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~gap[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(len(data), dtype=np.int64)
    place[: starts[0]] = 0
    place[starts[0] :] -= np.repeat(starts, np.diff(starts, append=len(data)))
    powers = np.cumprod(np.full(int(place.max()) + 1, _STEP | np.uint64(1)))
    value = _LOWER_BYTE[data]
    value *= powers[place]
    value *= inside
    before = np.searchsorted(starts, offsets)
    if not prefixes:
        return splitmix(np.add.reduceat(value, starts)), before
    size = np.add.reduceat(inside, starts, dtype=np.int64)
    columns = [splitmix(np.add.reduceat(value, starts))]
    for k in sorted(prefixes, reverse=True):
        value[place >= k] = 0
        columns.insert(1, np.where(size > k, splitmix(np.add.reduceat(value, starts) + np.array([k], np.uint64) * _STEP), np.uint64(0)))
    return np.stack(columns, axis=1), before


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTE = _BYTE[_LOWER]


def word_hash(word: str) -> int:
    """The hash that `words` gives a single word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(words(data, np.array([0, len(data)]), np.zeros(256, bool))[0][0])
