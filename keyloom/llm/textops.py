"""Whole Arrow text columns as numpy arrays: words, hashes, shingles.

Texts are handled as UTF-8 bytes laid end to end with document offsets, so that
one vectorised pass serves thousands of documents.  Nothing here looks beyond one
document at a time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
#: Bytes of text whose shingles are made at once; a pass keeps some 30 bytes for each.
SHINGLE_BYTES = 1 << 19

#: A group of fewer bytes isn't worth a call of give_back.
GROUP_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on and would hold it through all later stages."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def lean(run: Callable) -> Callable:
    """A function on batches for mapInArrow that gives its memory back after each batch and at its end."""

    def each(batches):
        for b in batches:
            yield b
            del b
            give_back()

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(each(batches))
        finally:
            give_back()

    return wrapped


def lean_group(run: Callable) -> Callable:
    """A function on a group for applyInArrow that gives its memory back at its end."""

    @wraps(run)
    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes >= GROUP_BYTES:
            give_back()
        return out

    return wrapped


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = -(-n // (1 << 18)) * (1 << 18) + 64
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 2 * CHUNK_BYTES + 64:
            _powers[int(base)] = have
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    text = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.empty(0, np.uint8)
    return at - (at[0] if len(at) else 0), text


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def parts(text: np.ndarray, first: int, last: int, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of one text of about ``limit`` bytes, cut at spaces; without any, between characters."""
    while last - first > 2 * limit:
        end = first + limit
        space = np.flatnonzero(_IS_SPACE[text[end : end + limit]])
        end += int(space[0]) if len(space) else 0
        while text[end] & 0xC0 == 0x80:
            end -= 1
        yield int(first), int(end)
        first = end
    yield int(first), int(last)


def lowered(text: np.ndarray) -> np.ndarray:
    return _LOWER[text]


def words(offsets: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every maximal run of non-space bytes of each document."""
    n = len(text)
    if not n:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    solid = ~_IS_SPACE[text]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begin[inner] = solid[inner]
    stop[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def prefix_hash(text: np.ndarray, which: int = 0) -> np.ndarray:
    """Running polynomial sums over the bytes; a range's hash is a difference of two.

    ``which`` of two: their hashes are independent of each other.
    """
    return running(_BYTE[which][text])


def running(values: np.ndarray) -> np.ndarray:
    """``prefix_hash`` of any sequence of 64-bit values."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(_B, len(values)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end) of each range."""
    h = (sums[end] - sums[start]) * _power(_B_INV, len(sums))[start]
    return mix64(h ^ (end - start).astype(np.uint64))


def window_hash(word: np.ndarray, size: int) -> np.ndarray:
    """Order-dependent hash of every run of ``size`` neighbouring word hashes."""
    n = len(word) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = word[:n].copy()
    for k in range(1, size):
        h *= _B
        h ^= word[k : k + n]
        h = mix64(h)
    return h


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingle hashes) of each text, A-Z lower-cased.

    A text with words but fewer than ``size`` has its whole sequence as one
    shingle; one without words has none.
    """
    offsets, text = buffers(column)
    for i, j in chunks(offsets, SHINGLE_BYTES):
        at = offsets[i : j + 1] - offsets[i]
        part = lowered(text[offsets[i] : offsets[j]])
        start, end, doc = words(at, part)
        word = range_hash(prefix_hash(part), start, end)
        runs = window_hash(word, size)
        edge = np.searchsorted(doc, np.arange(j - i + 1))
        for d in range(j - i):
            a, b = edge[d], edge[d + 1]
            if b - a >= size:
                yield i + d, np.unique(runs[a : b - size + 1])
            elif b > a:
                h = np.array([b - a], dtype=np.uint64)
                for k in range(a, b):
                    h = mix64(h * _B ^ word[k])
                yield i + d, h
            else:
                yield i + d, np.empty(0, np.uint64)
