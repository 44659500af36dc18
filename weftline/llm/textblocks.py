"""Vectorised hashing of words and word shingles over Arrow string columns.

All functions work on bounded blocks of bytes, so a worker's memory does not grow with
the length of a batch; only the word hashes of the text at hand are kept (8 bytes a word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_EMPTY = np.empty(0, np.uint64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block, and where they start. starts: where texts begin."""
    n = len(data)
    if not n:
        return _EMPTY, np.empty(0, np.int64)
    gap = _SPACE[data]
    first, last = ~gap, ~gap
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    edge[n] = True
    first[1:] &= gap[:-1] | edge[1:n]
    last[:-1] &= gap[1:] | edge[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _POWERS.get(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64)), begin


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text that is longer than a block, cut at white space."""
    out, at, n = [], 0, len(data)
    while at < n:
        stop = min(n, at + BLOCK)
        while stop < n:
            gaps = np.flatnonzero(_SPACE[data[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
                break
            stop = min(n, stop + BLOCK)
        out.append(_words(data[at:stop], np.zeros(1, np.int64))[0])
        at = stop
    return np.concatenate(out) if out else _EMPTY


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def word_hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text in turn, A-Z lower-cased, words split at white space."""
    data, offsets = utf8(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1
        if j <= i:
            yield _long_words(data[offsets[i] : offsets[i + 1]])
            i += 1
            continue
        j = min(j, n)
        base = offsets[i : j + 1] - offsets[i]
        hashes, begin = _words(data[offsets[i] : offsets[j]], base[:-1][base[:-1] < base[-1]])
        cuts = np.searchsorted(begin, base)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield hashes[a:b]
        i = j


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """One hash for each run of k words; with fewer words the whole run is one shingle."""
    n = len(words)
    if not n:
        return _EMPTY
    width = min(k, n)
    out = words[: n - width + 1].copy()
    for j in range(1, width):
        out *= _STEP
        out += words[j : n - width + 1 + j]
    return mix(out + np.uint64(width))


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """The distinct shingles, ascending."""
    return np.unique(shingles(words, k))
