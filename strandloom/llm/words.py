"""Vectorised word hashes over Arrow text columns.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  All separators are single
ASCII bytes, which never occur inside a multi-byte UTF-8 character, so the work is done on the
bytes.  A word's hash is a polynomial over the wrapping 64-bit integers, taken from prefix sums,
then mixed; two different words share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text is a piece of its own.
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, BLOCK + 1)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
                      for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def forget_powers() -> None:
    """Drops powers that only an uncommonly long text needed."""
    if _powers and len(_powers[0]) > BLOCK + 1:
        _powers.clear()


def text_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets in them) of pieces of about BLOCK bytes.

    A null text counts as an empty one.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        yield at, to, raw[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def block_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a block, and where its words start and end in them."""
    low = _LOWER[raw]
    word = ~_GAP[low]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    return low, np.flatnonzero(word & (~before | edge[:-1])), np.flatnonzero(word & (~after | edge[1:])) + 1


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(low))
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:len(low)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def block_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block in order, and for each row where its words start (n + 1)."""
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    low, starts, ends = block_spans(raw, offsets)
    return span_hashes(low, starts, ends), np.searchsorted(starts, offsets)
