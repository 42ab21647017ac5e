"""Ragged numpy views of text batches: words, Rabin-Karp hashes of words and of word windows.

Everything works on the UTF-8 bytes of an Arrow string column, so a batch of texts is
one ``uint8`` array plus row offsets. Batches are cut to a bounded number of bytes
(a single longer text forms a batch of its own).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 1 << 19

#: Byte classes of the contracts: words are maximal runs of the True bytes.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def row_slices(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice holds about ``max_bytes`` of ``column``."""
    for rb in batches:
        if not rb.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(rb.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(size) - size) // max_bytes
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), rb.num_rows]):
            yield rb.slice(a, b - a)
        pa.default_memory_pool().release_unused()  # workers live on between tasks


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls become empty rows."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Words(NamedTuple):
    """Word starts and ends (byte positions) and, per row, where its words begin."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # row i has the words first[i]..first[i+1]-1

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Maximal runs of word bytes that do not cross a row boundary."""
    n = len(data)
    mask = is_word[data]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    begins[inner] = mask[inner]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = mask[last]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(size, base, np.uint64))
            down = np.cumprod(np.full(size, pow(base, -1, 1 << 64), np.uint64))
        have = np.concatenate([[np.uint64(1)], up[:-1]]), np.concatenate([[np.uint64(1)], down[:-1]])
        if size <= 16 * BATCH_BYTES:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _rolling(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hashes (modulo 2**64) of values[start:end] from one prefix sum."""
    up, down = _power_table(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return (prefix[end] - prefix[start]) * down[start]


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    length = (w.end - w.start).astype(np.uint64)
    return mix(_rolling(data.astype(np.uint64) + np.uint64(1), w.start, w.end, _BYTE_BASE) + length * np.uint64(_WORD_BASE))


def window_hashes(hashes: np.ndarray, w: Words, size: int, short_rows: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` consecutive words of a row.

    Returns (hash, word index of the window's start, window offsets per row). With
    ``short_rows`` a row of 1..size-1 words gives one window of all its words.
    """
    n = w.per_row
    count = np.maximum(n - size + 1, 0)
    if short_rows:
        count = np.where((n > 0) & (n < size), 1, count)
    offsets = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    start = w.first[:-1][row] + (np.arange(offsets[-1]) - offsets[:-1][row])
    end = np.minimum(start + size, w.first[1:][row])
    h = mix(_rolling(hashes, start, end, _WORD_BASE) + (end - start).astype(np.uint64))
    return h, start, offsets
