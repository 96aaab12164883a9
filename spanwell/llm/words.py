"""Vectorised word kernels over UTF-8 bytes, for Arrow batches of texts.

A word is a maximal run of bytes other than space and \\x09-\\x0D, which all are
single bytes in UTF-8.  The words of a slice are gathered in an Arrow dictionary,
and each distinct one is hashed by SipHash under a fixed key, so equal hashes are
no property of a word's form.  Hashes of word sequences are combined pairwise by
doubling, with a mixing step between, never by a polynomial.  Batches are handled
in slices of about ``SLICE`` bytes; a longer text is a slice of its own and is
handled whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa

SLICE = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Keys of the word hashes: 0 and 1 are independent of each other.
KEYS = ("spanwell words 1", "spanwell words 2", "spanwell words 3", "spanwell words 4")
_LEVEL = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 3) & (1 << 64) - 1) for i in range(64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _no_trim() -> None:
    """Other C libraries have no such call."""


try:
    _libc = ctypes.CDLL("libc.so.6")

    def _trim() -> None:
        """Freed memory goes back to the system: workers live on between stages."""
        _libc.malloc_trim(0)

except (OSError, AttributeError):
    _trim = _no_trim


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty.  Called once a batch, it hands back what earlier batches left unused."""
    pa.default_memory_pool().release_unused()
    _trim()
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes come to about ``size``."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


#: What parts tokens for counting models: every ASCII byte that is no letter or digit.
PUNCT = np.ones(256, bool)
PUNCT[128:] = False
PUNCT[48:58] = PUNCT[65:91] = PUNCT[97:123] = False


def spans(data: np.ndarray, offs: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row offsets into them) of the words of all rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~parts[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | cut[1:-1]
    finish = word.copy()
    finish[:-1] &= ~word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offs)


class Words:
    """The words of a slice: ``starts``, ``ends``, row offsets ``rows``, and each word's place ``code`` among the distinct ones."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, parts: np.ndarray = SPACE, lower: bool = False):
        self.starts, self.ends, self.rows = spans(data, offs, parts)
        place = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=place[1:])
        kept = data[~parts[data]]
        kept = LOWER[kept] if lower else kept
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(place), pa.py_buffer(kept)])
        self._coded = column.dictionary_encode()
        self.code = self._coded.indices.to_numpy()

    @cached_property
    def distinct(self) -> np.ndarray:
        return self._coded.dictionary.to_numpy(zero_copy_only=False)

    def hash(self, key: int = 0, most: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first ``most`` bytes."""
        if not len(self.code):
            return np.zeros(0, np.uint64)
        words = self.distinct if most is None else np.array([x[:most] for x in self.distinct], dtype=object)
        return pd.util.hash_array(words, hash_key=KEYS[key], categorize=False)[self.code]


def window_hashes(w: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` consecutive word hashes (rows run on; the caller drops windows across rows).

    Windows of 2n words combine two of n; those of ``length`` combine the powers of two that make it up.
    """
    n = len(w) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, level = None, 0, w
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            part = level[done : done + n]
            out = part if out is None else mix64(out ^ _LEVEL[bit + 20]) + part
            done += 1 << bit
        if length >> (bit + 1):
            level = mix64(level[: -(1 << bit)] ^ _LEVEL[bit]) + level[1 << bit :]
    return mix64(out ^ _LEVEL[40] + np.uint64(length))


def row_windows(woffs: np.ndarray, length: int) -> np.ndarray:
    """Number of windows of ``length`` in each row."""
    return np.maximum(np.diff(woffs) - length + 1, 0)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + counts[i] - 1."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return first + np.arange(total)


def long_bytes(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark longs."""
    return x.view(np.int64)


def list_array(values: np.ndarray, offs: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values, kind))
