"""Words of a batch of texts as byte ranges, and 64-bit hashes of any ranges of their bytes.

Word characters are ASCII letters, digits and (if wanted) ``_``, as in ``\\w`` of the patterns; all other
bytes stand between words.  Work is over blocks of about a megabyte of text, or one text if longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_UP, _DOWN = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B)]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Spans:
    """Word k of all texts is ``data[low[k]:high[k]]``; text i has the words first[i]..first[i+1] and the bytes
    at[i]..at[i+1]."""

    def __init__(self, texts: pa.Array, underscore: bool = True):
        texts = texts.fill_null("").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        self.at = at - at[0]
        n = len(self.data)
        self.word = _WORD[self.data] if underscore else _WORD[self.data] & (self.data != 0x5F)
        edge = np.ones(n + 1, bool)  # edge[i]: no word goes on from i - 1 to i
        np.logical_not(self.word[:-1] & self.word[1:], out=edge[1:-1])
        edge[self.at] = True
        self.low = np.flatnonzero(self.word & edge[:-1])
        self.high = np.flatnonzero(self.word & edge[1:]) + 1
        self.first = np.searchsorted(self.low, self.at)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers(_UP, n), out=self._sums[1:])
        self._down = _powers(_DOWN, n + 1)

    def hashes(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each range of bytes; equal bytes give equal hashes wherever they stand."""
        h = (self._sums[high] - self._sums[low]) * self._down[low] + (high - low).astype(np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first byte, end) of every run of n words, with whatever stands between them."""
        counts = np.maximum(np.diff(self.first) - n + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        k = np.repeat(self.first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(len(text))
        return text, self.low[k], self.high[k + n - 1]


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``most`` bytes of text, or one row."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64)
    total, low = np.r_[0, np.cumsum(size)], 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(total, total[low] + most, "right")) - 1)
        yield low, min(high, len(texts))
        low = high
