"""Vectorised text kernels for Arrow functions: words of many texts at once, as byte ranges and hashes.

Words are runs of bytes outside ``\\x20 \\x09-\\x0D`` (exact on UTF-8: these bytes never occur inside a
character).  All work is done over blocks of at most ``BLOCK_BYTES`` of text, or one text if longer,
so memory is bounded by the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space, and with it ASCII punctuation: what words may be cut at.
SPACE = _IS_SPACE
PUNCTUATION = _IS_SPACE.copy()
PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?[\\]^_`{|}~")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SAME = np.arange(256, dtype=np.uint8)

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, key: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(key)
    if have is None or len(have) < n:
        step = np.full(max(n, BLOCK_BYTES + 1), base, _U)
        step[0] = 1
        have = _powers[key] = np.multiply.accumulate(step)
    return have[:n]


def release() -> None:
    """Hands freed memory back to the system, as long-lived workers and drivers keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over uint64 (the splitmix64 steps): every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their int64 offsets; a null counts as an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding at most ``most`` bytes of text, or one row if that is longer."""
    _, at = text_bytes(column)
    low, n = 0, len(at) - 1
    while low < n:
        high = int(np.searchsorted(at, at[low] + most, "right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


@dataclass
class Words:
    """Words of a block: ``data[at[k]:at[k+1]]`` is word k; text i has the words first[i]..first[i+1]."""

    data: np.ndarray
    at: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def arrow(self) -> pa.Array:
        return pa.LargeStringArray.from_buffers(len(self), pa.py_buffer(self.at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.data)))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self):
            return np.zeros(0, _U)
        n = len(self.data)
        prefix = np.zeros(n + 1, _U)
        np.cumsum((self.data.astype(_U) + _U(1)) * _power(_BASE, n, "up"), out=prefix[1:])
        low, high = self.at[:-1], self.at[1:]
        h = (prefix[high] - prefix[low]) * _power(_BASE_INV, n, "down")[low]
        return mix(h + (high - low).astype(_U))


def words(column: pa.Array, lower: bool = True, space: np.ndarray = SPACE) -> Words:
    """The words of each text, cut at the bytes of ``space``; ``lower`` maps A-Z only."""
    data, offsets = text_bytes(column)
    n = len(data)
    if not n:
        return Words(data, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64))
    dark = ~space[data]
    edge = np.ones(n + 1, bool)  # edge[i]: no word goes on from i-1 to i
    np.logical_not(dark[:-1] & dark[1:], out=edge[1:-1])
    edge[offsets] = True
    starts = np.flatnonzero(dark & edge[:-1])
    ends = np.flatnonzero(dark & edge[1:]) + 1
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    return Words((_LOWER if lower else _SAME)[data[dark]], at, np.searchsorted(starts, offsets))


def ngrams(h: np.ndarray, first: np.ndarray, n: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of n words; with ``whole``, a text of 0 to n-1 words gives one hash of all of it."""
    counts = np.diff(first)
    have = np.maximum(counts - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), have)
    begin = np.repeat(first[:-1], have) + (np.arange(int(have.sum())) - np.repeat(np.cumsum(have) - have, have))
    out = np.full(len(begin), n, _U)
    for k in range(n):
        out = mix(out * _BASE + h[begin + k]) if k == n - 1 else out * _BASE + h[begin + k]
    if whole and (counts < n).any():
        short = np.flatnonzero(counts < n)
        extra = np.zeros(len(short), _U)
        for j, i in enumerate(short):
            x = int(counts[i])
            for v in h[first[i] : first[i + 1]]:
                x = (x * int(_BASE) + int(v)) % (1 << 64)
            extra[j] = x
        out, text = np.concatenate([out, mix(extra)]), np.concatenate([text, short])
    return out, text


def as_text(array: pa.Array) -> pa.Array:
    return array.cast(pa.string()) if array.type != pa.string() else array
