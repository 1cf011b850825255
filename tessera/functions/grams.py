"""Runs of words of whole batches of texts, as Arrow functions over lists of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of the lists worked on at once, or one list if longer.
BLOCK_WORDS = 1 << 18


def spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of neighbours whose sizes add up to ``most`` or less, or of one that is larger."""
    total = np.r_[0, np.cumsum(sizes)]
    low = 0
    while low < len(sizes):
        high = min(len(sizes), max(low + 1, int(np.searchsorted(total, total[low] + most, "right")) - 1))
        yield low, high
        low = high


def blocks(lists: pa.Array, most: int = BLOCK_WORDS) -> Iterator[pa.Array]:
    """Slices of lists that hold at most ``most`` words, or one list."""
    for low, high in spans(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64), most):
        yield lists.slice(low, high - low)


def _runs(lists: pa.Array, n: int) -> tuple[pa.Array, np.ndarray]:
    """(phrase, list) of every run of n words."""
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    words = lists.flatten()
    have = np.maximum(size - n + 1, 0)
    row = np.repeat(np.arange(len(size)), have)
    at = np.repeat(np.cumsum(size) - size - (np.cumsum(have) - have), have) + np.arange(len(row))
    parts = [words.take(pa.array(at + k)) for k in range(n)]
    return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " "), row


def distinct_ngrams(lists: pa.Array, low: int, high: int) -> pa.Array:
    """The distinct n-grams of each list, sorted by code points; a null list has none."""
    out = []
    for part in blocks(lists):
        found = [_runs(part, n) for n in range(low, high + 1)]
        phrase = pa.concat_arrays([p.cast(pa.string()) for p, _ in found]).dictionary_encode()
        order = np.asarray(pc.sort_indices(phrase.dictionary))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        row = np.concatenate([r for _, r in found])
        key = np.unique(row * max(1, len(order)) + place[np.asarray(phrase.indices)])
        row = key // max(1, len(order))
        at = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(at), phrase.dictionary.take(pa.array(order[key % max(1, len(order))]))))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))


def counted(lists: pa.Array, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """(phrase, freq, docs) of the n-grams of each block of lists: how often they occur, and in how many."""
    for part in blocks(lists):
        for n in range(low, high + 1):
            phrase, row = _runs(part, n)
            phrase = phrase.cast(pa.string()).dictionary_encode()
            at = np.asarray(phrase.indices).astype(np.int64)
            size = len(phrase.dictionary)
            docs = np.bincount(np.unique(row * max(1, size) + at) % max(1, size), minlength=size)
            yield pa.RecordBatch.from_arrays([phrase.dictionary, pa.array(np.bincount(at, minlength=size)), pa.array(docs)], ["phrase", "freq", "docs"])
