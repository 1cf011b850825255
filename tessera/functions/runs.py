"""Runs of words ranked by their likeness to a text, where vectors add up: no run has a vector of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Runs whose lengths are computed at once, and words whose products are.
RUN_ROWS = 1024


class Runs:
    """The distinct runs of 1 to 3 words of one text.

    ``words`` are the places of its words in a sorted list, ``known`` that list's vectors; ``dims`` and
    ``signs`` tell, for each gap between neighbours, where a run over it differs from its words' sum.
    All these are whole numbers (8-bit ones where every run's are), so that products are exact and equal
    likenesses are equal numbers, once rounded to 10 places.
    """

    def __init__(self, words: np.ndarray, known: np.ndarray, dims: np.ndarray, signs: np.ndarray):
        names, at = np.unique(words, return_inverse=True)
        m = len(names)
        two, first, pair = np.unique(at[:-1] * m + at[1:], return_index=True, return_inverse=True)
        three, place = np.unique(pair[:-1] * m + at[2:], return_index=True)
        self.known, self.dims, self.signs = known[names], dims[first].T.copy(), signs[first].T.copy()
        self.factor = self.known.astype(np.float64) if m <= RUN_ROWS else self.known  # else a block at a time
        a, b = two // m, two % m
        self.left, self.right, c = three // m, pair[place + 1], three % m
        self.names, self.m, self.pairs = names, m, len(two)
        self.parts = np.full((3, m + len(two) + len(three)), -1)
        self.parts[0, :m] = np.arange(m)
        self.parts[:2, m : m + len(two)] = a, b
        self.parts[:, m + len(two) :] = a[self.left], b[self.left], c
        self.over = self.known[b]  # a pair's last word, and the gap before it
        np.add.at(self.over.reshape(-1), (np.arange(len(two)) * known.shape[1] + self.dims).reshape(-1), self.signs.reshape(-1))
        self.two = self.known[a] + self.over
        size = np.sqrt(self._squares())
        self.size = np.where(size > 0, size, 1)

    def __len__(self) -> int:
        return self.parts.shape[1]

    def _blocks(self) -> Iterator[np.ndarray]:
        """The vectors of the runs, a block at a time."""
        for rows in (self.known, self.two):
            for low in range(0, len(rows), RUN_ROWS):
                yield rows[low : low + RUN_ROWS]
        for low in range(0, len(self.left), RUN_ROWS):
            yield self.two[self.left[low : low + RUN_ROWS]] + self.over[self.right[low : low + RUN_ROWS]]

    def _squares(self) -> np.ndarray:
        # of 8-bit numbers exact in 32-bit floats
        kind = np.float32 if self.known.dtype == np.int8 and self.known.shape[1] <= 1024 else np.float64
        return np.concatenate([np.einsum("ij,ij->i", v, v) for v in (block.astype(kind) for block in self._blocks())]).astype(np.float64)

    def vector(self, i: int) -> np.ndarray:
        at, last = i - self.m, i - self.m - self.pairs
        return (self.known[i] if at < 0 else self.two[at] if last < 0 else self.two[self.left[last]] + self.over[self.right[last]]).astype(np.float64)

    def likeness(self, to: np.ndarray) -> np.ndarray:
        """The cosine of each run and a vector of whole numbers."""
        one = np.concatenate([self.factor[low : low + RUN_ROWS] @ to for low in range(0, self.m, RUN_ROWS)])
        gap = np.zeros(self.pairs)
        for dims, signs in zip(self.dims, self.signs):
            gap += to[dims] * signs
        a, b, c = self.parts
        pairs, runs = slice(self.m, self.m + self.pairs), slice(self.m + self.pairs, None)
        two = one[a[pairs]] + one[b[pairs]] + gap
        product = np.concatenate([one, two, two[self.left] + one[c[runs]] + gap[self.right]])
        return np.round(product / self.size / (np.sqrt(to @ to) or 1), 10)

    def best(self, score: np.ndarray, n: int) -> np.ndarray:
        """The runs of the n highest scores; of equals the first by their strings."""
        least = score.max() if n == 1 else np.partition(score, -n)[-n] if n < len(score) else -np.inf
        at = np.flatnonzero(score >= least)
        if len(at) == 1:
            return at
        return at[np.lexsort((*self.parts[::-1, at], -score[at]))[:n]]

    def picked(self, to: np.ndarray, n: int, diversity: float) -> list[int]:
        """Runs picked by maximal marginal relevance, as ``fuzzy.mmr`` picks rows."""
        like = self.likeness(to)
        out, near = [int(self.best(like, 1)[0])], None
        while len(out) < min(n, len(self)):
            last = self.likeness(self.vector(out[-1]))
            near = last if near is None else np.maximum(near, last)
            score = np.round((1 - diversity) * like - diversity * near, 10)
            score[out] = -np.inf
            out.append(int(self.best(score, 1)[0]))
        return out

    def phrases(self, at: np.ndarray | list[int], names: list[str]) -> list[str]:
        """The runs as strings; ``names`` is the sorted list of words."""
        return [" ".join([names[w] for w in words if w >= 0]) for words in np.where(self.parts[:, at] < 0, -1, self.names[self.parts[:, at]]).T.tolist()]
