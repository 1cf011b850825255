"""Operators whose state depends on earlier picks, as Arrow-batched functions."""

from __future__ import annotations

from difflib import SequenceMatcher
from html import unescape as _unescape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity."""
    return SequenceMatcher(None, a, b).ratio()


def greedy_distinct(values: list[str], threshold: float = 0.8) -> list[str]:
    """Values in order, without those similar to one kept before."""
    kept: list[str] = []
    for v in values:
        if not any(ratio(v, k) > threshold for k in kept):
            kept.append(v)
    return kept


def _letters(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, counts): how often each of 64 classes of characters stands in each value."""
    size = np.array([len(v) for v in values], np.int64)
    codes = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32) & 63
    row = np.repeat(np.arange(len(values)), size)
    return size, np.bincount(row * 64 + codes, minlength=64 * len(values)).reshape(-1, 64).astype(np.int32)


def distinct_lists(lists: list[list[str]], threshold: float = 0.8, most_pairs: int = 1 << 17) -> tuple[list[list[str]], int]:
    """``greedy_distinct`` of each list, and how many pairs of values were really compared.

    Two values' similarity is at most 2 * common / total of their characters, whatever their order, and
    counting classes of characters only makes that bound larger.  The bounds of a whole batch's pairs are
    computed at once; the few that pass the threshold are compared, equal pairs of values once.
    """
    names: dict[str, int] = {}
    coded = [[names.setdefault(v, len(names)) for v in values] for values in lists]
    texts = list(names)
    size, counts = _letters(texts)
    alike: dict[tuple[int, int], bool] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    room = most_pairs

    def settle() -> None:
        later, earlier = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 2
        pair = np.unique(later * len(texts) + earlier)
        for low in range(0, len(pair), most_pairs):
            later, earlier = pair[low : low + most_pairs] // len(texts), pair[low : low + most_pairs] % len(texts)
            common = np.minimum(counts[later], counts[earlier]).sum(axis=1)
            total = size[later] + size[earlier]  # two empty values are equal
            near = (2.0 * common / np.maximum(1, total) > threshold - 1e-12) | (total == 0)
            for a, b in zip(later[near].tolist(), earlier[near].tolist()):
                if (a, b) not in alike:
                    alike[a, b] = a == b or ratio(texts[a], texts[b]) > threshold
        held.clear()

    for ids in coded:
        at = np.array(ids, np.int64)
        step = max(1, most_pairs // max(1, len(at)))
        for low in range(0, len(at), step):  # pairs of a long list in parts
            j, i = np.nonzero(np.arange(low, min(low + step, len(at)))[:, None] > np.arange(len(at))[None, :])
            held.append((at[low + j], at[i]))
            room -= len(j)
            if room <= 0:
                settle()
                room = most_pairs
    settle()
    out = []
    for ids in coded:
        kept: list[int] = []
        for a in ids:
            if not any(alike.get((a, b), False) for b in kept):
                kept.append(a)
        out.append([texts[a] for a in kept])
    return out, sum(a != b for a, b in alike)


def near_distinct(lists: Column | str) -> Column:
    def run(x: pd.Series) -> pd.Series:
        found, _ = distinct_lists([[] if v is None else [w for w in v if w is not None] for v in x])
        return pd.Series(found, index=x.index, dtype=object)

    return F.pandas_udf(run, "array<string>")(lists)


def similarity(a: Column | str, b: Column | str) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or w is None else ratio(v, w) for v, w in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def unescape(text: Column | str) -> Column:
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else _unescape(v))

    return F.pandas_udf(run, "string")(text)


def tagless_text(text: Column | str) -> Column:
    """Tags to spaces, entities decoded, no-break spaces and other white space collapsed: the text of
    a page without parsing it."""
    from tessera.functions.text import col, display

    return display(unescape(F.regexp_replace(F.coalesce(col(text), F.lit("")), "<[^>]+>", " ")))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def page_text(html: str | None) -> str:
    """All text of a page but scripts and styles, white space collapsed."""
    if not html:
        return ""
    parser = _Text()
    parser.feed(html)
    parser.close()
    return " ".join(" ".join(parser.parts).split())


def html_text(pages: Column | str) -> Column:
    def run(x: pd.Series) -> pd.Series:
        return x.map(page_text)

    return F.pandas_udf(run, "string")(pages)


def mmr(query: np.ndarray, candidates: np.ndarray, k: int, diversity: float = 0.8) -> list[int]:
    """Maximal marginal relevance: picks weigh likeness to the query against likeness to earlier picks; of
    equals, to 10 places, the first."""
    if not len(candidates):
        return []
    to_query = np.round(candidates @ query, 10)
    picked = [int(np.argmax(to_query))]
    near = candidates @ candidates[picked[0]]  # to the nearest picked one: linear in the candidates
    while len(picked) < min(k, len(candidates)):
        score = np.round((1 - diversity) * to_query - diversity * near, 10)
        score[picked] = -np.inf
        picked.append(int(np.argmax(score)))
        near = np.maximum(near, candidates @ candidates[picked[-1]])
    return picked
