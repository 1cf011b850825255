"""Benchmark decontamination (operator 2): rare n-gram seeds, then Smith-Waterman alignment scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel, work

#: Words of a seed; words of benchmark items in one pass over the texts (broadcast: 8 bytes each).
SEED_WORDS, BLOCK_WORDS = 4, 1 << 20
#: An n-gram in more texts than this many times the item's median n-gram is a common phrase: texts that
#: hold no rarer one are aligned only if they have enough of the item's words at all.
RARE = 4
#: Smith-Waterman scores, and the share of an item's best possible score that marks a leak.
MATCH, MISMATCH, GAP = 2, -1, -1
LEAK = 0.5
#: Bits of the filter that most n-grams of a text stop at.
FILTER_BITS = 24
#: Ids of leaking texts up to which they are broadcast (about 20 bytes each).
BROADCAST_ROWS = 500_000
#: Pairs aligned at once.
ALIGN_BATCH = 256

_U = np.uint64


@dataclass
class Items:
    """A block of benchmark items: their words as hashes, and every n-gram of each."""

    ids: list
    words: list[np.ndarray]
    seed: np.ndarray  # distinct n-gram hashes, sorted
    first: np.ndarray  # n-gram i belongs to the items holder[first[i]:first[i+1]]
    holder: np.ndarray

    @property
    def longest(self) -> int:
        return max((len(w) for w in self.words), default=0)


def item_block(ids: list, texts: list[str | None], n: int = SEED_WORDS) -> Items:
    """Items of no words have no seeds; items of fewer words than a seed are a seed as a whole."""
    w = kernel.words(pa.array(texts, pa.string()), space=kernel.PUNCTUATION)
    h = w.hashes()
    words = [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
    gram, item = kernel.ngrams(h, w.first, n)
    short = [i for i, x in enumerate(words) if 0 < len(x) < n]
    for i in short:
        g, _ = kernel.ngrams(words[i], np.array([0, len(words[i])]), len(words[i]))
        gram, item = np.r_[gram, g], np.r_[item, i]
    pair = np.unique(np.rec.fromarrays([gram, item.astype(np.int64)]))
    seed, start = np.unique(pair["f0"], return_index=True)
    return Items(ids, words, seed, np.r_[start, len(pair)], pair["f1"])


def short_lengths(items: Items, n: int) -> list[int]:
    return sorted({len(w) for w in items.words if 0 < len(w) < n})


def find(h: np.ndarray, first: np.ndarray, items: Items, sizes: list[int], bloom: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, seed number) of every seed in a block of texts, in order of text and place."""
    found = []
    for n in sizes:
        gram, text = kernel.ngrams(h, first, n)
        if not len(gram):
            continue
        maybe = np.flatnonzero(bloom[(gram >> _U(64 - FILTER_BITS)).astype(np.int64)])
        at = np.searchsorted(items.seed, gram[maybe])
        ok = items.seed[np.minimum(at, len(items.seed) - 1)] == gram[maybe]
        maybe, at = maybe[ok], at[ok]
        begin = np.searchsorted(text, text[maybe])
        found.append((text[maybe], maybe - begin, at))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    text, place, at = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((at, place, text))
    return text[order], place[order], at[order]


def align(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman over many pairs at once: best local score of a[i] in b[i] with linear gaps, and
    the range of b that it covers."""
    n, la, lb = len(a), max(map(len, a)), max(map(len, b))
    x, y = np.zeros((n, la), _U), np.zeros((n, lb), _U)
    for i in range(n):
        x[i, : len(a[i])] = a[i]
        y[i, : len(b[i])] = b[i]
    sizes_a, sizes_b = np.array([len(v) for v in a]), np.array([len(v) for v in b])
    inside = np.arange(lb)[None, :] < sizes_b[:, None]
    score, start = np.zeros((n, lb + 1), np.int32), np.zeros((n, lb + 1), np.int32)
    start[:] = np.arange(lb + 1)
    best, low, high = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    steps = np.arange(lb + 1) * -GAP
    for j in range(la):
        fit = np.where((x[:, j, None] == y) & inside, MATCH, MISMATCH).astype(np.int32)
        diagonal, above = score[:, :-1] + fit, score[:, 1:] + GAP
        new = np.zeros_like(score)
        begin = np.empty_like(start)
        begin[:] = np.arange(lb + 1)
        up = above > diagonal
        new[:, 1:] = np.where(up, above, diagonal)
        begin[:, 1:] = np.where(up, start[:, 1:], start[:, :-1])
        dead = new <= 0
        new[dead] = 0
        begin[dead] = np.broadcast_to(np.arange(lb + 1), begin.shape)[dead]
        # gaps along b: the best of new[k] + GAP * (column - k) for k up to the column
        lifted = new + steps
        top = np.maximum.accumulate(lifted, axis=1)
        where = np.maximum.accumulate(np.where(lifted == top, np.arange(lb + 1), 0), axis=1)
        new = top - steps
        begin = np.take_along_axis(begin, where, axis=1)
        live = (j < sizes_a)[:, None]
        score, start = np.where(live, new, score), np.where(live, begin, start)
        column = score[:, 1:].argmax(axis=1) + 1
        value = score[np.arange(n), column]
        better = (value > best) & live[:, 0]
        best[better], high[better] = value[better], column[better]
        low[better] = start[np.arange(n), column][better]
    return best, low, high


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = LEAK, seed_words: int = SEED_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, item, score, begin, end): a row for each text and benchmark item found in it.

    Seeds are an item's n-grams.  A text that holds one is aligned around it with the item, at once if
    one of them is rare (see ``rare_pairs``), else if the words it shares with the item can reach
    ``threshold``, which loses nothing; ``score`` is the Smith-Waterman score over the best possible for
    the item, a leak from ``threshold``; ``begin`` and ``end`` are word places of the best match.

    Null or empty texts and items match nothing.  Repeated items each give a row under their own id,
    repeated texts each give rows; ids may be null.  Other columns are not read.  The benchmark is
    worked off in blocks of at most about ``block_words`` words, each one pass over all texts, so what
    is broadcast is bounded.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("words"))
    total = items.agg(F.sum(F.length("words"))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // (2 * block_words)))

    def found(block: DataFrame) -> DataFrame:
        rows = block.toArrow()
        return _pass(docs, item_block(rows["item"].to_pylist(), rows["words"].to_pylist(), seed_words), id_col, text_col, threshold, seed_words)

    if n_blocks == 1:
        out = found(items)
    else:  # a pass adds to one table, so no plan grows with the benchmark
        path = work.new_path(docs.sparkSession, "found")
        for b in range(n_blocks):
            with work.scratch():
                part = found(items.where(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == b))
                part.write.mode("append").parquet(path)
        out = docs.sparkSession.read.schema(part.schema).parquet(path)
    kind = benchmark.schema[item_col].dataType
    return out.select(F.col("id").alias(id_col), F.col("item").cast(kind).alias(item_col), "score", "begin", "end")


def _pass(docs: DataFrame, items: Items, id_col: str, text_col: str, threshold: float, n: int) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    sizes = sorted({n, *short_lengths(items, n)})
    sent = spark.sparkContext.broadcast(items)
    margin = items.longest

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        if not len(items.seed):
            return
        bloom = np.zeros(1 << FILTER_BITS, bool)
        bloom[(items.seed >> _U(64 - FILTER_BITS)).astype(np.int64)] = True
        number = TaskContext.get().partitionId() << 40  # fixed from the written table on
        for batch in batches:
            for a, b in kernel.blocks(batch.column(1)):
                w = kernel.words(batch.column(1).slice(a, b - a), space=kernel.PUNCTUATION)
                h = w.hashes()
                text, place, seed = find(h, w.first, items, sizes, bloom)
                number += b - a
                if not len(text):
                    continue
                cut = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (place[1:] - place[:-1] > 2 * margin)])
                last = np.r_[cut[1:], len(text)] - 1
                low = np.maximum(place[cut] - margin, 0)
                high = np.minimum(place[last] + n + margin, w.counts()[text[cut]])
                base = w.first[text[cut]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(text[cut] + a)),
                        pa.array(number - text[cut]),
                        pa.array(low),
                        pa.array([h[i + l : i + r].view(np.int64) for i, l, r in zip(base, low, high)], pa.list_(pa.int64())),
                        pa.array([seed[i : j + 1].astype(np.int32) for i, j in zip(cut, last)], pa.list_(pa.int32())),
                        pa.array([(place[i : j + 1] - l).astype(np.int32) for i, j, l in zip(cut, last, low)], pa.list_(pa.int32())),
                    ],
                    ["id", "text_no", "low", "words", "seeds", "places"],
                )
            kernel.release()

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).mapInArrow(windows, f"id {kind}, text_no bigint, low bigint, words array<bigint>, seeds array<int>, places array<int>")
    found = work.written(found, "windows")
    # texts that hold each seed: a table no longer than the block's n-grams
    held = found.select(F.explode(F.array_distinct("seeds")).alias("seed")).groupBy("seed").count().toArrow()
    often = np.zeros(len(items.seed), np.int64)
    if held.num_rows:
        often[np.asarray(held["seed"].combine_chunks())] = np.asarray(held["count"].combine_chunks())
    rare = spark.sparkContext.broadcast(rare_pairs(items, often))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, is_rare = sent.value, rare.value
        for batch in batches:
            words, seeds, places = batch.column(3), batch.column(4), batch.column(5)
            pending: list[tuple[int, int, int, int]] = []
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                size = len(words[i])
                text = np.asarray(words[i].values).view(_U)
                for item, at, sure in candidates(np.asarray(seeds[i].values), np.asarray(places[i].values), items, is_rare):
                    own = items.words[item]
                    for lo, hi in spans(at, len(own), size):
                        if sure[(at >= lo) & (at < hi)].any() or shared_words(own, text[lo:hi]) >= threshold * len(own):
                            pending.append((i, item, lo, hi))
                if len(pending) >= ALIGN_BATCH or i + 1 == batch.num_rows:
                    rows += _aligned(pending, words, batch.column(2), items)
                    pending = []
            rows = [r for r in rows if r[2] >= threshold]
            if rows:
                at, item, value, begin, end = zip(*rows)
                at = pa.array(at)
                name = pa.array([None if items.ids[j] is None else str(items.ids[j]) for j in item], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(item, pa.int64()), name, pa.array(value), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["id", "text_no", "item_no", "item", "score", "begin", "end"])

    scored = found.mapInArrow(score, f"id {kind}, text_no bigint, item_no bigint, item string, score double, begin bigint, end bigint")
    best = F.max_by(F.struct("id", "item", "score", "begin", "end"), F.struct("score", -F.col("begin"))).alias("m")
    return scored.groupBy("text_no", "item_no").agg(best).select("m.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **limits) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark item is found.  A found leak takes all rows of
    its id with it; rows with a null id stay."""
    name = work.free_name(docs, "_leak")
    found = leaks(docs, benchmark, id_col, **limits).select(F.col(id_col).alias(name)).where(F.col(name).isNotNull()).distinct()
    found = work.written(found, "leaks")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    return docs.join(found, F.col(id_col) == F.col(name), "left_anti")


def rare_pairs(items: Items, often: np.ndarray) -> np.ndarray:
    """For each (n-gram, holder) pair whether the n-gram is rare for that item: held by at most RARE
    times as many texts as the median of those of the item's n-grams that a text holds at all."""
    gram = np.repeat(np.arange(len(items.seed)), np.diff(items.first))
    value = often[gram]
    out = np.zeros(len(gram), bool)
    held = np.flatnonzero(value)
    order = held[np.lexsort((value[held], items.holder[held]))]
    start = np.searchsorted(items.holder[order], np.arange(len(items.words) + 1))
    for i in range(len(items.words)):
        own = order[start[i] : start[i + 1]]
        if len(own):
            out[own] = value[own] <= RARE * value[own[(len(own) - 1) // 2]]
    return out


def candidates(seeds: np.ndarray, places: np.ndarray, items: Items, is_rare: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The items that a window holds a seed of, with the places of those seeds and which are rare."""
    size = items.first[seeds + 1] - items.first[seeds]
    flat = np.repeat(items.first[seeds], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    item, at, sure = items.holder[flat], np.repeat(places, size), is_rare[flat]
    order = np.lexsort((at, item))
    item, at, sure = item[order], at[order], sure[order]
    cut = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else []
    return [(int(item[i]), at[i:j], sure[i:j]) for i, j in zip(cut, [*cut[1:], len(item)])]


def shared_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words of ``a`` that ``b`` has as well, repeats counted; an alignment matches no more."""
    x, n = np.unique(a, return_counts=True)
    at = np.minimum(np.searchsorted(x, b), len(x) - 1)
    return int(np.minimum(n, np.bincount(at[x[at] == b], minlength=len(x))).sum())


def spans(at: np.ndarray, reach: int, size: int) -> list[tuple[int, int]]:
    """Ranges around seeds that an alignment of an item of ``reach`` words can lie in."""
    cut = np.flatnonzero(np.r_[True, np.diff(at) > 2 * reach])
    return [(max(0, int(at[i]) - reach), min(size, int(at[j - 1]) + reach + SEED_WORDS)) for i, j in zip(cut, [*cut[1:], len(at)])]


def _aligned(pending: list, words: pa.Array, low: pa.Array, items: Items) -> list[tuple]:
    out = []
    pending.sort(key=lambda p: p[3] - p[2])
    at = 0
    while at < len(pending):
        wide = pending[min(at + ALIGN_BATCH, len(pending)) - 1]
        step = max(1, min(ALIGN_BATCH, 400_000 // max(1, wide[3] - wide[2])))
        part = pending[at : at + step]
        at += step
        b = [np.asarray(words[i].values)[lo:hi].view(_U) for i, _, lo, hi in part]
        a = [items.words[item] for _, item, _, _ in part]
        best, begin, end = align(a, b)
        for (i, item, lo, _), value, s, e in zip(part, best, begin, end):
            base = low[i].as_py() + lo
            out.append((i, item, float(value) / (MATCH * len(items.words[item])), base + int(s), base + int(e)))
    return out
