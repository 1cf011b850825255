"""Vectors for phrases, and nearest-neighbour joins over them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.grams import spans
from tessera.sources import shared

#: Targets in one matrix; larger tables are dealt into blocks of about this many.  Texts embedded at once; characters hashed at once.
TARGET_BLOCK, EMBED_ROWS, SUM_CHARS = 50_000, 2048, 1 << 16


#: CRC-32 (that of zlib) of each byte.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)


def _crc(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _CRC[(h ^ byte) & 0xFF] ^ (h >> 8)


class Embedder(Protocol):
    """Turns texts into rows of unit length.  Any model fits that is loaded inside ``__call__``."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Character n-grams hashed to signed dimensions: a stand-in that needs no model.  Its similarities
    are not calibrated like a trained model's, so thresholds are parameters everywhere."""

    def __init__(self, width: int = 256, grams: tuple[int, ...] = (2, 3, 4)):
        self.width, self.grams = width, grams

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = self.sums(texts)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def sums(self, texts: list[str]) -> np.ndarray:
        """The vectors before they are scaled, in whole numbers: those of many texts at once, a long one by pieces."""
        out = np.zeros((len(texts), self.width))
        reach = max(self.grams) - 1
        sizes = np.array([len(t) + 2 for t in texts], np.int64)
        for low, high in spans(np.maximum(sizes, SUM_CHARS // 1024), SUM_CHARS):
            part = [f" {t} " for t in texts[low:high]]
            if len(part[0]) <= SUM_CHARS:
                out[low:high] = self._sums(part)
            else:
                for at in range(0, len(part[0]), SUM_CHARS):
                    out[low] += self._sums([part[0][at : at + SUM_CHARS + reach]], SUM_CHARS)[0]
        return out

    def _sums(self, texts: list[str], most: int | None = None) -> np.ndarray:
        """Sums of the texts' grams (``most``: those that begin before), CRC-32 of all of one length at once."""
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        begin = np.flatnonzero((data & 0xC0) != 0x80)  # of each character
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        size = np.diff(begin, append=len(data))
        more = [(j, np.flatnonzero(size > j)) for j in range(1, int(size.max(initial=1)))]
        first, at = data[begin], []
        h = np.full(len(begin), 0xFFFFFFFF, np.uint32)
        for k in range(min(max(self.grams), len(begin))):
            h = _crc(h[: len(begin) - k], first[k:])
            for j, long in more:
                i = long[np.searchsorted(long, k) :]
                h[i - k] = _crc(h[i - k], data[begin[i] + j])
            if k + 1 in self.grams:
                inside = row[: len(h)][:most] == row[k:][:most]
                at.append((row[: len(h)][:most] * (2 * self.width) + self._places(h[:most]))[inside])
        count = np.bincount(np.concatenate(at) if at else np.zeros(0, np.int64), minlength=len(texts) * self.width * 2).reshape(len(texts), self.width, 2)
        return (count[:, :, 1] - count[:, :, 0]).astype(np.float64)

    def _places(self, h: np.ndarray) -> np.ndarray:
        """Twice the dimension of each gram, and 1 more where it adds there."""
        h = ~h
        return h % np.uint32(self.width) * 2 + (h >> 16 & 1)

    @property
    def adds_up(self) -> bool:
        """Whether the sums of a run of words, each of two ASCII characters or more, are those of its words and ``gaps``."""
        return max(self.grams) <= 5

    def gaps(self, words: list[str], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(dimensions, signs) of the grams over the blank between each left and right word, given by their places in ``words``."""
        k = max(max(self.grams) - 2, 0)
        cut = lambda ends: np.frombuffer("".join(ends).encode(), np.uint8).reshape(len(words), k)
        tails, heads = cut([f" {w}"[-k:] if k else "" for w in words]), cut([f"{w} "[:k] for w in words])
        letters = np.concatenate([tails[left], np.full((len(left), 1), 32, np.uint8), heads[right]], axis=1)
        found = [np.zeros((len(left), 0), np.int64)]
        for n in self.grams:
            for low in range(k - n + 2, k):
                h = np.full(len(left), 0xFFFFFFFF, np.uint32)
                for j in range(n):
                    h = _crc(h, letters[:, low + j])
                found.append(self._places(h)[:, None].astype(np.int64))
        at = np.concatenate(found, axis=1)
        return at >> 1, (2 * (at & 1) - 1).astype(np.float64)


def embed(rows: DataFrame, text: str, embedder: Embedder, name: str = "vector") -> DataFrame:
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(embedder(part.fillna("").tolist()).astype(np.float32)), index=part.index)

    return rows.withColumn(name, run(text))


def vectors(rows: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """``rows`` with ``v``: each text's vector as packed 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, EMBED_ROWS):
                part = batch.slice(low, EMBED_ROWS)
                made = np.ascontiguousarray(embedder([x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]), np.float32)
                yield part.append_column("v", pa.array([v.tobytes() for v in made], pa.binary()))

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", v binary")


def matrix(packed: pa.Array) -> np.ndarray:
    """Packed vectors as rows."""
    if not len(packed):
        return np.zeros((0, 0), np.float32)
    return np.frombuffer(b"".join(packed.to_pylist()), np.float32).reshape(len(packed), -1)


def _best(mine: np.ndarray, theirs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, target, score) of each row's k most similar targets; of equals the first."""
    scores = mine @ theirs.T
    k = min(k, len(theirs))
    best = np.argmax(scores, axis=1)[:, None] if k == 1 else np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(len(mine)), k), best.ravel(), np.take_along_axis(scores, best, 1).ravel().astype(np.float64)


def nearest(phrases: DataFrame, targets: DataFrame, embedder: Embedder, phrase: str, target: str, label: str, k: int = 1, block: int = TARGET_BLOCK) -> DataFrame:
    """(phrase, label, near): the k most similar targets of each distinct phrase, exactly; of equals the
    first by name.

    Texts on both sides are embedded once each, by tasks.  Up to ``block`` targets, counted before,
    their matrix is broadcast and phrases are not shuffled.  More targets are dealt into blocks by a
    hash; every block of phrases meets every block of targets in a task that holds these two alone, and
    the k best of each are merged: nothing passes through the driver.
    """
    spark = phrases.sparkSession
    listed = targets.select(F.col(target).alias("t"), F.col(label).alias("l")).distinct()
    total = listed.count()
    kind = "`p` string, t string, l string, near double"
    mine = phrases.select(F.col(phrase).alias("p")).distinct()
    if total <= block:
        table = vectors(listed, "t", embedder).toArrow().sort_by([("t", "ascending"), ("l", "ascending")])
        sent = spark.sparkContext.broadcast((table["t"].to_pylist(), table["l"].to_pylist(), matrix(table["v"].combine_chunks()) if total else np.zeros((0, 0), np.float32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, labels, theirs = sent.value
            for batch in batches if names else ():
                for low in range(0, batch.num_rows, 256):
                    texts = batch.column(0).slice(low, 256).to_pylist()
                    row, at, score = _best(np.ascontiguousarray(embedder([x or "" for x in texts]), np.float32), theirs, k)
                    yield pa.RecordBatch.from_arrays([pa.array([texts[i] for i in row], pa.string()), pa.array([names[j] for j in at], pa.string()), pa.array([labels[j] for j in at], pa.string()), pa.array(score)], ["p", "t", "l", "near"])

        out = shared.dealt(mine, "p").mapInArrow(run, kind)
    else:
        n, m = -(-total // block), max(1, -(-mine.count() // block))
        deal = lambda column, parts: F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")
        left = vectors(mine, "p", embedder).select(deal("p", m).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"), "p", "v")
        right = vectors(listed, "t", embedder).select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("i"), deal("t", n).alias("j"), "t", "l", "v")

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            b = b.sort_by([("t", "ascending"), ("l", "ascending")])
            out = [pa.table({c: pa.array([], t) for c, t in (("p", pa.string()), ("t", pa.string()), ("l", pa.string()), ("near", pa.float64()))})]
            if a.num_rows and b.num_rows:
                theirs = matrix(b["v"].combine_chunks())
                for low in range(0, a.num_rows, 256):
                    part = a.slice(low, 256)
                    row, at, score = _best(matrix(part["v"].combine_chunks()), theirs, k)
                    near = b.take(pa.array(at))
                    out.append(pa.table({"p": part["p"].take(pa.array(row)).cast(pa.string()), "t": near["t"].cast(pa.string()), "l": near["l"].cast(pa.string()), "near": pa.array(score)}))
            return pa.concat_tables(out)

        out = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, kind)
        first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("near")).alias("far"), "t", "l"))), 1, k)
        out = out.groupBy("p").agg(first.alias("b")).select("p", F.explode("b").alias("b")).select("p", "b.t", "b.l", (-F.col("b.far")).alias("near"))
    return out.select(F.col("p").alias(phrase), F.col("l").alias(label), "near")


def centroids(rows: DataFrame, vector: str, by: str) -> DataFrame:
    """(by, centroid): the mean vector of each group, scaled to length 1."""
    each = rows.select(by, F.posexplode(vector).alias("i", "v")).groupBy(by, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    lists = each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("c"))
    length = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, v: s + v * v))
    return lists.select(by, F.transform("c", lambda v: v / F.nullif(length, F.lit(0.0))).alias("centroid"))


def arg_max(rows: DataFrame, prototypes: DataFrame, vector: str, key: str, label: str, prototype: str = "centroid", least: float | None = None, most: int = 1024) -> DataFrame:
    """(key, label, score): the prototype with the highest inner product, of equals the least label;
    below ``least`` the label is null.  Every row meets every prototype, one for each class, so more than
    ``most`` of them are refused."""
    from tessera.functions.arrays import dot

    if prototypes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} prototypes: use nearest")

    scored = rows.select(key, vector).crossJoin(F.broadcast(prototypes)).select(key, label, F.round(dot(vector, prototype), 6).alias("score"))
    best = scored.groupBy(key).agg(F.min_by(F.struct(label, "score"), F.struct(-F.col("score"), F.col(label))).alias("b")).select(key, "b.*")
    return best if least is None else best.withColumn(label, F.when(F.col("score") >= least, F.col(label)))


def margin(vector: Column | str, one: list[float], other: list[float]) -> Column:
    """Similarity to one centroid less that to the other; the centroids are literals."""
    from tessera.functions.arrays import dot

    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    return dot(vector, lit(one)) - dot(vector, lit(other))
