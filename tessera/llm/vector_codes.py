"""Vector code compression (operator 11): product codes whose nearest entries are found by VA-file filtering.

Vectors become integers and are cut into parts; every part is replaced by the index of the nearest entry
of its codebook.  An entry's coordinates are known by short cell numbers.  For each part that seeks its
entry, tables of the least and greatest distance to every cell, looked up by the cell numbers, give a
lower and an upper bound of the distance to every entry; integer distances are computed only for
entries whose lower bound does not pass the least upper bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import work

#: Bits of a cell number, vectors encoded at once, and the magnitude at which integer components are
#: held: up to it all distances of vectors of up to 64 components fit a long.
CELL_BITS, ROW_BLOCK, MOST = 4, 2048, 1 << 27
#: A label with more than this share of all rows is hot: there are fewer than its inverse of these.
HOT_SHARE = 1 / 1024


@dataclass
class Cells:
    """A codebook by cells: entries (m, d), their cell numbers, and each cell's least and greatest coordinate."""

    entries: np.ndarray
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(entries: np.ndarray, bits: int = CELL_BITS) -> Cells:
        m, d = entries.shape
        n = min(1 << bits, m)
        number = np.empty((m, d), np.int64)
        low, high = np.empty((d, n), np.int64), np.empty((d, n), np.int64)
        for j in range(d):
            order = np.argsort(entries[:, j], kind="stable")  # as many entries in each cell
            number[order, j] = np.arange(m) * n // m
            cuts = -(-np.arange(n) * m // n)
            low[j] = entries[order[cuts], j]
            high[j] = entries[order[np.r_[cuts[1:], m] - 1], j]
        return Cells(entries, number, low, high)

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each part to each entry."""
        most = max(int(np.abs(parts).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        kind = np.int32 if parts.shape[1] * (2 * most) ** 2 < 1 << 31 else np.int64
        lower, upper = np.zeros((len(parts), len(self.entries)), kind), np.zeros((len(parts), len(self.entries)), kind)
        for j in range(parts.shape[1]):
            under, over = self.low[j] - parts[:, j, None], parts[:, j, None] - self.high[j]
            near = np.maximum(np.maximum(under, over), 0).astype(kind)
            far = np.maximum(np.abs(under), np.abs(over)).astype(kind)
            lower += (near * near)[:, self.number[:, j]]
            upper += (far * far)[:, self.number[:, j]]
        return lower, upper

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each part's nearest entry, ties to the lower index."""
        lower, upper = self.bounds(parts)
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        apart = parts[row] - self.entries[entry]
        distance = np.einsum("ij,ij->i", apart, apart)
        first = np.searchsorted(row, np.arange(len(parts)))
        least = np.minimum.reduceat(distance, first) if len(parts) else np.zeros(0, np.int64)
        hit = np.flatnonzero(distance == least[row])
        return entry[hit[np.searchsorted(row[hit], np.arange(len(parts)))]], least


def sound_vectors(rows: DataFrame, columns: dict[str, str], vector_col: str) -> DataFrame:
    """``columns`` (new name to old) and the vector as v; vectors that are null or hold a null, NaN or
    infinite component are dropped."""
    x = F.col(vector_col)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    return rows.where(x.isNotNull() & sound).select(*(F.col(old).alias(new) for new, old in columns.items()), x.cast("array<double>").alias("v"))


def integers(lists: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) as rows of ``width`` components; shorter vectors are filled with zeros."""
    sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
    flat = np.clip(np.floor(np.asarray(lists.flatten(), np.float64) * scale), -MOST, MOST).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


@dataclass
class Codebooks:
    """(parts, entries, components of a part) integers, and the scale that made them."""

    entries: np.ndarray
    scale: int

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assigned(self, vectors: np.ndarray, cells: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of every part of every vector."""
        at = [c.nearest(part) for c, part in zip(cells, np.split(vectors, len(cells), axis=1))]
        return np.stack([a for a, _ in at], axis=1), np.stack([d for _, d in at], axis=1)


def _blocks(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    cells = [Cells.of(e) for e in books.entries]
    for batch in batches:
        for low in range(0, batch.num_rows, ROW_BLOCK):
            part = batch.slice(low, ROW_BLOCK)
            vectors = integers(part.column(part.num_columns - 1), books.width, books.scale)
            yield part, vectors, *books.assigned(vectors, cells)


def _moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round: every entry becomes the floor of the mean of the parts nearest to it.
    Tasks add up sums of their own; what reaches the driver has the size of the codebooks."""
    n_parts, m, d = books.entries.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_parts * m, d + 1), np.int64)
        for _, x, entry, _ in _blocks(batches, sent.value):
            place = (entry + np.arange(n_parts) * m).ravel()
            order = np.argsort(place, kind="stable")
            values = np.c_[x.reshape(-1, d), np.ones(len(place), np.int64)][order]
            first = np.flatnonzero(np.r_[True, np.diff(place[order]) > 0])
            total[place[order][first]] += np.add.reduceat(values, first)
        used = np.flatnonzero(total[:, d])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used * (d + 1), d + 1) + np.tile(np.arange(d + 1), len(used))), pa.array(total[used].ravel())], ["place", "x"])

    sums = vectors.select("v").mapInArrow(add, "place bigint, x bigint").groupBy("place").agg(F.sum("x").alias("x")).toArrow()
    total = np.zeros(n_parts * m * (d + 1), np.int64)
    total[np.asarray(sums["place"])] = np.asarray(sums["x"])
    total = total.reshape(n_parts, m, d + 1)
    count = total[:, :, d:]
    return Codebooks(np.where(count > 0, total[:, :, :d] // np.maximum(count, 1), books.entries), books.scale)


def fit(vectors: DataFrame, n_parts: int = 16, n_entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks learnt from all rows of (id, ..., v) in ``rounds`` rounds; they begin with the parts of
    the ``n_entries`` rows with the smallest ids (nulls last, ties by vector).  None if there are no rows."""
    longest = vectors.agg(F.max(F.size("v")).alias("n")).first()["n"]
    if longest is None:
        return None
    d = max(1, -(-longest // n_parts))
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(n_entries).toArrow()
    start = integers(first["v"].combine_chunks(), n_parts * d, scale)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), n_parts, d).transpose(1, 0, 2)), scale)
    for _ in range(rounds):
        books = _moved(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error): the index of every part's nearest entry, two hex digits each, and the
    squared distances, added up."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, entry, distance in _blocks(batches, sent.value):
            codes = entry.astype(np.uint8)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(distance.sum(axis=1))], ["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select("id", "label", "v").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", n_parts: int = 16, n_entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every row with a sound vector.

    Components become floor(scale * x).  At most 256 entries.  A row with a null id keeps it and begins
    no codebook unless too few others do; repeated rows and ids count each; vectors shorter than the
    longest, whose length is rounded up to whole parts, are filled with zeros; scaled components are held
    at +-2**27.  Without sound vectors the result is empty.  Other columns are not read.  label_error is
    the error summed over equal labels, nulls together; hot labels, of which there can only be 1024, are
    looked up by broadcast, the others by a join.  The driver holds the codebooks, never vectors beyond
    their first ``n_entries``; every round is one pass over the table.
    """
    spark = rows.sparkSession
    vectors = sound_vectors(rows, {"id": id_col, "label": label_col}, vector_col)
    books = fit(vectors.select("id", "v"), n_parts, n_entries, rounds, scale)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    if books is None:
        return spark.createDataFrame([], f"`{id_col}` {kinds['id']}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    done = work.written(encode(vectors, books), "codes")
    labels = work.written(done.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    least = done.count() * HOT_SHARE
    hot, rest = F.broadcast(labels.where(F.col("n") > least).drop("n")), labels.where(F.col("n") <= least).drop("n")
    same = F.col("label").eqNullSafe(F.col("of"))
    out = done.join(hot, same).unionByName(done.join(hot, same, "left_anti").join(rest, same))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
