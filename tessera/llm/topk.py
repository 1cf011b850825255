"""Exact top-k search (operator 9): exhaustive term-at-a-time accumulation, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import work

#: Queries in one pass over the candidates; a pass's queries are the only rows that reach the driver.
QUERY_BLOCK = 8192
#: Candidates scored at once, and queries scored at once against them: their score arrays fit a core's cache.
ROW_BLOCK, SCORE_ROWS = 512, 256


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component; vectors that are null or hold a null, NaN or
    infinite component, and rows with a null id, take no part."""
    x = F.col(vector_col)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    return rows.where(F.col(id_col).isNotNull() & x.isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("long")).alias("v"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of int64; shorter vectors are filled with 0, which changes no inner product."""
    sizes = np.asarray(pa.compute.list_value_length(lists))
    flat = np.asarray(lists.flatten())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Postings:
    """A block of candidates by term: for each term the rows that have it, ascending, and their weights."""

    def __init__(self, vectors: np.ndarray):
        self.n, width = vectors.shape
        self.most = int(np.abs(vectors).max(initial=0))
        rows = [np.flatnonzero(vectors[:, t]) for t in range(width)]
        self.lists = [(t, at, vectors[at, t]) for t, at in enumerate(rows) if len(at)]

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """Dense score arrays, one column per query.  Term at a time: the term's postings are scattered,
        weighted by every query's component, into the scores of their rows; where few queries have the
        term, into those queries' only.  Sums are kept in the narrowest kind of number in which all of
        them are exact."""
        most = int(np.abs(queries).max(initial=0)) * self.most * max(1, queries.shape[1])
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        out = np.zeros((self.n, len(queries)), kind)
        room = np.empty_like(out)
        by_term = np.ascontiguousarray(queries.T.astype(kind))
        for t, at, weight in self.lists:
            hit = np.flatnonzero(by_term[t])
            weight = weight.astype(kind)[:, None]
            if 8 * len(hit) < len(queries):
                out[np.ix_(at, hit)] += weight * by_term[t, hit]
            else:
                add = np.multiply(weight, by_term[t], out=room[: len(at)])
                add += out.take(at, axis=0)
                out[at] = add
        return out


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of what may be among each query's k best: scores, one column per query, that
    reach the k-th best of this block, found by partition, and ``least``, the k-th best so far."""
    n = len(scores)
    mine = own[None, :] == ids[:, None]
    lowest = scores.dtype.type(-np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min)
    scores[mine] = lowest
    if least is None:
        least = np.partition(scores, n - k, axis=0)[n - k] if n > k else lowest
    place, row = np.nonzero(scores >= least)
    there = ~mine[place, row]
    place, row = place[there], row[there]
    return row, ids[place], scores[place, row].astype(np.int64)


def top_k(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Queries are the rows for which the column ``is_query`` holds; candidates are all rows but those
    that bear the query's own id.  Ties go to the smaller id.  Repeated ids: as queries, the vector
    that sorts first counts; as candidates, each row counts.  Vectors of other lengths than the
    longest are filled with zeros.  With no rows or queries the result is empty.  Other columns are not
    read.  Queries go out in blocks of about ``query_block``, each one pass over all candidates whose
    partial results are added to a table, so neither what is broadcast nor any plan grows with the data.
    Scores are 64-bit integers; larger ones wrap.
    """
    spark = rows.sparkSession
    vectors = integer_vectors(rows, id_col, vector_col, scale)
    asked = integer_vectors(rows.where(is_query), id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v"))
    asked = work.written(asked, "queries")
    n_blocks = -(-asked.count() // query_block)
    if n_blocks <= 1:
        out = _pass(vectors, asked.toArrow(), k)
    else:
        path = work.new_path(spark, "partial")
        block = F.pmod(F.xxhash64("id"), F.lit(2 * n_blocks))
        for b in range(2 * n_blocks):
            part = _pass(vectors, asked.where(block == b).toArrow(), k)
            part.write.mode("append").parquet(path)
        out = spark.read.schema(part.schema).parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(vectors: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    ids = np.asarray(asked["id"].combine_chunks() if asked.num_rows else [], np.int64)
    own = matrix(asked["v"].combine_chunks(), 0) if asked.num_rows else np.zeros((0, 0), np.int64)
    sent = vectors.sparkSession.sparkContext.broadcast((ids, own))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own = sent.value
        if not len(ids):
            return
        parts = range(0, len(ids), SCORE_ROWS)
        held = {s: tuple(np.zeros(0, np.int64) for _ in range(3)) for s in parts}
        least: dict[int, np.ndarray | None] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(low, ROW_BLOCK)
                at = np.asarray(part.column(0))
                block = matrix(part.column(1), own.shape[1])
                queries = np.pad(own, ((0, 0), (0, block.shape[1] - own.shape[1]))) if block.shape[1] > own.shape[1] else own
                postings = Postings(block)
                for s in parts:
                    mine = ids[s : s + SCORE_ROWS]
                    new = best(postings.scores(queries[s : s + SCORE_ROWS]), at, mine, k, least.get(s))
                    if len(new[0]):
                        held[s] = merged(tuple(np.concatenate(x) for x in zip(held[s], new)), k)
                        least[s] = kth_scores(held[s], len(mine), k)
        for s in parts:
            row, at, score = held[s]
            yield pa.RecordBatch.from_arrays([pa.array(ids[s + row]), pa.array(at), pa.array(score)], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")


def merged(rows: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query among partial results."""
    row, at, score = rows
    order = np.lexsort((at, -score, row))
    row = row[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    keep = place < k
    return row[keep], at[order][keep], score[order][keep]


def kth_scores(rows: tuple[np.ndarray, ...], n: int, k: int) -> np.ndarray | None:
    """The k-th best score of each of n queries among merged results; none if one has fewer than k."""
    row, _, score = rows
    ends = np.searchsorted(row, np.arange(n), "right")
    if (np.diff(np.r_[0, ends]) < k).any():
        return None
    return score[ends - 1]
