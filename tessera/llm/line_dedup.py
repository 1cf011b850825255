"""Line dedup (operator 1): pairwise patience alignment of documents that share rare line hashes.

Short lines are common, so a line alone says little.  The seeds are the hashes of runs of lines: from each
line on, and up to each line, the shortest run that reaches BLOCK_WORDS words.  Such a run is rare, and a
passage that could be deleted holds at least one.  The first document that has a run owns it; every later
document that has it is linked with the owner, line by line, so no group of documents is ever paired
with itself and none is too common to be linked.  Linked documents are aligned by patience diff, and
aligned common blocks are deleted from the later one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel, work

#: Words that a block must have to be deleted, and that a run of lines needs to be a seed.
BLOCK_WORDS = 20


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))


def _words(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1).cast("int")


def patience(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j), ascending in both, at which patience diff aligns a[i] with b[j]: the longest
    increasing run of lines unique in both sides, grown over equal neighbours, and the same again
    between the anchors."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        ua, ia, ca = np.unique(a[a0:a1], return_index=True, return_counts=True)
        ub, ib, cb = np.unique(b[b0:b1], return_index=True, return_counts=True)
        both, pa_, pb_ = np.intersect1d(ua[ca == 1], ub[cb == 1], assume_unique=True, return_indices=True)
        if len(both):
            x, y = ia[ca == 1][pa_] + a0, ib[cb == 1][pb_] + b0
            order = np.argsort(x)
            anchors = _increasing(x[order].tolist(), y[order].tolist())
        else:  # nothing unique: equal heads and tails still align
            anchors = []
            i, j = a0, b0
            while i < a1 and j < b1 and a[i] == b[j]:
                out.append((i, j))
                i, j = i + 1, j + 1
            while a1 > i and b1 > j and a[a1 - 1] == b[b1 - 1]:
                a1, b1 = a1 - 1, b1 - 1
                out.append((a1, b1))
            continue
        i0, j0 = a0, b0
        for i, j in anchors:
            if i < i0 or j < j0:
                continue  # already taken by the growth of the anchor before
            lo = 0
            while i - lo > i0 and j - lo > j0 and a[i - lo - 1] == b[j - lo - 1]:
                lo += 1
            hi = 1
            while i + hi < a1 and j + hi < b1 and a[i + hi] == b[j + hi]:
                hi += 1
            out += [(i + k, j + k) for k in range(-lo, hi)]
            todo.append((i0, i - lo, j0, j - lo))
            i0, j0 = i + hi, j + hi
        todo.append((i0, a1, j0, b1))
    return sorted(out)


def _increasing(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """The longest run of pairs with ascending y; x ascends already."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(y)
    for k, v in enumerate(y):
        at = bisect_left(tails, v)
        back[k] = ends[at - 1] if at else -1
        tails[at : at + 1] = [v]
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append((x[k], y[k]))
        k = back[k]
    return out[::-1]


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start .. start + length - 1 of each span, one span after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


def runs(h: np.ndarray, words: np.ndarray, first: np.ndarray, block_words: int = BLOCK_WORDS) -> tuple[np.ndarray, ...]:
    """(document, hash, place, lines) of every shortest run of ``block_words`` words that begins or ends at
    a line; document i has the lines first[i] .. first[i + 1], and places count from its first line."""
    total = np.r_[0, np.cumsum(words)]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(h))
    end = np.searchsorted(total, total[:-1] + block_words)  # runs that begin at a line
    begins = end <= first[text + 1]
    start = np.searchsorted(total, total[1:] - block_words, "right") - 1  # runs that end at a line
    ends = start >= first[text]
    ends[ends] &= end[start[ends]] != at[ends] + 1
    low, high = np.r_[at[begins], start[ends]], np.r_[end[begins], at[ends] + 1]
    text = np.r_[text[begins], text[ends]]
    power, inverse = (kernel._power(base, len(h) + 1, key) for base, key in ((kernel._BASE, "up"), (kernel._BASE_INV, "down")))
    prefix = np.r_[np.uint64(0), np.cumsum(kernel.mix(h.view(np.uint64)) * power[: len(h)], dtype=np.uint64)]
    code = kernel.mix((prefix[high] - prefix[low]) * inverse[low] + (high - low).astype(np.uint64))
    return text, code.view(np.int64), low - first[text], high - low


def deleted(lines: np.ndarray, words: np.ndarray, at: np.ndarray, seat: np.ndarray, length: np.ndarray, block_words: int = BLOCK_WORDS) -> np.ndarray:
    """Flags of the ``lines`` in blocks aligned with one earlier document.

    Shared run k stands at the places at[k] .. at[k] + length[k] of the lines and at the same number of
    seats from seat[k] of the other document.  The lines in shared runs are aligned with the seats; a
    block is a stretch of lines aligned to a stretch of seats, and goes if it has ``block_words`` words.
    Runs still whole are aligned again, so moved blocks go as well; runs whose lines recur so often that
    no line anchors them go as they are.
    """
    gone = np.zeros(len(lines), bool)
    while True:
        before = np.r_[0, np.cumsum(gone)]
        whole = before[at + length] == before[at]
        if not whole.any():
            return gone
        at, seat, length = at[whole], seat[whole], length[whole]
        places = spans(at, length)
        mine = np.unique(places)
        seats, one = np.unique(spans(seat, length), return_index=True)
        pairs = np.array(patience(lines[mine], lines[places[one]]), np.int64).reshape(-1, 2)
        i, j = mine[pairs[:, 0]], seats[pairs[:, 1]]
        cut = np.flatnonzero(np.r_[len(i) > 0, (np.diff(i) != 1) | (np.diff(j) != 1)])
        size = np.diff(np.r_[cut, len(i)])
        enough = np.add.reduceat(words[i], cut) >= block_words if len(i) else np.zeros(0, bool)
        if not enough.any():
            gone[mine] = True
            return gone
        gone[i[np.repeat(enough, size)]] = True


def _align(block_words: int):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = batch.column(4).flatten()
            ids, t, at, seat, length = (links.field(k) for k in range(5))
            rank = np.asarray(pa.compute.rank(ids, tiebreaker="dense")).astype(np.int64)
            t, at, seat, length = (np.asarray(x) for x in (t, at, seat, length))
            first = np.r_[0, np.cumsum(np.asarray(pa.compute.list_value_length(batch.column(4))))]
            masks, words, n_links, owners = [], [], [], []
            for row in range(batch.num_rows):
                h, n = (np.asarray(batch.column(c)[row].values) for c in (2, 3))
                told = np.flatnonzero(n > 0)
                lines, sizes = h[told], n[told]
                gone, n_owners, owner = np.zeros(len(told), bool), 0, 0
                some = np.arange(first[row], first[row + 1])
                some = some[np.lexsort((t[some], rank[some]))]
                key = np.stack([rank[some], t[some]])
                for part in np.split(some, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1):
                    found = deleted(lines, sizes, at[part], seat[part], length[part], block_words)
                    owner = owner if n_owners else int(part[0])
                    n_owners += 1
                    gone |= found
                mask = np.zeros(len(n), bool)
                mask[told[gone]] = True
                masks.append(mask)
                words.append(int(sizes[gone].sum()))
                n_links.append(n_owners)
                owners.append(owner)
            owners = ids.take(pa.array(owners, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.list_(pa.bool_())), pa.array(words, pa.int64()), pa.array(n_links, pa.int64()), owners], ["id", "t", "mask", "words", "links", "owner"])
        kernel.release()

    return align


def overlaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, t, mask, words, links, owner) of the documents that lose lines: flags by line, words lost, how
    many earlier documents they were aligned with, and the first of those.  A document is an id and its
    text's hash ``t``, and documents come in that order."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")
    known = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("t"), _lines(text).alias("lines"))
    seqs = known.select("id", "t", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.transform("lines", _words).alias("n"))
    seqs = work.written(seqs.where(F.aggregate("n", F.lit(0), lambda a, x: a + x) >= block_words), "lines")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(pa.compute.list_value_length(batch.column(2)))
            h, n = (np.asarray(batch.column(k).flatten()) for k in (2, 3))
            told = n > 0
            first = np.r_[0, np.cumsum(told)][np.r_[0, np.cumsum(size)]]
            row, code, at, length = runs(h[told], n[told].astype(np.int64), first, block_words)
            for a in range(0, len(row), 100_000):
                i = slice(a, a + 100_000)
                own = pa.array(row[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(code[i]), pa.array(at[i].astype(np.int32)), pa.array(length[i].astype(np.int32))], ["id", "t", "run", "at", "length"])
        kernel.release()

    shared = work.written(seqs.mapInArrow(seeds, f"id {kind}, t bigint, run bigint, at int, length int"), "runs")
    owners = shared.groupBy("run").agg(F.min(F.struct("id", "t", "at")).alias("f"), F.max(F.struct("id", "t")).alias("l"))
    owners = owners.where(F.struct("f.id", "f.t") < F.col("l")).select(F.col("run").alias("o_run"), F.col("f.id").alias("o_id"), F.col("f.t").alias("o_t"), F.col("f.at").alias("seat"))
    owners = work.written(owners, "owners")  # a join of two plain exchanges, so that Spark splits common runs
    links = shared.join(owners, F.col("run") == F.col("o_run")).where(F.struct("id", "t") > F.struct("o_id", "o_t"))
    links = links.groupBy(F.col("id").alias("l_id"), F.col("t").alias("l_t")).agg(F.collect_list(F.struct("o_id", "o_t", "at", "seat", "length")).alias("links"))
    mine = seqs.groupBy("id", "t").agg(F.first("h").alias("h"), F.first("n").alias("n"))
    both = mine.join(links.hint("merge"), (F.col("id") == F.col("l_id")) & (F.col("t") == F.col("l_t"))).select("id", "t", "h", "n", "links")
    return both.mapInArrow(_align(block_words), f"id {kind}, t bigint, mask array<boolean>, words bigint, links bigint, owner {kind}")


def _cut(docs: DataFrame, id_col: str, text_col: str, limits: dict) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its texts cut and the columns of ``overlaps`` beside, under names that it has not."""
    names = {c: work.free_name(docs, f"line_dedup_{c}") for c in ("id", "t", "mask", "words", "links", "owner")}
    with work.scratch():
        gone = work.written(overlaps(docs, id_col, text_col, **limits), "gone", keep=True).toDF(*names.values())
    text = F.col(f"`{text_col}`")
    # always a merge join: what is shuffled then follows the input alike at every size
    joined = docs.join(gone.hint("merge"), (F.col(f"`{id_col}`") == F.col(names["id"])) & (F.xxhash64(text) == F.col(names["t"])), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.coalesce(F.get(names["mask"], i), F.lit(False))), "\n")
    cut = F.when(F.col(names["mask"]).isNull(), text).otherwise(kept)
    # what counts lines needs the text as it was
    size = work.free_name(docs, "line_dedup_lines")
    rows = joined.select("*", F.greatest(F.size(F.split(text, "\n")), F.lit(0)).alias(size))
    return rows.withColumn(text_col, cut), names | {"lines": size}


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """All rows and columns of ``docs`` with the deleted lines gone from the text, and five columns
    more: n_lines, removed_lines, removed_words, n_links and owner (how many earlier documents lines
    were deleted for, and the first of them).

    Documents come in the order of their ids; rows that share an id but not the text are documents of
    their own, in the order of their texts' hashes; rows that share both are one document, kept or cut
    alike.  Rows with a null id are never touched; a null text stays null (0 lines); a text of which all
    is deleted becomes empty.  Lines are equal if they are so without blanks at their ends; a line's words
    are its blanks and one.  Where ``docs`` has columns of those five names already, they are replaced;
    columns of any other names stay as they are.
    """
    rows, names = _cut(docs, id_col, text_col, limits)
    more = {
        "n_lines": F.col(names["lines"]),
        "removed_lines": F.coalesce(F.size(F.filter(names["mask"], lambda x: x)), F.lit(0)),
        "removed_words": F.coalesce(names["words"], F.lit(0).cast("long")),
        "n_links": F.coalesce(names["links"], F.lit(0).cast("long")),
        "owner": F.col(names["owner"]),
    }
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in more]
    return rows.select(*kept, *[c.alias(k) for k, c in more.items()])


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **limits) -> DataFrame:
    """``line_dedup`` with the columns of ``docs`` only, all of them; ``length_col``, where there is one,
    follows the text of the rows that lost lines."""
    rows, names = _cut(docs, id_col, text_col, limits)
    length = {}
    if length_col in docs.columns:
        length[length_col] = F.when(F.col(names["mask"]).isNotNull(), F.length(f"`{text_col}`")).otherwise(F.col(f"`{length_col}`")).cast(docs.schema[length_col].dataType)
    return rows.select(*[length[c].alias(c) if c in length else F.col(f"`{c}`") for c in docs.columns])
