"""Spelling variants (operator 13): full neighbourhood generation joined to the vocabulary by hash.

Every word emits all distinct deletions, replacements and insertions of one character over the alphabet
that the vocabulary shows.  What one word emits and another word is, is near it: equality settles it and
no distance is computed.  Emitted candidates are first looked up by their hashes in one bit set of the
vocabulary, whose size is bounded; only those that may be words become strings and are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import work

RUN = "[A-Za-z\\u00C0-\\u00FF]"
#: Bits of the set for each word of the vocabulary, and the least and most bits (as powers of 2): beyond
#: the most, more candidates that are no words are shuffled, and results stay the same.
BITS_PER_WORD, LEAST_BITS, MOST_BITS = 32, 16, 29
#: Words of 64 bits that a task packs into one row of the set.
PACKED = 1 << 13
#: Candidates generated at once.
BLOCK_CANDIDATES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6) -> DataFrame:
    """(id, run): every maximal run of letters of at least ``least_length`` in each whole text, A-Z in
    lower case; a null text has none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run"))
    return found.select("id", F.translate("run", upper, lower).alias("run"))


def noisy(found: DataFrame, one_in: int = 199) -> DataFrame:
    """(word) of each (id, run): where ``one_in`` divides h, the crc32 of ``<id>:<run>`` (a null id as
    nothing), the run without its code point h % length."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return found.withColumn("h", h).select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, code points) of the words of each length."""
    size = np.array([len(w) for w in words], np.int64)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        if n:
            yield rows, np.frombuffer("".join(words[i] for i in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), n).astype(np.uint64)


def _hashes(codes: np.ndarray) -> np.ndarray:
    return (codes * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h * _SPREAD) >> np.uint64(64 - bits)


def bit_set(words: DataFrame, n_words: int) -> np.ndarray:
    """The bit set of the words' hashes, as bytes; tasks set bits by words of 64, which are joined by OR and
    packed into rows of ``PACKED``.  The driver takes one partition of these at a time and puts it in place,
    so it holds little more than the set itself."""
    bits = min(MOST_BITS, max(LEAST_BITS, (n_words * BITS_PER_WORD - 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [_slots(_hashes(codes), bits) for _, codes in _by_length(batch.column(0).to_pylist())]
            slot = np.unique(np.concatenate(h)) if h else np.zeros(0, np.uint64)
            first = np.flatnonzero(np.r_[True, np.diff(slot >> np.uint64(6)) > 0]) if len(slot) else np.zeros(0, np.int64)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (slot & np.uint64(63)), first) if len(slot) else slot
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6))[first].astype(np.int64)), pa.array(mask.view(np.int64))], ["place", "mask"])

    def pack(rows: pa.Table) -> pa.Table:
        place = np.asarray(rows["place"])
        packed = np.zeros(min(PACKED, 1 << (bits - 6)), np.int64)
        packed[place % PACKED] = np.asarray(rows["mask"])
        return pa.table({"at": pa.array([int(place[0]) // PACKED], pa.int64()), "packed": pa.array([packed.tobytes()], pa.binary())})

    marked = words.select("word").mapInArrow(mark, "place bigint, mask bigint").groupBy("place").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in marked.groupBy(F.floor(F.col("place") / PACKED)).applyInArrow(pack, "at bigint, packed binary").toLocalIterator():
        out[row.at * PACKED * 8 :][: len(row.packed)] = np.frombuffer(row.packed, np.uint8)
    return out


def _neighbourhood(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(kind, hashes, whether distinct) of all candidates of words of one length n: deletions (word, place),
    replacements and insertions (word, place, letter).  Of equal ones, as inside a run of one letter, the
    first counts."""
    n = codes.shape[1]
    power = _powers(n + 1)
    before = np.zeros((len(codes), n + 1), np.uint64)  # before[:, p]: the hash of the letters before place p
    np.cumsum(codes * power[:n], axis=1, out=before[:, 1:])
    whole = before[:, n:]
    after = whole - before  # the letters from place p on
    again = np.zeros((len(codes), n), bool)
    again[:, 1:] = codes[:, 1:] == codes[:, :-1]
    yield "delete", before[:, :n] + after[:, 1:] * _BACK, ~again
    put = alphabet[None, :] * power[:, None]
    yield "replace", (whole - codes * power[:n])[:, :, None] + put[None, :n], codes[:, :, None] != alphabet
    fresh = np.ones((len(codes), n + 1, len(alphabet)), bool)
    fresh[:, 1:] = codes[:, :, None] != alphabet
    yield "insert", (before + after * power[1])[:, :, None] + put[None], fresh


def candidates(words: DataFrame, alphabet: str, bits: np.ndarray) -> DataFrame:
    """(candidate, word, n): whatever (word, n) emits that may be a word by the bit set."""
    sent = words.sparkSession.sparkContext.broadcast((alphabet, bits))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, held = sent.value
        alphabet = np.array([ord(c) for c in letters], np.uint64)
        width = (8 * len(held)).bit_length() - 1
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1)
            for rows, codes in _by_length(words):
                step = max(1, BLOCK_CANDIDATES // ((2 * codes.shape[1] + 1) * (len(alphabet) + 1)))
                for low in range(0, len(rows), step):
                    of, text = [], []
                    for kind, h, distinct in _neighbourhood(codes[low : low + step], alphabet):
                        slot = _slots(h, width)
                        there = (held[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
                        hit = np.nonzero(distinct & (there > 0))
                        source = rows[low + hit[0]].tolist()
                        of += source
                        if kind == "delete":
                            text += [words[i][:p] + words[i][p + 1 :] for i, p in zip(source, hit[1].tolist())]
                        else:
                            skip = 1 if kind == "replace" else 0
                            text += [words[i][:p] + letters[c] + words[i][p + skip :] for i, p, c in zip(source, hit[1].tolist(), hit[2].tolist())]
                    if of:
                        yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array([words[i] for i in of], pa.string()), counts.take(pa.array(of))], ["candidate", "word", "n"])

    return words.select("word", "n").mapInArrow(emit, "candidate string, word string, n bigint")


def _shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast: Spark takes it for as small as the file it is
    computed from, and the driver would hold all of it."""
    return df.hint("merge")


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, doubling the way in each round."""
    way = work.written(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        on = way.select(F.col("word").alias("at"), F.col("root").alias("further"))
        way = work.written(way.join(_shuffled(on), way["root"] == on["at"], "left").select("word", F.coalesce("further", "root").alias("root")), "forms")
    return way


def variants(found: DataFrame, least_length: int = 6, least_count: int = 5, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all (word) rows.

    Words are those of at least ``least_length`` code points that occur ``least_count`` times.  A word's
    form is its near word (one code point inserted, deleted or replaced) of largest n, ties to the
    smallest by code points, if that is at least ``times`` the word's own n, else null; its root is where
    forms lead, itself if it has none.  Null words and other columns take no part; repeated rows count
    each; no words give an empty result.  The driver holds the alphabet and the bit set only, and no join
    is a broadcast.  A word has
    at most as many near words as candidates (twice its length times the alphabet), so no group is larger.
    """
    counted = found.where(F.col("word").isNotNull()).groupBy("word").agg(F.count("*").alias("n"))
    words = work.written(counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count)), "words")
    about = words.agg(F.count("*").alias("words"), F.max("n").alias("most")).first()
    alphabet = "".join(r[0] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().orderBy("c").collect())
    near = candidates(words, alphabet, bit_set(words, max(1, about["words"]))).groupBy("candidate").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("word").alias("form"))).alias("best")
    )
    linked = -F.col("best.less") >= times * F.col("n")
    out = words.join(_shuffled(near), words["word"] == near["candidate"], "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(linked, F.col("best.form")).alias("form"), F.when(linked, -F.col("best.less")).alias("form_n")
    )
    out = work.written(out, "near")
    steps = 1 + math.floor(math.log(max(1, (about["most"] or 1) / least_count), times) + 1e-9)
    ends = roots(out.where(F.col("form").isNotNull()), steps).withColumnRenamed("word", "of")
    return out.join(_shuffled(ends), out["word"] == ends["of"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 199, least_length: int = 6, least_count: int = 5, times: int = 5) -> DataFrame:
    """``variants`` of the letter runs of whole texts, with one run in ``one_in`` misspelt (see ``noisy``).
    Runs too short for a word are left out at once, as a deletion only shortens them."""
    return variants(noisy(runs(docs, id_col, text_col, least_length), one_in), least_length, least_count, times)
