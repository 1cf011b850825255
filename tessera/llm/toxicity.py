"""Toxicity (operator 4): subword-bag embeddings averaged into a linear softmax, trained jointly."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel

#: Bound of the labelled sample that training takes, of each label, and of the words it may hold.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 10 << 20
#: Pieces in which a text too long for that bound is learnt from.
PIECES = 16
#: Features that fewer sampled windows hold are left at 0, as they could only be memorised.
LEAST_TEXTS = 4
#: Hash rows of the embedding table, its width, and the character n-grams of a word besides itself.
BUCKETS, WIDTH, GRAMS = 1 << 18, 8, (3, 4, 5)
EPOCHS, RATE, SEED = 8, 0.5, 7
BATCH, LEAST_STEPS = 128, 800
#: Words of a window, and the empty features that every average also takes in, so that a few words
#: of weak evidence stay weak.
WINDOW, PADDING = 128, 200
#: Pull of every seen feature towards 0.
DECAY = 2e-4
#: Distinct words whose margins a worker remembers.
REMEMBERED = 60_000

_U = np.uint64

def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, first): the hashed features of each word are bucket[first[i]:first[i+1]]: the word
    itself and its character n-grams with the word's ends marked."""
    n = len(words)
    codes = np.frombuffer("".join(f"<{w}>" for w in words.to_pylist()).encode("utf-32-le"), np.uint32).astype(_U)
    sizes = np.asarray(pa.compute.utf8_length(words)).astype(np.int64) + 2
    at = np.r_[0, np.cumsum(sizes)]
    owner = np.repeat(np.arange(n), sizes)
    left = at[1:][owner] - np.arange(len(codes))
    hashed, who = [], []
    rolling = np.zeros(len(codes), _U)
    for k in range(max(GRAMS)):
        m = max(0, len(codes) - k)
        rolling[:m] = rolling[:m] * _U(1_000_003) + codes[k:] + _U(1)
        if k + 1 in GRAMS:
            ok = left > k
            hashed.append(rolling[ok] + _U(k + 1))
            who.append(owner[ok])
    base = kernel.Words(np.frombuffer("".join(words.to_pylist()).encode(), np.uint8), np.r_[0, np.cumsum(np.asarray(pa.compute.binary_length(words)))].astype(np.int64), np.array([0, n]))
    hashed.append(base.hashes())
    who.append(np.arange(n))
    flat, who = kernel.mix(np.concatenate(hashed)), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return (flat[order] % _U(BUCKETS)).astype(np.int32), np.r_[0, np.cumsum(np.bincount(who, minlength=n))]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased words of a block of texts, the number of each word in it, and the first
    word of each text."""
    lowered = pa.compute.utf8_lower(texts.fill_null("") if texts.null_count else texts)
    w = kernel.words(lowered, lower=False, space=kernel.PUNCTUATION)
    coded = w.arrow().dictionary_encode()
    return coded.dictionary.cast(pa.string()), np.asarray(coded.indices), w.first


def windows(codes: np.ndarray, first: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, word) pairs without repeats, sorted, and the first window of each text.  A text falls
    into windows of about ``WINDOW`` words, equal but for one word; a text of no words has one window."""
    n = np.diff(first)
    parts = np.maximum(1, np.rint(n / WINDOW).astype(np.int64))
    start = np.r_[0, np.cumsum(parts)]
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(codes)) - first[text]
    pair = np.unique((start[text] + place * parts[text] // np.maximum(n[text], 1)) * max(1, distinct) + codes)
    return pair // max(1, distinct), pair % max(1, distinct), start


@dataclass
class Model:
    """``margin[b]``: what a feature in bucket b adds to the logit of the label before averaging."""

    margin: np.ndarray
    bias: float

    def word_margins(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bucket, first = word_features(words)
        return np.add.reduceat(self.margin[bucket], first[:-1]) if len(words) else np.zeros(0), np.diff(first)


def logits(table: np.ndarray, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The highest average of any window of each text; ``table``: margin and features of each word."""
    window, word, start = windows(codes, first, len(table))
    sums = np.zeros((start[-1], 2))
    begins = np.searchsorted(window, np.arange(start[-1]))
    full = np.flatnonzero(np.diff(np.r_[begins, len(window)]))
    if len(full):
        sums[full] = np.add.reduceat(table[word], begins[full])
    return np.maximum.reduceat(sums[:, 0] / (sums[:, 1] + PADDING), start[:-1]) if len(first) > 1 else np.zeros(0)


def train(texts: list[str | None], labels: np.ndarray, seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """Trains embedding table E and softmax W together by Adagrad on softmax(mean of E rows @ W).

    The bag of a window holds each of its words once; every window carries its text's label.

    Two labels: the softmax needs only the difference of the two columns of W.  With one label or no
    text the model is the constant that fits.
    """
    labels = np.asarray(labels, np.float64)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = float(np.log(share / (1 - share)))
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), bias)
    cols, times, sizes, scales, owner = [], [], [], [], []
    held = np.zeros(BUCKETS, np.int64)
    for a, b in kernel.blocks(arr := pa.array(texts, pa.string()), 1 << 17):
        words, codes, first = split(arr.slice(a, b - a))
        bucket, at = word_features(words)
        window, word, start = windows(codes, first, len(words))
        size = np.diff(at)[word]
        total = np.bincount(window, size, start[-1]) + PADDING
        flat = np.repeat(at[word], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        key, n = np.unique(np.repeat(window, size) * BUCKETS + bucket[flat], return_counts=True)
        cols.append((key % BUCKETS).astype(np.int32))
        times.append(np.minimum(n, 255).astype(np.uint8))
        sizes.append(np.bincount(key // BUCKETS, minlength=start[-1]))
        scales.append((1 / total).astype(np.float32))
        owner.append(np.repeat(np.arange(a, b), np.diff(start)))
        held += np.bincount(cols[-1], minlength=BUCKETS)
    often = held >= LEAST_TEXTS
    for i, c in enumerate(cols):
        keep = often[c]
        row = np.repeat(np.arange(len(sizes[i])), sizes[i])[keep]
        cols[i], times[i], sizes[i] = c[keep], times[i][keep], np.bincount(row, minlength=len(sizes[i]))
    cols, times, scales = np.concatenate(cols), np.concatenate(times), np.concatenate(scales)
    first = np.r_[0, np.cumsum(np.concatenate(sizes))]
    labels = labels[np.concatenate(owner)]
    share = labels.mean()
    bias = float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    table = (rng.standard_normal((BUCKETS, WIDTH)) * 0.1).astype(np.float32)
    head = (rng.standard_normal(WIDTH) * 0.5).astype(np.float32)
    seen_table, seen_head, seen_bias = np.full((BUCKETS, WIDTH), 1e-8, np.float32), np.full(WIDTH, 1e-6, np.float32), 1e-6
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(labels)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 0.02
        order = rng.permutation(len(labels))
        for s in range(0, len(order), BATCH):
            batch = np.sort(order[s : s + BATCH])
            size = first[batch + 1] - first[batch]
            at = np.repeat(first[batch], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            row, col = np.repeat(np.arange(len(batch)), size), cols[at]
            val = times[at] * scales[batch][row]
            mean = np.zeros((len(batch), WIDTH), np.float32)
            full = np.flatnonzero(size)
            if len(at):
                mean[full] = np.add.reduceat(table[col] * val[:, None], np.r_[0, np.cumsum(size[full])[:-1]])
            p = 1 / (1 + np.exp(-np.clip(mean @ head + bias, -30, 30)))
            err = ((p - labels[batch]) * weight[batch]).astype(np.float32)
            used, back = np.unique(col, return_inverse=True)
            scale = np.bincount(back, err[row] * val, len(used)).astype(np.float32) / len(batch)
            g = scale[:, None] * head + DECAY / len(order) * len(batch) * table[used]
            seen_table[used] += g * g
            g_head = mean.T @ err / len(batch)
            table[used] -= rate * g / np.sqrt(seen_table[used])
            seen_head += g_head * g_head
            head -= 0.2 * rate * g_head / np.sqrt(seen_head)
            g_bias = float(err.mean())
            seen_bias += g_bias * g_bias
            bias -= 0.2 * rate * g_bias / seen_bias**0.5
    return Model(np.where(often, table @ head, np.float32(0)), bias)


def learns(id_col: str) -> Column:
    """Rows that training may use: crc32 of the id as text modulo 3 is not 1."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) != 1


def level(sizes: np.ndarray, total: int) -> int:
    """The size to which the largest come down so that all add up to ``total`` at most."""
    ordered = np.sort(sizes)
    left, k = total - (np.cumsum(ordered) - ordered), np.arange(len(sizes), 0, -1)  # for each and all larger ones
    over = np.flatnonzero(ordered * k > left)  # from the first on all come down
    return max(1, int(left[over[0]] // k[over[0]])) if len(over) else total


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``sample_rows`` labelled texts of each label (those whose hashed ids are
    smallest), and at most about ``SAMPLE_BYTES`` of text.  Where these texts are longer together, the
    longest are learnt from in part, ``PIECES`` pieces spread evenly over each, of one total length for
    all of them, so no text keeps others out.  Rows with a null label, text or id teach nothing; a warning
    says so if nothing is left to learn from, as every score is then the same.  The sample is learnt from in
    a task: only its texts' lengths and the model reach the driver."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learns(id_col)).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).alias("y"))
    picked = None
    for y in (0, 1):
        some = marked.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(sample_rows)
        picked = some if picked is None else picked.unionAll(some)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(text_col).alias("x"))
    both = texts.join(F.broadcast(picked), "k")  # at most 2 * sample_rows ids
    chosen = both.select("k", F.octet_length("x").cast("long").alias("n")).orderBy(F.xxhash64("k"), "k", "n").limit(2 * sample_rows).toArrow()
    n = np.asarray(chosen["n"].combine_chunks() if chosen.num_rows else [], np.int64)
    if not len(n):
        warnings.warn("no labelled text to learn toxicity from: every score is the same", stacklevel=2)
    if n.sum() > SAMPLE_BYTES:
        most = level(n, SAMPLE_BYTES)
        chars = F.floor(F.lit(float(most)) / PIECES * F.length("x") / F.octet_length("x")).cast("int")
        start = lambda i: (i * (F.length("x") - chars) / (PIECES - 1)).cast("int") + 1
        pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(F.col("x"), start(i), chars))
        both = both.withColumn("x", F.when(F.octet_length("x") > most, F.array_join(pieces, " ")).otherwise(F.col("x")))
    if not len(n):
        return train([], n)
    rows = both.select("k", "y", "x").limit(2 * sample_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([*batches]).sort_by([("k", "ascending"), ("x", "ascending")])
        labels, texts = np.asarray(rows["y"].combine_chunks(), np.float64), rows["x"].to_pylist()
        del rows
        model = train(texts, labels)
        del texts
        yield pa.RecordBatch.from_arrays([pa.array([model.margin.tobytes()], pa.binary()), pa.array([model.bias])], ["margin", "bias"])
        kernel.release()

    model = rows.coalesce(1).mapInArrow(learn, "margin binary, bias double").first()
    return Model(np.frombuffer(model["margin"], np.float32), model["bias"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """``keep`` columns (the id by default) with score (0 to 1) and predicted (1 from ``threshold``).

    A text scores as its most toxic window, so a long clean part hides nothing.  A null or empty text, or one of no words, gets the model's constant; repeated rows
    and equal texts score alike.
    """
    keep = keep or [id_col]
    place_of_text = keep.index(text_col) if text_col in keep else len(keep)  # a kept text is sent once
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        known: dict[str, int] = {}  # place in the remembered table
        held = np.zeros((REMEMBERED, 2))
        for batch in batches:
            column = batch.column(place_of_text)
            out = np.zeros(batch.num_rows)
            for a, b in kernel.blocks(column):
                words, codes, first = split(column.slice(a, b - a))
                texts = words.to_pylist()
                place = np.array([known.get(w, -1) for w in texts], np.int64)
                table = held[place]
                new = np.flatnonzero(place < 0)
                if len(new):
                    table[new] = np.stack(model.word_margins(words.take(pa.array(new))), axis=1)
                    more = new[: REMEMBERED - len(known)]
                    held[len(known) : len(known) + len(more)] = table[more]
                    low = len(known)
                    known.update((texts[i], low + k) for k, i in enumerate(more))
                out[a:b] = logits(table, codes, first) + model.bias
            p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*keep, "score", "predicted"])
            kernel.release()

    chosen = docs.select(*keep) if text_col in keep else docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return chosen.mapInArrow(run, f"{schema}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    Only texts and the labels of rows that ``learns`` are used.  A null id is never learnt from and
    not held out; repeated labels of an id count once, as the highest; other columns are not read.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    done = score(docs, model, id_col, text_col, threshold=threshold)
    return done.select(id_col, F.coalesce(~learns(id_col), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """The rows and columns of ``docs`` that score below ``threshold``; repeated rows stay or go together,
    and columns may bear any names."""
    model = fit(docs, labels, id_col, text_col, label_col)
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]  # so that no column clashes with the score's
    scored = score(docs.toDF(*plain), model, text_col=plain[names.index(text_col)], keep=plain, threshold=threshold)
    return scored.where("predicted = 0").select(*[F.col(p).alias(n) for p, n in zip(plain, names)])
