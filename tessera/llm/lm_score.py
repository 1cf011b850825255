"""LM scoring (operator 7): a log-bilinear model trained by noise-contrastive estimation in numpy.

Words are known to the model as one of a bounded number of symbols: each of the most frequent words is
a symbol of its own, every other word falls into a class by its ending.  The model gives normalised
probabilities of the next symbol; within a class, words follow their smoothed counts in the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel, work

#: Words that are symbols, classes of the other words, words of context, width of the vectors.
SYMBOLS, CLASSES, CONTEXT, WIDTH = 768, 96, 2, 24
#: Noise samples for each word and those that the words of a step share, words in a step, and the step size.
NOISE, SHARED, STEP, RATE, SEED = 8, 64, 1024, 0.25, 11
#: Training tokens of a shard, about: a shard's texts are learnt from one after the other.
SHARD_TOKENS = 4_000_000
#: Words with counts that the scorer is sent; the rest are joined.  Both are exact.
SENT_WORDS = 1 << 16
#: Smoothing of the base model and inside classes.
ALPHA = 0.1
#: Bytes of text that are counted, and that are learnt from or scored, at once.
COUNT_BYTES, LEARN_BYTES = 8 << 20, 4 << 20

END = "\n"  # no word holds white space


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def ending_class(words: pa.Array) -> np.ndarray:
    """A class by the last two bytes of the word and whether it starts with an ASCII letter."""
    at = np.frombuffer(words.cast(pa.large_string()).buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = words.cast(pa.large_string()).buffers()[2]
    if data is None or not len(words):
        return np.zeros(len(words), np.int64)
    data = np.frombuffer(data, np.uint8)
    last, before = data[at[1:] - 1].astype(np.uint64), data[np.maximum(at[1:] - 2, at[:-1])].astype(np.uint64)
    return (kernel.mix(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(CLASSES)).astype(np.int64)


@dataclass
class Vocabulary:
    """``words``: the most frequent, as symbols 0 .. len-1; classes follow, then END.

    ``mass``: for each class the smoothed mass of its words, with one unseen word each.
    """

    words: list[str]
    counts: np.ndarray  # of every symbol in training texts
    mass: np.ndarray

    @property
    def size(self) -> int:
        return len(self.words) + CLASSES + 1

    def symbols(self, distinct: pa.Array) -> np.ndarray:
        at = pa.compute.index_in(distinct, pa.array(self.words, distinct.type))
        found = np.asarray(at.fill_null(-1))
        return np.where(found >= 0, found, len(self.words) + ending_class(distinct))


@dataclass
class Model:
    """p(s | context) ~ exp(sum_k <C_k * R[context_k], Q[s]> + b[s]), normalised over all symbols."""

    r: np.ndarray  # (symbols + 1, width): context vectors, the last for places before the text
    q: np.ndarray  # (symbols, width)
    c: np.ndarray  # (CONTEXT, width)
    b: np.ndarray

    def log_probs(self, context: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of all symbols after each context row, one matrix product."""
        hidden = sum(self.r[context[:, k]] * self.c[k] for k in range(CONTEXT))
        score = hidden @ self.q.T + self.b
        score -= score.max(axis=1, keepdims=True)
        return score - np.log(np.exp(score).sum(axis=1, keepdims=True))

    def token_log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target after its context; each distinct context is normalised once."""
        n = len(self.b) + 1
        code = context[:, 0].astype(np.int64)
        for k in range(1, CONTEXT):
            code = code * n + context[:, k]
        distinct, back = np.unique(code, return_inverse=True)
        order = np.argsort(back, kind="stable")
        back, out = back[order], np.empty(len(target), np.float64)
        contexts = np.stack([distinct // n ** (CONTEXT - 1 - k) % n for k in range(CONTEXT)], axis=1)
        for low in range(0, len(distinct), 2048):
            i, j = np.searchsorted(back, [low, low + 2048])
            p = self.log_probs(contexts[low : low + 2048])
            out[order[i:j]] = p[back[i:j] - low, target[order[i:j]]]
        return out


def initial(vocabulary: Vocabulary, seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    n = vocabulary.size
    p = (vocabulary.counts + 0.5) / (vocabulary.counts + 0.5).sum()
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return Model(draw(n + 1, WIDTH), draw(n, WIDTH), np.ones((CONTEXT, WIDTH), np.float32), np.log(p).astype(np.float32))


def squares(model: Model) -> list[np.ndarray]:
    """Adagrad's sums of squares at the start."""
    return [np.full(x.shape, 0.1, np.float32) for x in (model.r, model.q, model.c, model.b)]


def train(model: Model, vocabulary: Vocabulary, context: np.ndarray, target: np.ndarray, seed: int, rate: float = RATE, seen: list[np.ndarray] | None = None) -> Model:
    """One pass of noise-contrastive estimation by Adagrad over (context, target) rows, in their order.
    ``seen`` carries Adagrad's sums from one block of rows to the next.

    Noise follows the unigram counts; every step shares its noise words among its targets.  The data's
    word is told from noise by sigmoid(score - log(NOISE * p_noise)); scores are meant to be
    normalised as they are, and are normalised exactly when the model is used.
    """
    rng = np.random.default_rng(seed)
    p = (vocabulary.counts + 0.5) / (vocabulary.counts + 0.5).sum()
    log_kp = np.log(NOISE * p).astype(np.float32)
    edges = np.cumsum(p)
    m = Model(model.r.copy(), model.q.copy(), model.c.copy(), model.b.copy())
    seen = squares(m) if seen is None else seen

    def update(k: int, value: np.ndarray, g: np.ndarray) -> None:
        seen[k] += g * g
        value -= rate * g / np.sqrt(seen[k])

    for low in range(0, len(target), STEP):
        ctx, tgt = context[low : low + STEP], target[low : low + STEP]
        noise = np.minimum(np.searchsorted(edges, rng.random(SHARED)), len(p) - 1)
        rows = [m.r[ctx[:, k]] for k in range(CONTEXT)]
        hidden = sum(x * m.c[k] for k, x in enumerate(rows))
        true = (hidden * m.q[tgt]).sum(axis=1) + m.b[tgt] - log_kp[tgt]
        false = hidden @ m.q[noise].T + m.b[noise] - log_kp[noise]
        e_true = (1 / (1 + np.exp(-np.clip(true, -30, 30))) - 1).astype(np.float32)
        e_false = (1 / (1 + np.exp(-np.clip(false, -30, 30)))).astype(np.float32) * (NOISE / SHARED)
        g_hidden = e_true[:, None] * m.q[tgt] + e_false @ m.q[noise]
        both = np.r_[tgt, noise]
        g_rows = np.concatenate([e_true[:, None] * hidden, e_false.T @ hidden])
        update(1, m.q, _sums(g_rows, both, len(m.q)))
        update(3, m.b, np.bincount(both, np.r_[e_true, e_false.sum(axis=0)], len(m.b)).astype(np.float32))
        g_c = np.empty_like(m.c)
        g_context = [g_hidden * m.c[k] for k in range(CONTEXT)]
        for k in range(CONTEXT):
            g_c[k] = (g_hidden * rows[k]).sum(axis=0)
        update(2, m.c, g_c)
        update(0, m.r, _sums(np.concatenate(g_context), ctx.T.ravel(), len(m.r)))
    return m


def _sums(rows: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each group; groups of no rows are 0."""
    width = rows.shape[1]
    at = group.astype(np.int64)[:, None] * width + np.arange(width)
    return np.bincount(at.ravel(), rows.ravel(), n * width).astype(np.float32).reshape(n, width)


def contexts(symbol: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The CONTEXT symbols before each place of each text; ``start`` stands before a text."""
    begin = np.repeat(first[:-1], np.diff(first))
    at = np.arange(len(symbol))
    out = np.full((len(symbol), CONTEXT), start, np.int32)
    for k in range(CONTEXT):
        ok = at - k - 1 >= begin
        out[ok, k] = symbol[at[ok] - k - 1]
    return out


def encode(column: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(symbol, first, distinct words, word, word's place): symbols of each text with END at its end,
    and the words behind them."""
    w = kernel.words(column)
    coded = w.arrow().dictionary_encode()
    word = np.asarray(coded.indices)
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    place = np.arange(len(word)) + w.text_of()
    symbol = np.full(len(word) + n, vocabulary.size - 1, np.int32)
    symbol[place] = vocabulary.symbols(coded.dictionary)[word] if len(word) else 0
    return symbol, first, coded.dictionary, word, place


def word_counts(docs: DataFrame, text_col: str, training: Column) -> DataFrame:
    """(word, c): how often each token stands in the training texts, END for the ends of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in kernel.blocks(batch.column(0), COUNT_BYTES):
                coded = kernel.words(batch.column(0).slice(a, b - a)).arrow().dictionary_encode()
                n = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary))
                words = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([END])])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.r_[n, b - a])], ["word", "n"])

    return docs.where(training).select(text_col).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def vocabulary_of(counts: DataFrame, symbols: int = SYMBOLS, sent: int = SENT_WORDS) -> tuple[Vocabulary, list[str], np.ndarray, int, int]:
    """The symbols, the ``sent`` most frequent words with their counts, all training tokens (N) and
    distinct tokens (V).  Sums run over all words of the corpus; what reaches the driver is bounded."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, c = ending_class(batch.column(0)), np.asarray(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(np.bincount(k, minlength=CLASSES)), pa.array(np.bincount(k, c, CLASSES).astype(np.int64))], ["k", "words", "c"])

    plain = counts.where(F.col("word") != END)
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("c"))), F.lit(0))).first()
    top = plain.orderBy(F.desc("c"), "word").limit(sent).toArrow()
    top_words, top_counts = top["word"].to_pylist(), np.asarray(top["c"].combine_chunks() if top.num_rows else [], np.int64)
    by = plain.mapInArrow(classes, "k bigint, words bigint, c bigint").groupBy("k").agg(F.sum("words").alias("words"), F.sum("c").alias("c")).toArrow()
    kinds, total = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    if by.num_rows:
        at = np.asarray(by["k"].combine_chunks())
        kinds[at], total[at] = np.asarray(by["words"].combine_chunks()), np.asarray(by["c"].combine_chunks())
    words = top_words[:symbols]
    own = ending_class(pa.array(words, pa.large_string()))
    kinds -= np.bincount(own, minlength=CLASSES)
    total -= np.bincount(own, top_counts[: len(words)], CLASSES).astype(np.int64)
    vocabulary = Vocabulary(words, np.r_[top_counts[: len(words)], total, ends].astype(np.float64), total + ALPHA * (kinds + 1))
    return vocabulary, top_words, top_counts, int(n), int(v)


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.Array]]:
    """(shard, texts) of blocks of about ``most`` bytes; where blocks end depends on a shard's texts
    alone, not on the batches they come in."""
    shard, held = None, pa.array([], pa.string())
    for batch in batches:
        shards = np.asarray(batch.column(0))
        cuts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1], True]) if len(shards) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if shard is not None and shards[a] != shard and len(held):
                yield shard, held
                held = held[:0]
            shard = int(shards[a])
            held = pa.concat_arrays([held, batch.column(1).slice(a, b - a).cast(pa.string())])
            done = 0
            for low, high in kernel.blocks(held, most):
                if high < len(held):
                    yield shard, held.slice(low, high - low)
                    done = high
            held = held.slice(done)
    if shard is not None and len(held):
        yield shard, held


def fit(docs: DataFrame, id_col: str, text_col: str, training: Column, vocabulary: Vocabulary, tokens: int, rounds: int = 1) -> Model:
    """Trains on every token of all training texts.

    Texts are dealt to shards by a hash of id and text, in as many shards as the training ``tokens``
    need; equal texts of many rows are so spread too.  In each round every shard starts from the same
    model and runs over its texts in the order of their hashes, and the shards' models are averaged.
    Sums are kept in whole numbers, so the model is a function of the rows and not of their partitions.
    """
    model = initial(vocabulary)
    shapes = [x.shape for x in (model.r, model.q, model.c, model.b)]
    chunk, unit = 64, float(1 << 32)
    n_shards = max(1, -(-tokens // SHARD_TOKENS))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.where(training).select(F.xxhash64(F.col(id_col), text).alias("h"), text.alias("t"))
    rows = rows.select(F.pmod("h", F.lit(n_shards)).cast("int").alias("shard"), "h", "t")
    rows = rows.repartition(2 * n_shards, "shard").sortWithinPartitions("shard", "h", "t").select("shard", "t")
    for r in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast((model, vocabulary))

        def learn(batches: Iterator[pa.RecordBatch], r: int = r) -> Iterator[pa.RecordBatch]:
            model, vocabulary = sent.value
            now, done, seen, rng = None, model, [], np.random.default_rng(0)

            def parts() -> pa.RecordBatch:
                flat = np.concatenate([x.ravel() for x in (done.r, done.q, done.c, done.b)]).astype(np.float64)
                flat = np.rint(np.pad(flat, (0, -len(flat) % chunk)) * unit).astype(np.int64)
                n = len(flat) // chunk
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * chunk), pa.array(flat))
                return pa.RecordBatch.from_arrays([pa.array(np.arange(n)), lists], ["i", "x"])

            for shard, texts in _texts(batches, LEARN_BYTES):
                if shard != now:
                    if now is not None:
                        yield parts()
                    now, done, seen, rng = shard, model, squares(model), np.random.default_rng([SEED, r, shard])
                symbol, first, _, _, _ = encode(texts, vocabulary)
                order = rng.permutation(len(symbol))
                context = contexts(symbol, first, vocabulary.size)
                done = train(done, vocabulary, context[order], symbol[order], int(rng.integers(1 << 31)), RATE / (1 + r), seen)
            if now is not None:
                yield parts()

        models = rows.mapInArrow(learn, "i bigint, x array<bigint>")
        mean = models.groupBy("i").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("x", F.lit(k))) for k in range(chunk)]).alias("x")).orderBy("i").toArrow()
        sent.unpersist()
        if not mean.num_rows:
            return model
        flat = np.asarray(mean["x"].combine_chunks().flatten()) / unit / np.asarray(mean["n"])[0]
        parts_of, at = [], 0
        for shape in shapes:
            size = int(np.prod(shape))
            parts_of.append(flat[at : at + size].reshape(shape).astype(np.float32))
            at += size
        model = Model(*parts_of)
    return model


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of ``docs``.

    Tokens: the text's words with A-Z lower-cased, then one end.  A null text counts as empty: one
    token, its end.  Rows with a null id are training rows.  Scores are sums of log10 probabilities;
    with no training rows the base model gives every token the probability 1.  Repeated rows repeat
    their results; other columns are not read.  Results depend on the rows alone, not on how they are
    partitioned, up to the last digits of sums.
    """
    spark = docs.sparkSession
    training = ~held_out(id_col)
    counts = work.written(word_counts(docs, text_col, training), "counts")
    vocabulary, top_words, top_counts, n, v = vocabulary_of(counts)
    model = fit(docs, id_col, text_col, training, vocabulary, n, rounds)
    sent = spark.sparkContext.broadcast((model, vocabulary, pa.array(top_words, pa.large_string()), top_counts))
    log_all = float(np.log10(n + ALPHA * (v + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocabulary, top, top_counts = sent.value
        key = TaskContext.get().partitionId() << 40
        n_words = len(vocabulary.words)
        ends = vocabulary.counts[-1]
        for batch in batches:
            for a, b in kernel.blocks(batch.column(1), LEARN_BYTES):
                symbol, first, distinct, word, place = encode(batch.column(1).slice(a, b - a), vocabulary)
                size = b - a
                p = model.token_log_probs(contexts(symbol, first, vocabulary.size), symbol) / np.log(10)
                text = np.repeat(np.arange(size), np.diff(first))
                own = np.bincount(text, p, size)
                at = np.asarray(pa.compute.index_in(distinct, top).fill_null(-1)) if len(distinct) else np.zeros(0, np.int64)
                c = np.where(at >= 0, top_counts[at] if len(top_counts) else 0, 0)
                sure = at >= 0
                log_c = np.where(sure, np.log10(c + ALPHA), 0.0)
                word_text = text[place]
                in_class = symbol[place] >= n_words
                log_mass = np.log10(vocabulary.mass)[np.where(in_class, symbol[place] - n_words, 0)]
                inside = np.where(in_class, log_c[word] - log_mass, 0.0)
                base = np.bincount(word_text, log_c[word], size) + np.log10(ends + ALPHA) - np.diff(first) * log_all
                known = np.bincount(word_text, sure[word], size).astype(np.int64) + int(ends > 0)
                own = own + np.bincount(word_text, inside, size)
                keys = key + np.arange(size)
                key += size
                yield _rows(batch.column(0).slice(a, size), keys, np.diff(first), known, base, own)
                rare = np.flatnonzero(~sure[word])
                if len(rare):
                    rare = rare[np.argsort(word[rare], kind="stable")]
                    cut = np.flatnonzero(np.r_[True, word[rare][1:] != word[rare][:-1]])
                    yield _postings(batch.schema.field(0).type, distinct.take(pa.array(word[rare][cut])), np.r_[cut, len(rare)], keys[word_text[rare]])

    kind = docs.schema[id_col].dataType.simpleString()
    done = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).mapInArrow(score, f"id {kind}, key bigint, n_tokens bigint, n_known bigint, base double, own double, word string, keys array<bigint>")
    done = work.written(done, "scored")
    rare = done.where(F.col("word").isNotNull()).select("word", "keys")
    rare = rare.join(counts.select(F.col("word").alias("w"), "c"), F.col("word") == F.col("w"), "left").select(F.explode("keys").alias("r_key"), F.coalesce("c", F.lit(0)).alias("c"))
    rare = rare.groupBy("r_key").agg(F.sum(F.log10(F.col("c") + F.lit(ALPHA))).alias("more"), F.count_if(F.col("c") > 0).alias("known"))
    out = done.where(F.col("word").isNull()).join(rare, F.col("key") == F.col("r_key"), "left")
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("own") + more).alias("score"))


_NAMES = ["id", "key", "n_tokens", "n_known", "base", "own", "word", "keys"]


def _rows(ids: pa.Array, keys: np.ndarray, n_tokens: np.ndarray, known: np.ndarray, base: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([ids, pa.array(keys), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(own), pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.int64()))], _NAMES)


def _postings(kind: pa.DataType, words: pa.Array, at: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    n = len(words)
    none = [pa.nulls(n, t) for t in (kind, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
    return pa.RecordBatch.from_arrays([*none, words.cast(pa.string()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys))], _NAMES)
