"""Many phrases sought at once: each text is read once, whatever the size of the table of phrases.

A phrase stands in a text if it is there between characters that are no word characters.  So its words are
a run of the text's words, and the hash of a run's bytes finds it in a table of all phrases by one
lookup; what the lookup gives is compared byte by byte.  Phrases go out in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.spans import Spans, blocks

#: Phrases, and bytes of them, that go out at once; larger tables take a pass over the texts for each block.
BLOCK_PHRASES, BLOCK_BYTES = 1 << 20, 1 << 26


class Phrases:
    """A table of phrases by the hashes of their words: from the first word character to the last."""

    def __init__(self, phrases: list[str], underscore: bool = True):
        self.phrases, self.underscore = [p.encode() for p in phrases], underscore
        spans = Spans(pa.array(phrases, pa.string()), underscore)
        n = np.diff(spans.first)
        self.bare = np.flatnonzero(n == 0).tolist()  # phrases without a word character
        worded = np.flatnonzero(n > 0)
        low, high = spans.low[spans.first[worded]], spans.high[spans.first[worded + 1] - 1]
        h = spans.hashes(low, high)
        order = np.argsort(h, kind="stable")
        self.hash, self.id = h[order], worded[order]
        self.before = (low - spans.at[worded])[order]  # bytes of the phrase before its first word
        self.size = np.diff(spans.at)[self.id]
        self.plain = self.size == (high - low)[order]  # from word to word: nothing stands before or behind
        self.data, self.at = spans.data, spans.at[self.id]
        self.sizes = sorted(set(n[worded].tolist()))
        # a bit for the top of each hash: most runs are no phrase and are turned away by one look
        self.bits = max(10, min(27, (16 * len(h)).bit_length()))
        self.set = np.zeros(1 << self.bits, bool)
        self.set[self.hash >> np.uint64(64 - self.bits)] = True

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, phrase) of every place where a phrase stands."""
        spans = Spans(texts, self.underscore)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        out: list[tuple[int, int]] = []
        data = spans.data.tobytes()
        for n in self.sizes:
            row, low, high = spans.runs(n)
            h = spans.hashes(low, high)
            near = np.flatnonzero(self.set[h >> np.uint64(64 - self.bits)])
            first, last = np.searchsorted(self.hash, h[near], "left"), np.searchsorted(self.hash, h[near], "right")
            many = last - first
            k = np.repeat(near, many)  # the run, and the phrase that has its hash
            j = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(k))
            same = self.plain[j] & (self.size[j] == high[k] - low[k])
            same[same] = self._equal(spans.data, low[k[same]], j[same])
            pairs.append((row[k[same]], self.id[j[same]]))
            for k, j in zip(k[~self.plain[j]].tolist(), j[~self.plain[j]].tolist()):
                if self._stands(data, spans, int(row[k]), int(low[k] - self.before[j]), self.phrases[self.id[j]]):
                    out.append((int(row[k]), int(self.id[j])))
        for j in self.bare:
            for i in range(len(texts)):
                phrase, at = self.phrases[j], int(spans.at[i]) - 1
                while phrase and (at := data.find(phrase, at + 1, int(spans.at[i + 1]))) >= 0:
                    if self._stands(data, spans, i, at, phrase):
                        out.append((i, j))
        rest = np.array(out, np.int64).reshape(-1, 2)
        return np.concatenate([*(r for r, _ in pairs), rest[:, 0]]), np.concatenate([*(j for _, j in pairs), rest[:, 1]])

    def _equal(self, data: np.ndarray, low: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the text has the bytes of phrase j from ``low`` on."""
        size = self.size[j]
        if not len(j):
            return np.zeros(0, bool)
        start = np.cumsum(size) - size
        on = np.arange(int(size.sum()))
        unequal = data[np.repeat(low - start, size) + on] != self.data[np.repeat(self.at[j] - start, size) + on]
        return np.add.reduceat(unequal, start) == 0

    @staticmethod
    def _stands(data: bytes, spans: Spans, i: int, start: int, phrase: bytes) -> bool:
        low, high, end = int(spans.at[i]), int(spans.at[i + 1]), start + len(phrase)
        return low <= start and end <= high and data[start:end] == phrase and not (start > low and spans.word[start - 1]) and not (end < high and spans.word[end])


def find(rows: DataFrame, key: str, body: str, phrases: DataFrame, phrase: str = "phrase", underscore: bool = True, most: int = BLOCK_PHRASES, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, phrase, hits): how often each phrase stands in each row's text, both in lower case; whether
    ``_`` is a word character is told by ``underscore``.

    Distinct phrases are sought; null and empty ones and null texts give nothing.  Rows are told apart by
    their key: rows of one key give their own hits each.  Other columns are not read, texts are not
    shuffled.
    """
    sought = phrases.select(F.lower(phrase).alias("p")).where("p <> ''").distinct()
    size = sought.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("p")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(1, -(-size["n"] // most), -(-size["bytes"] // most_bytes))
    kind = rows.schema[key].dataType.simpleString()
    out = None
    for b in range(n_blocks):
        part = sought if n_blocks == 1 else sought.where(F.pmod(F.xxhash64("p"), F.lit(n_blocks)) == b)
        sent = rows.sparkSession.sparkContext.broadcast([r[0] for r in part.orderBy("p").collect()])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            table = Phrases(sent.value, underscore)
            names = pa.array(sent.value, pa.string())
            for batch in batches:
                for low, high in blocks(batch.column(1)):
                    row, which = table.found(batch.column(1).slice(low, high - low))
                    pair, hits = np.unique(row * max(1, len(names)) + which, return_counts=True)
                    row, which = pair // max(1, len(names)), pair % max(1, len(names))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(low + row)), names.take(pa.array(which)), pa.array(hits.astype(np.int64))], [key, "phrase", "hits"])

        found = rows.select(F.col(key), F.lower(F.coalesce(F.col(body), F.lit(""))).alias("_t")).mapInArrow(run, f"`{key}` {kind}, phrase string, hits bigint")
        out = found if out is None else out.unionAll(found)
    return out


def rule_table(rules: DataFrame, order: str | None = None) -> DataFrame:
    """(pattern, skill, place): rules (patterns, skills) as one row for each pattern and skill.  ``order``
    names the column that the rules are in order of; without it they are in order of their first pattern."""
    at = F.col(order).cast("string") if order else F.element_at("patterns", 1)
    place = F.col(order).cast("long") if order else F.lit(0).cast("long")
    one = rules.select(place.alias("rule"), at.alias("name"), "patterns", F.posexplode("skills").alias("i", "skill"))
    return one.select(F.explode(F.transform("patterns", lambda p: F.lower(p))).alias("pattern"), "skill", F.struct("rule", "name", "i").alias("place"))


def rule_skills(rows: DataFrame, key: str, body: str, rules: DataFrame) -> DataFrame:
    """(key, skills): the skills of the rules (``rule_table``) of which a pattern stands in a row's text, in
    the order of rules, each once.  Keys without a skill have an empty list; keys are taken as distinct."""
    hits = find(rows, key, body, rules, "pattern")
    met = hits.join(rules, hits["phrase"] == rules["pattern"]).groupBy(key, "skill").agg(F.min("place").alias("place"))
    lists = met.groupBy(F.col(key).alias("_k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "skill"))), lambda s: s["skill"]).alias("skills"))
    out = rows.select(key).join(lists, F.col(key) == F.col("_k"), "left")
    return out.select(key, F.coalesce("skills", F.array().cast("array<string>")).alias("skills"))


def keyword_skills(rows: DataFrame, key: str, body: str, vocabulary: DataFrame, skill: str = "skill", n: int = 5) -> DataFrame:
    """(key, skill, hits, rank): ``extract.keyword_hits`` for a vocabulary of any size: how many chunks of a
    text name each skill; the n best by hits, words and length."""
    parts = rows.select(key, F.posexplode(text.chunks(F.lower(F.col(body)))).alias("_i", "_c"))
    found = find(parts.select(F.struct(F.col(key).alias("k"), F.col("_i").alias("i")).alias("_at"), "_c"), "_at", "_c", vocabulary, skill, underscore=False)
    counts = found.groupBy(F.col("_at.k").alias(key), F.col("phrase").alias("skill")).agg(F.count("*").alias("hits"))
    order = Window.partitionBy(key).orderBy(F.desc("hits"), F.desc(F.size(F.split("skill", " "))), F.desc(F.length("skill")), "skill")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
