"""Skills from course and job texts: keyword, rule, phrase and similarity extractors, and their merging."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import values
from tessera.functions import grams, text
from tessera.functions.arrays import first_by_key, once
from tessera.functions.fuzzy import mmr
from tessera.functions.runs import Runs
from tessera.operators.embed import EMBED_ROWS, Embedder, HashingEmbedder, nearest
from tessera.sources import shared

#: Bytes of the texts whose n-grams are ranked at once, or one text if longer.
TEXT_BYTES = 1 << 21


def skill_like(x: Column | str, labels: Sequence[str] = values.ACADEMIC_LABELS, talk: Sequence[str] = values.COURSE_TALK) -> Column:
    """Whether a phrase may be a skill: 2 to 80 characters, no subject's label, no course talk in it."""
    s = F.trim(F.lower(text.col(x)))
    return F.length(s).between(2, 80) & ~s.isin(*labels) & ~F.exists(F.lit(list(talk)), lambda t: F.contains(s, t))


def keyword_hits(rows: DataFrame, key: str, body: str, vocabulary: Sequence[str] = (*values.COURSE_HARD_SKILLS, *values.COURSE_SOFT_SKILLS), n: int = 5) -> DataFrame:
    """(key, skill, hits, rank): the chunks of a text that name each skill; the n best by hits, words
    and length.  Vocabularies are lists of fixed size, held as a literal.

    Skills of plain words are found among a chunk's runs of words by hash, and those of several words
    then by their exact spelling; skills with other characters by a pattern each.
    """
    skills = sorted({v.lower() for v in vocabulary})
    plain = [v for v in skills if re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", v)]
    chunk, none = F.col("chunk"), F.array().cast("array<string>")
    found = none
    if plain:
        longest = max(len(v.split(" ")) for v in plain)
        runs = F.flatten(F.array(*[text.grams("_words", k) for k in range(1, longest + 1)]))
        found = F.filter(F.array_intersect(runs, F.lit(plain)), lambda v: ~F.contains(v, F.lit(" ")) | F.rlike(chunk, F.concat(F.lit("(^|[^a-z0-9])"), v, F.lit("([^a-z0-9]|$)"))))
    marked = [F.when(chunk.rlike(f"(^|[^a-z0-9]){re.escape(v)}([^a-z0-9]|$)"), F.lit(v)) for v in skills if v not in plain]
    if marked:
        found = F.concat(found, F.array_compact(F.array(*marked)))
    parts = rows.select(key, F.explode(text.chunks(F.lower(body))).alias("chunk")).select(key, "chunk", F.split("chunk", "[^a-z0-9]+").alias("_words"))
    counts = parts.select(key, F.explode(found).alias("skill")).groupBy(key, "skill").agg(F.count("*").alias("hits"))
    order = Window.partitionBy(key).orderBy(F.desc("hits"), F.desc(F.size(F.split("skill", " "))), F.desc(F.length("skill")), "skill")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def rule_hits(body: Column | str, rules: Sequence[tuple[Sequence[str], Sequence[str]]] = values.MODULE_RULES) -> Column:
    """Skills of the rules of which a pattern is in the text, in rule order, without repeats."""
    t = F.lower(F.coalesce(text.col(body), F.lit("")))
    none = F.array().cast("array<string>")
    parts = []
    for patterns, skills in rules:
        hit = text.contains_phrase(t, patterns[0])
        for p in patterns[1:]:
            hit = hit | text.contains_phrase(t, p)
        parts.append(F.when(hit, F.lit(list(skills))).otherwise(none))
    return F.array_distinct(F.flatten(F.array(*parts))) if parts else none


def _stands_in(body: Column, phrase: Column) -> Column:
    """Whether ``phrase`` stands in ``body`` between word bounds; both may be columns."""
    return F.rlike(body, F.concat(F.lit("(?<!\\w)\\Q"), phrase, F.lit("\\E(?!\\w)")))


def practical_phrases(phrases: Column | str, body: Column | str, anchors: Sequence[str] = values.ANCHORS, blocked: Sequence[str] = values.BLOCKED_PHRASES) -> Column:
    """Phrases of two words or more that are like skills, hold an anchor, stand in the text and are not
    blocked; each once."""
    t = F.lower(F.coalesce(text.col(body), F.lit("")))
    anchor = "|".join(re.escape(a) for a in anchors)

    def fits(p: Column) -> Column:
        low = F.lower(p)
        return skill_like(p) & ~low.isin("", *blocked) & (F.size(F.split(F.trim(low), "\\s+")) >= 2) & low.rlike(f"(?<!\\w)(?:{anchor})(?!\\w)") & _stands_in(t, low)

    return F.array_distinct(F.filter(text.col(phrases), fits))


def merged(*lists: Column | str, n: int = 10) -> Column:
    """The lists in order, the first spelling of each skill, n at most."""
    return F.slice(first_by_key(*lists), 1, n)


def candidates(rows: DataFrame, key: str, body: str, stop: Sequence[str] = values.STOP_WORDS, most_chars: int | None = 2500, keep: Sequence[str] = ()) -> DataFrame:
    """(key, kept columns, candidates): n-grams of 1 to 3 words of a text's first ``most_chars``
    characters (None: all of them), stop words left out before."""
    part = F.col(body) if most_chars is None else F.left(F.col(body), F.lit(most_chars))
    words = F.filter(F.split(text.search_key(part), " "), lambda w: (F.length(w) > 1) & ~w.isin(*stop))
    listed = rows.select(key, *keep, words.alias("_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for lists in grams.blocks(batch.column(batch.num_columns - 1)):
                part = batch.slice(low, len(lists))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], grams.distinct_ngrams(lists, 1, 3)], [*part.schema.names[:-1], "candidates"])
                low += len(lists)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema[:-1])
    return listed.mapInArrow(run, f"{kept}, candidates array<string>")


def _parts(pdf: pd.DataFrame, listed: str, most: int = 4096) -> Iterator[pd.DataFrame]:
    """Rows in order, cut so that a part's lists hold about ``most`` values; a longer list is a part."""
    size = pdf[listed].map(lambda x: 0 if x is None else len(x)).to_numpy().cumsum()
    low = 0
    while low < len(pdf):
        high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + most, "right")))
        yield pdf.iloc[low:high]
        low = high


def ranked_candidates(rows: DataFrame, key: str, body: str, listed: str, embedder: Embedder, n: int = 30, diversity: float | None = None) -> DataFrame:
    """(key, phrases): the candidates most like the text; with ``diversity`` picked by marginal relevance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows of a few thousand phrases at a time, whose distinct phrases are embedded at once
        for pdf in (part for batch in batches for part in _parts(batch, listed)):
            out = []
            seen = {p: i for i, p in enumerate(dict.fromkeys(p for ps in pdf[listed] if ps is not None for p in ps))}
            known = embedder(list(seen)) if seen else np.zeros((0, 0))
            bodies = embedder([b or "" for b in pdf[body]])
            for query, phrases in zip(bodies, pdf[listed]):
                phrases = list(phrases) if phrases is not None else []
                if not phrases:
                    out.append([])
                    continue
                vectors = known[[seen[p] for p in phrases]]
                order = np.argsort(-np.round(vectors @ query, 10), kind="stable")[:n] if diversity is None else mmr(query, vectors, n, diversity)
                out.append([phrases[i] for i in order])
            yield pd.DataFrame({key: pdf[key], "phrases": out})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, body, listed).mapInPandas(run, f"`{key}` {kind}, phrases array<string>")


def ranked_ngrams(rows: DataFrame, key: str, body: str, embedder: Embedder, n: int = 30, diversity: float | None = None, stop: Sequence[str] = values.STOP_WORDS, most_chars: int | None = 2500) -> DataFrame:
    """(key, phrases): what ``ranked_candidates`` finds among the ``candidates`` of a text's first ``most_chars``
    characters (None: all of them), compared with these.

    Vectors that add up (``HashingEmbedder``) are made of a text's words alone: an n-gram's likeness is a sum
    over its words and the gaps between them, and only the best become strings.  Any other embedder is
    given every n-gram.
    """
    part = F.col(body) if most_chars is None else F.left(F.col(body), F.lit(most_chars))
    rows = shared.dealt(rows.select(key, part.alias(body)), key)
    if type(embedder) is not HashingEmbedder or not embedder.adds_up:
        return ranked_candidates(candidates(rows, key, body, stop, None, keep=(body,)), key, body, "candidates", embedder, n, diversity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_out = pa.array(stop, pa.string())
        for batch in batches:
            for low, high in grams.spans(np.asarray(pc.binary_length(batch.column(2)), np.int64), TEXT_BYTES):
                keys, texts, lists = batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pc.split_pattern(batch.column(2).slice(low, high - low), " ")
                found = pa.array(_best_ngrams(texts.to_pylist(), lists, left_out, embedder, n, diversity), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([keys, found], [key, "phrases"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, body, text.search_key(body)).mapInArrow(run, f"`{key}` {kind}, phrases array<string>")


def _small(embedder: HashingEmbedder, names: list[str], most: int) -> np.ndarray:
    """The sums of words as 8-bit numbers, if none is beyond ``most``."""
    out = np.zeros((len(names), embedder.width), np.int8)
    for low in range(0, len(names), EMBED_ROWS):
        part = embedder.sums(names[low : low + EMBED_ROWS])
        if np.abs(part).max() > most:
            return embedder.sums(names)
        out[low : low + len(part)] = part
    return out


def _best_ngrams(texts: list[str | None], lists: pa.Array, left_out: pa.Array, embedder: HashingEmbedder, n: int, diversity: float | None) -> Iterator[list[str]]:
    """The best n-grams of each text, from the lists of their words."""
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary
    fits = pc.and_(pc.greater(pc.utf8_length(names), 1), pc.invert(pc.is_in(names, left_out)))
    kept = pc.indices_nonzero(fits).take(pc.sort_indices(names.filter(fits)))
    place = np.full(len(names), -1)
    place[np.asarray(kept)] = np.arange(len(kept))
    words = place[np.asarray(coded.indices)]
    ends = np.r_[0, np.cumsum(words >= 0)][np.r_[0, np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))]]
    words, names = words[words >= 0], names.take(kept).to_pylist()
    dims, signs = embedder.gaps(names, words[:-1], words[1:])
    known = _small(embedder, names, (127 - 2 * dims.shape[1]) // 3)
    signs = signs.astype(known.dtype)
    queries = embedder.sums([b or "" for b in texts])
    for query, low, high in zip(queries, ends, ends[1:]):
        if low == high:
            yield []
            continue
        found = Runs(words[low:high], known, dims[low : high - 1], signs[low : high - 1])
        yield found.phrases(found.best(found.likeness(query), n) if diversity is None else found.picked(query, n, diversity), names)


def _ranked(rows: DataFrame, key: str, phrase: str, found: DataFrame, least: float, n: int, same: Callable[[Column], Column] = lambda s: s) -> DataFrame:
    """(key, skill, near, rank): the n nearest of the skills found for a key's phrases, each once by its best
    similarity; of skills that are the ``same`` the nearest, then the last by name.  A phrase's skills meet
    its rows as one list, so no row is made for a skill of a row before the n best are known."""
    each = F.struct(same(F.col("skill")).alias("s"), "near", "skill")
    lists = found.where(F.col("near") >= least).groupBy(phrase).agg(F.collect_list(each).alias("_l"))
    met = rows.join(lists, phrase).groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("_l"))).alias("_l"))
    last = once(F.col("_l"), lambda x: F.filter(x, lambda v, i: F.coalesce(F.get(x, i + 1)["s"] != v["s"], F.lit(True))))
    best = F.slice(F.array_sort(F.transform(last, lambda v: F.struct((-v["near"]).alias("far"), v["skill"].alias("skill")))), 1, n)
    return met.select(key, F.posexplode(best).alias("_i", "_b")).select(key, F.col("_b.skill").alias("skill"), (-F.col("_b.far")).alias("near"), (F.col("_i") + 1).alias("rank"))


def chunk_similarity(rows: DataFrame, key: str, body: str, vocabulary: DataFrame, embedder: Embedder, least: float = 0.30, n: int = 5) -> DataFrame:
    """(key, skill, near, rank): skills by the highest similarity of any chunk.  Distinct chunks are
    embedded once."""
    parts = rows.select(key, F.explode(F.array_distinct(text.chunks(body))).alias("chunk"))
    found = nearest(parts.select("chunk").distinct(), vocabulary.select(F.col("skill").alias("v"), "skill"), embedder, "chunk", "v", "skill", k=2 * n)
    return _ranked(parts, key, "chunk", found, least, n)


def near_skills(phrases: DataFrame, key: str, phrase: str, vocabulary: DataFrame, embedder: Embedder, least: float = 0.62, n: int = 3) -> DataFrame:
    """(key, skill, near, rank): skills near any of a row's phrases."""
    found = nearest(phrases.select(phrase).distinct(), vocabulary.select(F.col("skill").alias("v"), "skill"), embedder, phrase, "v", "skill")
    best = phrases.join(found.where(F.col("near") >= least), phrase).groupBy(key, "skill").agg(F.max("near").alias("near"))
    order = Window.partitionBy(key).orderBy(F.desc("near"), "skill")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def normalised_skills(rows: DataFrame, key: str, body: str, phrases: str, vocabulary: DataFrame, embedder: Embedder, least: float = 0.62, n: int = 3, evidence: Mapping[str, Sequence[str]] = values.STRICT_EVIDENCE, blocked: Sequence[str] = values.BLOCKED_PHRASES) -> DataFrame:
    """(key, skill, near, rank): the skill nearest to each usable phrase of a row, the n best.

    A skill of ``evidence`` counts only where one of its terms stands in the row's text or in a usable
    phrase.  Distinct phrases are embedded once.
    """
    usable = F.filter(text.col(phrases), lambda p: skill_like(p) & ~F.lower(p).isin("", *blocked))
    told = rows.select(key, usable.alias("_p"), F.lower(F.concat_ws(" ", F.coalesce(text.col(body), F.lit("")), F.array_join(usable, " "))).alias("_t"))
    shown = F.create_map(*[x for s, terms in evidence.items() for x in (F.lit(s), text.any_phrase("_t", terms))]) if evidence else None
    told = told.select(key, F.explode("_p").alias("_phrase"), *([shown.alias("_e")] if evidence else []))
    found = nearest(told.select("_phrase").distinct(), vocabulary.select(F.col("skill").alias("v"), "skill"), embedder, "_phrase", "v", "skill")
    best = told.join(found.where(F.col("near") >= least), "_phrase")
    if evidence:
        best = best.where(F.coalesce(F.try_element_at("_e", F.col("skill")), F.lit(True)))
    best = best.groupBy(key, "skill").agg(F.max("near").alias("near"))
    order = Window.partitionBy(key).orderBy(F.desc("near"), "skill")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def direct_skills(rows: DataFrame, key: str, body: str, vocabulary: DataFrame, embedder: Embedder, least: float = 0.33, n: int = 10, over: int = 4) -> DataFrame:
    """(key, skill, near, rank): the vocabulary's skills nearest to the whole text.  ``over`` times n are
    fetched, as spellings that differ by case alone count once."""
    texts = rows.select(key, F.trim(F.coalesce(text.col(body), F.lit(""))).alias("_t")).where("_t <> ''")
    found = nearest(texts.select("_t").distinct(), vocabulary.select(F.col("skill").alias("v"), "skill"), embedder, "_t", "v", "skill", k=over * n)
    return _ranked(texts, key, "_t", found, least, n, F.lower)


def gated_skills(rows: DataFrame, key: str, body: str, phrases: str, vocabulary: DataFrame, embedder: Embedder, least_map: float = 0.46, least_text: float = 0.36, top: int = 300, n: int = 10) -> DataFrame:
    """(key, skill, near, rank): the skill nearest to each of a row's phrases, if it is near enough to the
    phrase and among the ``top`` skills nearest to the whole text, and near enough to that."""
    named = vocabulary.select(F.col("skill").alias("v"), "skill")
    each = rows.select(key, F.trim(F.coalesce(text.col(body), F.lit(""))).alias("_t"), F.explode(phrases).alias("_phrase"))
    mapped = nearest(each.select("_phrase").distinct(), named, embedder, "_phrase", "v", "skill").where(F.col("near") >= least_map)
    direct = nearest(each.select("_t").distinct(), named, embedder, "_t", "v", "skill", k=top).where(F.col("near") >= least_text)
    both = each.join(mapped, "_phrase").join(direct.select("_t", "skill"), ["_t", "skill"], "left_semi")
    best = both.groupBy(key, "skill").agg(F.max("near").alias("near"))
    order = Window.partitionBy(key).orderBy(F.desc("near"), "skill")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def first_source(*lists: Column | str) -> Column:
    """The first list that has a value."""
    none = F.array().cast("array<string>")
    return F.coalesce(*[F.when(F.size(text.col(x)) > 0, text.col(x)) for x in lists], none)


def consensus(votes: DataFrame, key: str, least: int = 2, n: int = 10) -> DataFrame:
    """(key, skill, support, rank) from (key, skill, extractor, pos): skills that ``least`` extractors
    name, by support, best place and name.  Votes are shuffled once, by their key."""
    each = votes.repartition(key).groupBy(key, "skill", "extractor").agg(F.min("pos").alias("pos"))
    counts = each.groupBy(key, "skill").agg(F.count("extractor").alias("support"), F.min("pos").alias("place")).where(F.col("support") >= least)
    order = Window.partitionBy(key).orderBy(F.desc("support"), "place", "skill")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("place")
