"""Findings of round 3: patterns searched once and only where they can match, work dealt over tasks, lists instead of rows."""

import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import catalog, catalog_rows, registry, values  # noqa: F401  (the catalogues fill the register)
from tessera.functions import runs, text
from tessera.operators import align, embed, extract, ranking
from tessera.sources import readers


def test_needed_strings(spark):
    """A text without them never matches, and answers are those of the patterns alone."""
    known = {r"\bdata structures?\b": ["data structure"], r"(^|[^a-z])und([^a-z]|$)": ["und"], r"\bab|cd\b": ["ab", "cd"], r"x(?:a|)y": ["x"], "a?b*": [], "(?i)ab": [], r"\Qa\E": [], "^$": []}
    assert {p: text.needed(p) for p in known} == known
    rng = random.Random(4)
    patterns = [*values.STEM_STRONG, *values.STEM_AGAINST, *values.EARLIER_STRONG, *(p for p in known if p != r"\Qa\E")]
    pieces = [s for p in patterns for s in text.needed(p)] + ["s", "al", " ", ".", "é", "x", "ya", "ABUND"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(12)) for _ in range(60)] + ["", None]
    assert all(any(s in t for s in text.needed(p)) for t in texts if t for p in patterns if text.needed(p) and re.search(p, t, re.ASCII))
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(*[text.finds("t", p).alias(f"a{i}") for i, p in enumerate(patterns)], *[F.col("t").rlike(p).alias(f"b{i}") for i, p in enumerate(patterns)], text.finds("t", *patterns[:40]).alias("all"), F.col("t").rlike("|".join(patterns[:40])).alias("any"))
    for r in got.collect():
        assert all(r[f"a{i}"] == r[f"b{i}"] for i in range(len(patterns))) and r["all"] == r["any"]


@pytest.mark.parametrize("name, most", [("merge_topk", 10), ("keyword_signal", 20), ("stem_signal", 240)])
def test_patterns_are_searched_once(spark, sf, name, most):
    """Lists of found skills are not computed anew wherever they are named."""
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("RLIKE") <= most and plan.count("Contains(") >= plan.count("RLIKE")


def test_listings_of_equal_skills_and_many_blocks(spark, monkeypatch):
    """Listings ranked in blocks, folded where their skills are equal, as pairs give them; pairs are no rows."""
    monkeypatch.setattr(ranking, "LISTINGS", 7)
    monkeypatch.setattr(ranking, "MODULES", 5)
    rng = random.Random(8)
    some = lambda most: rng.sample([f"s{i}" for i in range(9)], rng.randint(0, most))
    jobs = [(i, f"f{rng.randint(0, 2)}", some(3)) for i in range(90)]
    mods = [(i, some(4)) for i in range(25)]
    listings = spark.createDataFrame(jobs, "job_id long, code string, skills array<string>")
    mine = align.module_skills(spark.createDataFrame(mods, "module_id long, skills array<string>"))
    matches = spark.createDataFrame([(m, f"f{f}", f + 1) for m, _ in mods for f in range(3) if (m + f) % 4], "module_id long, code string, rank int")
    out = align.rerank_listings(matches, mine, listings, families=2, n=5)
    assert not re.search(r"Join \[skill", out._jdf.queryExecution().executedPlan().toString())
    inside = matches.where("rank <= 2").select("module_id", F.col("code").alias("family"))
    each = listings.where("size(skills) > 0").select(F.col("job_id").alias("code"), F.col("code").alias("family"), F.explode("skills").alias("skill"), F.lit(1).cast("long").alias("cnt"))
    scored = align.pair_scores(mine, align.weighted(each, "code"), k=20, weights=align.LEGACY, inside=inside, within="family")
    want = {}
    for r in scored.select("module_id", "family", "code", "overlap_count", align.rounded("score").alias("score")).collect():
        want.setdefault(r.module_id, []).append((-r.score, -r.overlap_count, r.code, r.family))
    want = {(m, i + 1, f, j, -o, -s) for m, x in want.items() for i, (s, o, j, f) in enumerate(sorted(x)[:5])}
    assert {(r.module_id, r["rank"], r.family, r.job_id, r.overlap_count, r.score) for r in out.collect()} == want and len(want) > 80


def test_costly_rows_are_dealt(spark):
    """One file of few bytes is not one task."""
    pages = spark.range(200).coalesce(1).select(F.col("id").alias("page_id"), F.lit("<title>a</title>").alias("html"))
    assert readers.page_records(pages).rdd.getNumPartitions() > 4


def test_skills_meet_rows_as_lists(spark):
    """The best similarity of any chunk, without a row for each skill of a chunk; repeated keys are one."""
    rows = spark.createDataFrame([(1, "red tea. green tea"), (1, "black tea"), (2, "green tea; red tea"), (3, "")], "k long, body string")
    names = ["red tea", "Green Tea", "green tea", "black tea", "coffee"]
    vocabulary = spark.createDataFrame([(x,) for x in names], "skill string")
    e = embed.HashingEmbedder()
    out = extract.chunk_similarity(rows, "k", "body", vocabulary, e, least=0.0, n=3)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    chunks = {1: ["red tea", "green tea", "black tea"], 2: ["green tea", "red tea"]}
    got = {(r.k, r["rank"]): (r.skill, round(r.near, 5)) for r in out.collect()}
    for k, parts in chunks.items():
        near = (e(parts) @ e(names).T).max(axis=0)
        want = sorted(zip(names, near.tolist()), key=lambda x: (-round(x[1], 5), x[0]))[:3]
        assert [got[k, i + 1] for i in range(3)] == [(s, round(x, 5)) for s, x in want]
    assert len(got) == 6


def test_ngrams_leave_in_blocks(spark, monkeypatch):
    """Many texts in one batch come out as several."""
    from tessera.functions import grams

    made = extract.candidates(spark.createDataFrame([(i, f"alpha beta{i} gamma") for i in range(40)], "k long, t string"), "k", "t", most_chars=None)
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r.candidates for r in made.collect()}[7] == sorted(["alpha", "beta7", "gamma", "alpha beta7", "beta7 gamma", "alpha beta7 gamma"])
    assert grams.BLOCK_WORDS <= 1 << 18


def test_votes_are_shuffled_once(spark):
    votes = spark.createDataFrame([(1, "a", "x", 3), (1, "a", "y", 1), (1, "a", "y", 0), (1, "b", "x", 0), (1, "b", None, 0), (2, "a", "x", 0), (2, "a", "z", 5)], "k long, skill string, extractor string, pos int")
    out = extract.consensus(votes, "k")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, out.select("k", "skill", "support", "rank").collect())) == [(1, "a", 2, 1), (2, "a", 2, 1)]


def _plain_vector(x, width=32):
    from zlib import crc32

    out = [0] * width
    for n in (2, 3, 4):
        for i in range(len(x) + 3 - n):
            h = crc32(f" {x} "[i : i + n].encode())
            out[h % width] += 1 if h >> 16 & 1 else -1
    return out


def _cosine(a, b):
    dot = lambda x, y: sum(i * j for i, j in zip(x, y))
    return round(dot(a, b) / (math.sqrt(dot(a, a)) or 1) / (math.sqrt(dot(b, b)) or 1), 10)


def _texts():
    rng = random.Random(3)
    pool = ["to", "ab", "abab", "ba", "tea", "a", "the", "2b", "copper", "kettles", "é", "Über", "漢字", "x-y", "\n"]
    return [None, "", "a the é", "tea", "tea tea tea", "ab " * 9, *(" ".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(40))]


def _plain_phrases(body, n, diversity=None):
    """By sums of vectors of every n-gram; of equals the first by name."""
    words = [w for w in re.sub("[^a-z0-9]+", " ", (body or "").lower()).split() if len(w) > 1 and w not in values.STOP_WORDS]
    names = sorted({" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)})
    vectors = {p: _plain_vector(p) for p in names}
    like = {p: _cosine(vectors[p], _plain_vector(body or "")) for p in names}
    if diversity is None:
        return sorted(names, key=lambda p: (-like[p], p))[:n]
    out = []
    while len(out) < min(n, len(names)):
        near = {p: max((_cosine(vectors[p], vectors[q]) for q in out), default=None) for p in names if p not in out}
        score = {p: like[p] if v is None else round((1 - diversity) * like[p] - diversity * v, 10) for p, v in near.items()}
        out.append(min(score, key=lambda p: (-score[p], p)))
    return out


@pytest.mark.parametrize("n, diversity", [(30, None), (4, None), (5, 0.8)])
def test_ngrams_are_ranked_without_being_embedded(spark, monkeypatch, n, diversity):
    """The phrases of every text, by vectors of its words alone and whatever the sizes of blocks."""
    given, sums = [], embed.HashingEmbedder.sums
    monkeypatch.setattr(embed.HashingEmbedder, "sums", lambda self, texts: (given.extend(texts), sums(self, texts))[1])
    model, texts = embed.HashingEmbedder(32), _texts()
    lists = pa.array([re.sub("[^a-z0-9]+", " ", (x or "").lower()).strip().split(" ") for x in texts])
    want = [_plain_phrases(x, n, diversity) for x in texts]
    for rows, chars in ((1024, 1 << 16), (3, 20)):
        monkeypatch.setattr(runs, "RUN_ROWS", rows)
        monkeypatch.setattr(embed, "SUM_CHARS", chars)
        assert list(extract._best_ngrams(texts, lists, pa.array(values.STOP_WORDS), model, n, diversity)) == want
    assert "copper kettles" not in given and "copper" in given
    table = spark.createDataFrame(list(enumerate(texts)), "k long, body string").coalesce(1)
    out = extract.ranked_ngrams(table, "k", "body", model, n, diversity, most_chars=None)
    assert out.rdd.getNumPartitions() > 4 and {r.k: r.phrases for r in out.collect()} == dict(enumerate(want))


def test_ngrams_of_other_embedders(spark):
    """An embedder whose vectors need not add up is given every n-gram; only the first characters count."""

    class Other(embed.HashingEmbedder):
        pass

    texts = _texts()
    table = spark.createDataFrame(list(enumerate(texts)), "k long, body string")
    for model in (Other(32), embed.HashingEmbedder(32)):
        got = extract.ranked_ngrams(table, "k", "body", model, 6, most_chars=50)
        assert {r.k: r.phrases for r in got.collect()} == {i: _plain_phrases(x and x[:50], 6) for i, x in enumerate(texts)}


def test_long_words_are_summed_exactly():
    """Words whose squares 32-bit floats do not hold."""
    texts = ["ab" * 3000 + " " + "cd" * 2500 + " tea"]
    got = list(extract._best_ngrams(texts, pa.array([texts[0].split(" ")]), pa.array([""]), embed.HashingEmbedder(32), 6, None))
    assert got == [_plain_phrases(texts[0], 6)]


@pytest.mark.parametrize("name", ["ranked_phrases", "mmr_phrases"])
def test_phrase_queries_take_words(spark, sf, name):
    """No n-gram leaves a task but the best."""
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "candidates" not in plan and "MapInPandas" not in plan
