"""Extractors by similarity, and string similarity, against plain Python over the same vectors."""

from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog_rows
from tessera.functions import fuzzy
from tessera.operators import embed, extract, rules

SKILLS = ["data mining", "Data Mining", "sql", "urban planning", "linear algebra", "machine learning", "poetry"]
ROWS = [
    (1, "We do data mining with sql. Machine learnings too", ["data mining tasks", "course notes", "sql"]),
    (2, "linear algebraic methods", ["linear algebras", "urban plannings", "analysis"]),
    (3, "the urban design of cities; poetics", ["urban plannings", "poetry"]),
    (4, None, []),
    (5, "", ["x"]),
]
MODEL = embed.HashingEmbedder()


@pytest.fixture(scope="module")
def tables(spark):
    rows = spark.createDataFrame(ROWS, "id int, body string, phrases array<string>")
    return rows, spark.createDataFrame([(s,) for s in SKILLS], "skill string")


def near(a, b):
    return MODEL([a]).astype(np.float32) @ MODEL(b).astype(np.float32).T


def best(phrase):
    """The nearest skill, of equals the first by name."""
    names = sorted(SKILLS)
    scores = near(phrase, names)[0]
    k = int(np.argmax(scores))
    return names[k], float(scores[k])


def ranked(found, n):
    order = sorted(found.items(), key=lambda x: (-round(x[1], 5), x[0]))[:n]
    return [(s, pytest.approx(v, abs=1e-5), i) for i, (s, v) in enumerate(order, 1)]


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.id, []).append((r.skill, r.near, r["rank"]))
    return out


def fits(phrase):
    low = phrase.lower()
    return 2 <= len(low) <= 80 and "course" not in low and low not in ("analysis", "poetry analysis")


def test_normalised_skills(tables):
    rows, vocabulary = tables
    evidence = {"urban planning": ["urban design", "city planning"], "poetry": ["verse"]}
    want = {}
    for i, body, phrases in ROWS:
        usable = [p for p in phrases if fits(p)]
        said = " ".join([(body or "").lower(), *usable])
        found = {}
        for p in usable:
            skill, score = best(p)
            if score >= 0.62 and (skill not in evidence or any(e in said for e in evidence[skill])):
                found[skill] = max(found.get(skill, 0), score)
        if found:
            want[i] = ranked(found, 2)
    assert {s for v in want.values() for s, *_ in v} >= {"urban planning", "linear algebra"} and len(want) >= 3
    assert got(extract.normalised_skills(rows, "id", "body", "phrases", vocabulary, MODEL, n=2, evidence=evidence)) == want


def test_direct_skills(tables):
    rows, vocabulary = tables
    want = {}
    for i, body, _ in ROWS:
        if not (body or "").strip():
            continue
        found = {}
        for s, v in sorted(zip(sorted(SKILLS), near(body.strip(), sorted(SKILLS))[0].tolist()), key=lambda x: (-x[1], x[0]))[:12]:
            if v >= 0.1 and v > found.get(s.lower(), (0, ""))[0]:
                found[s.lower()] = (v, s)
        want[i] = ranked({s: v for v, s in found.values()}, 3)
    mine = got(extract.direct_skills(rows, "id", "body", vocabulary, MODEL, least=0.1, n=3, over=4))
    fold = lambda x: {i: [(s.lower(), v, k) for s, v, k in rows] for i, rows in x.items()}
    assert fold(mine) == fold(want) and set(mine) == {1, 2, 3}


def test_gated_skills(tables):
    rows, vocabulary = tables
    want = {}
    for i, body, phrases in ROWS:
        text = (body or "").strip()
        scores = dict(zip(sorted(SKILLS), near(text, sorted(SKILLS))[0].tolist()))
        top = sorted(scores, key=lambda s: (-scores[s], s))[:4]
        found = {}
        for p in phrases:
            skill, score = best(p)
            if score >= 0.4 and skill in top and scores[skill] >= 0.15:
                found[skill] = max(found.get(skill, 0), score)
        if found:
            want[i] = ranked(found, 10)
    assert want and got(extract.gated_skills(rows, "id", "body", "phrases", vocabulary, MODEL, least_map=0.4, least_text=0.15, top=4)) == want


def test_chunk_similarity(tables):
    rows, vocabulary = tables
    want = {}
    for i, body, _ in ROWS:
        found = {}
        for chunk in [c.strip() for c in (body or "").replace("; ", "\n").replace(". ", "\n").split("\n") if c.strip()]:
            scores = sorted(zip(near(chunk, sorted(SKILLS))[0].tolist(), sorted(SKILLS)), key=lambda x: (-x[0], x[1]))[:10]
            for v, s in scores:
                found[s] = max(found.get(s, 0), v)
        found = {s: v for s, v in found.items() if v >= 0.3}
        if found:
            want[i] = ranked(found, 5)
    assert len(want) == 3 and got(extract.chunk_similarity(rows, "id", "body", vocabulary, MODEL)) == want


def test_grouped_by_skill(spark, tables):
    phrases = [("data mining tools", 4), ("urban planners", 2), ("zzz", 9)]
    mine = {(r.skill, r.phrase, r.freq) for r in rules.grouped_by_skill(spark.createDataFrame(phrases, "phrase string, freq bigint"), tables[1], MODEL).collect()}
    assert mine == {(best(p)[0], p, f) for p, f in phrases if best(p)[1] >= 0.44} and len(mine) == 2


def test_ranked_candidates_embed_once(spark):
    calls = []

    class Counting(embed.HashingEmbedder):
        def __call__(self, texts):
            calls.append(len(texts))
            return super().__call__(texts)

    rows = spark.createDataFrame([(1, "red fox", ["red", "fox", "red fox"]), (2, "red", ["red"]), (3, None, None)], "id int, body string, listed array<string>")
    found = {r.id: r.phrases for r in extract.ranked_candidates(rows, "id", "body", "listed", MODEL, n=2).collect()}
    want = {}
    for i, body, phrases in [(1, "red fox", ["red", "fox", "red fox"]), (2, "red", ["red"])]:
        score = near(body, phrases)[0]
        want[i] = [phrases[k] for k in np.argsort(-score, kind="stable")[:2]]
    assert found == want | {3: []}


def test_string_similarity(spark):
    rows = [("java", "javascript"), ("", ""), ("abc", "xyz"), (None, "a")]
    mine = [r.x for r in spark.createDataFrame(rows, "a string, b string").select(fuzzy.similarity("a", "b").alias("x")).collect()]
    assert mine[:3] == [SequenceMatcher(None, a, b).ratio() for a, b in rows[:3]] and mine[3] is None


def test_queries_give_rows(spark, sf):
    tables = catalog_rows.Tables(spark, sf)
    for f in (catalog_rows.chunk_skills, catalog_rows.normalised_skills, catalog_rows.direct_skills, catalog_rows.gated_skills, catalog_rows.grouped_phrases):
        rows = f(tables)
        assert rows.count() > 0 and rows.where(F.col("near") > 1.001).count() == 0
