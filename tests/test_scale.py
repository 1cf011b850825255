"""Operators that hold at any size: merged frameworks and their memo, bounded alignment, phrase tables, block-wise
nearest neighbours and clusters, refined quantiles, paged sources, streams of corrections."""

import collections
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import values
from tessera.functions import fuzzy, grams
from tessera.operators import align, clean_jobs, clusters, embed, enrich, framework, mapping, memo, patterns, quantiles, rules, scope
from tessera.sources import paged, shared, writers
from tessera.streaming import profiles

# ---------------------------------------------------------------- the framework


def key(x):
    return re.sub(r"^[^a-z0-9+#/]+|[^a-z0-9+#/]+$", "", re.sub(r"\s+", " ", x.strip().lower()))


def test_curated_framework(spark):
    """The merge in plain Python: five sources, kinds by precedence."""
    f = framework.build(framework.curated(spark))
    aliases, kinds = collections.defaultdict(lambda: collections.defaultdict(set)), {}
    for skill, kind, names in values.BASE_SKILLS:
        kinds[skill] = kind
        for n in (skill, *names):
            aliases[skill][key(n)].add("base")
    for patterns_, skills in values.MODULE_RULES:
        for s in skills:
            for n in (s, *patterns_):
                aliases[s][key(n)].add("rules")
    for s, names in values.STRICT_EVIDENCE.items():
        for n in (s, *names):
            aliases[s][key(n)].add("evidence")
    for s in values.MODULE_SKILLS:
        aliases[s][key(s)].add("labels")
    for s in aliases:
        kinds.setdefault(s, next((k for k, names in values.SKILL_TYPES if s in names), "hard"))
    got = {r.canonical_skill: r for r in f.skills.collect()}
    assert len(got) == 89 and {s: r.skill_type for s, r in got.items()} == kinds
    assert {s: r.n_aliases for s, r in got.items()} == {s: len(a) for s, a in aliases.items()}
    assert {(r.alias, r.canonical_skill): set(r.sources) for r in f.aliases.collect()} == {(a, s): k for s, found in aliases.items() for a, k in found.items()}
    assert f.excluded.count() == 24
    owners = collections.defaultdict(set)
    for s, found in aliases.items():
        for a in found:
            owners[a].add(s)
    several = {r.alias: (r.skills, r.exact, r.nearest) for r in f.collisions().collect()}
    assert several == {a: (sorted(s), max(s), min(s)) for a, s in owners.items() if len(s) > 1} and len(several) > 3
    blocked = {key(x) for x in (*values.BLOCKED_PHRASES, *values.EXCLUDED_PHRASES)}
    assert {(r.alias, r.canonical_skill) for r in f.shadowed().collect()} == {(a, s) for a in blocked for s in owners[a]}


def test_merged_sources(spark, tmp_path):
    make = spark.createDataFrame
    more = framework.Sources(
        make([("Java", "domain", ["  JAVA!! "], 500), ("!!", "soft", None, 501), (" ", "soft", ["x"], 502), ("New", None, [None, "n"], 503)], "canonical_skill string, skill_type string, aliases array<string>, place long"),
        make([([], ["Lonely"]), (None, ["Null"]), (["p"], [])], "patterns array<string>, skills array<string>"),
        framework.no_sources(spark).evidence, framework.no_sources(spark).labels, make([(None,), ("Java",), ("...",)], "phrase string"),
    )
    f = framework.build(framework.curated(spark).and_(more))
    got = {r.canonical_skill: r for r in f.skills.collect()}
    assert got["Java"].skill_type == "domain" and got["!!"].n_aliases == 0 and " " not in got and got["New"].skill_type == "hard"
    assert got["Lonely"].n_aliases == got["Null"].n_aliases == 1 and len(got) == 93
    assert {r.phrase for r in f.excluded.collect()} >= {"java"} and f.excluded.count() == 25
    back = f.kept(str(tmp_path / "f"))
    assert back.version == f.version != framework.build(framework.curated(spark)).version
    mapped = {r.key: r.match_type for r in mapping.map_phrases(make([("java",), ("lonely",)], "phrase string"), *back.tables()).collect()}
    assert mapped == {"java": "excluded", "lonely": "exact"}
    assert framework.build(framework.no_sources(spark)).skills.count() == 0


def counted(path, width=64):
    """An embedder that writes down what it embeds."""

    class Counted:
        def __init__(self):
            self.path, self.width, self.inner = path, width, embed.HashingEmbedder(width)

        def __call__(self, texts):
            with open(self.path, "a") as f:
                f.writelines(x + "\n" for x in texts)
            return self.inner(texts)

    return Counted()


def test_memo(spark, tmp_path):
    f = framework.build(framework.curated(spark)).kept(str(tmp_path / "f"))
    log = tmp_path / "log"
    log.write_text("")
    model = counted(str(log))
    m = memo.Memo(spark, str(tmp_path / "memo"))
    phrases = lambda *xs: spark.createDataFrame([(x,) for x in xs], "phrase string")
    first = memo.map_phrases(m, phrases("Pythons", "java", "java ", "zzqqy", "", None), f, embedder=model, threshold=0.4)
    want = {r.key: tuple(r) for r in mapping.map_phrases(phrases("Pythons", "java", "zzqqy", ""), *f.tables(), embedder=embed.HashingEmbedder(64), threshold=0.4).collect()}
    assert {r.key: tuple(r) for r in first.mapped.collect()} == want and first.added.count() == 4
    assert want["pythons"][3] == "semantic" and want["pythons"][1] == "Python" and want["zzqqy"][3] == "unmapped"
    log.write_text("")
    again = memo.map_phrases(m, phrases("zzqqy", "pythons", "JAVA"), f, embedder=model, threshold=0.4)
    assert again.added.count() == 0 and again.mapped.count() == 3 and log.read_text() == ""  # nothing is embedded
    more = memo.map_phrases(m, phrases("zzqqy", "sequels"), f, embedder=model, threshold=0.4)
    assert [r.key for r in more.added.collect()] == ["sequels"] and more.mapped.count() == 2 and "zzqqy" not in log.read_text()
    assert len(m.batches(first.version)) == 2
    m.compact(first.version)
    assert len(m.batches(first.version)) == 1 and m.known(first.version).count() == 5
    # another framework, threshold, exclusion or embedder: mapped anew
    make = lambda **how: memo.map_phrases(m, phrases("java"), **({"framework": f, "embedder": model, "threshold": 0.4} | how))
    other = framework.build(framework.curated(spark).and_(framework.Sources(*(getattr(framework.no_sources(spark), n) for n in ("base", "rules", "evidence", "labels")), phrases("java"))))
    runs = [make(framework=other), make(threshold=0.5), make(exclusion="batch_compat"), make(embedder=counted(str(log), 32)), make(embedder=None)]
    assert all(r.added.count() == 1 for r in runs) and len({r.version for r in runs} | {first.version}) == 6
    assert runs[0].mapped.first().match_type == "excluded"
    m.forget(keep=first.version)
    assert m.versions() == [first.version]
    assert not [n for n in m._listed(m.path) if n.startswith("waiting")]


# ---------------------------------------------------------------- bounded alignment


def aligned(modules, families, theirs, k, n, w):
    """All pairs in plain Python: the n best families of every module."""
    by = collections.defaultdict(dict)
    for r in theirs:
        by[r.code][r.skill] = (r.w, r.cnt, r.rk)
    out = {}
    for m, skills in modules:
        rows = []
        own = collections.Counter(skills)
        for f in families:
            rest = by[f.code]
            if not own:
                continue
            mw = {s: c / sum(own.values()) for s, c in own.items()}
            common = [s for s in mw if s in rest]
            if not common:
                continue
            top = [s for s, x in rest.items() if x[2] <= k]
            cover = sum(s in mw for s in top) / len(top)
            fills = sum(rest[s][1] for s in top if s in mw) / sum(rest[s][1] for s in top)
            low = sum(min(mw[s], rest[s][0]) for s in common)
            cosine = sum(mw[s] * rest[s][0] for s in common) / (sum(x * x for x in mw.values()) * sum(x[0] ** 2 for x in rest.values())) ** 0.5
            score = cover * w.coverage + low / (2 - low) * w.jaccard + cosine * w.cosine + fills * w.gain - (1 - fills) * w.loss
            rows.append((-round(round(score, 10), 4), -len(common), -f.job_count, f.code))
        out[m] = [r[3] for r in sorted(rows)[:n]]
    return out


@pytest.mark.parametrize(("weights", "head", "seed"), [(align.Weights(), 2, 1), (align.Weights(), 16, 2), (align.LEGACY, 3, 3), (align.LEGACY, 1, 4)])
def test_bounds_lose_no_match(spark, monkeypatch, weights, head, seed):
    rng = random.Random(seed)
    skills = [f"s{i}" for i in range(30)]
    jobs = [(f"c{rng.randint(0, 24)}", "t", 1, rng.choices(skills, [1 / (i + 1) for i in range(30)], k=rng.randint(1, 6))) for _ in range(300)]
    modules = [(i, rng.choices([*skills, "none"], k=rng.randint(0, 5))) for i in range(120)]
    families, theirs = align.family_profiles(spark.createDataFrame(jobs, "code string, title string, is_good_job int, skills array<string>"), distinct=True)
    m = spark.createDataFrame(modules, "module_id int, skills array<string>")
    mine = align.module_skills(m)
    found = align.candidate_pairs(mine, theirs, k=10, n=4, weights=weights, head=head, salts=3).collect()
    exact = align.candidate_pairs
    monkeypatch.setattr(align, "candidate_pairs", lambda *a: exact(*a[:6], head=head, salts=3))
    got = collections.defaultdict(list)
    for r in align.top_matches(m, mine, families, theirs, k=10, n=4, weights=weights).where("overlap_count > 0").orderBy("module_id", "rank").collect():
        got[r.module_id].append(r.code)
    want = aligned(modules, families.collect(), theirs.collect(), 10, 4, weights)
    assert {i: got[i] for i in want} == want
    if head == 16:
        assert all(r.codes is None or len(r.codes) < 25 for r in found)


def test_bounds_leave_fewer_pairs(spark):
    """A hundred families that share all skills but rank them differently: most pairs are never scored."""
    rng = random.Random(7)
    skills = [f"s{i}" for i in range(80)]
    jobs = []
    for c in range(100):
        liked = rng.sample(skills, 10)
        jobs += [(f"c{c}", "t", 1, [s]) for s in skills] + [(f"c{c}", "t", 1, [s]) for s in liked for _ in range(5)]
    families, theirs = align.family_profiles(spark.createDataFrame(jobs, "code string, title string, is_good_job int, skills array<string>"))
    m = spark.createDataFrame([(i, rng.sample(skills, 4)) for i in range(60)], "module_id int, skills array<string>")
    found = align.candidate_pairs(align.module_skills(m), theirs).collect()
    scored = sum(100 if r.codes is None else len(r.codes) for r in found)
    assert scored < 0.15 * 60 * 100


@pytest.mark.parametrize(("weights", "cells", "shared", "seed"), [(align.Weights(), 1, 1, 1), (align.Weights(), 60, 7, 2), (align.LEGACY, 1 << 20, 1 << 21, 3)])
def test_best_families_in_blocks(spark, monkeypatch, weights, cells, shared, seed):
    """Every module meets all families in blocks of any size; pairs are never rows, and modules without a
    shared skill get the largest families."""
    from tessera.operators import ranking

    for name, value in (("CELLS", cells), ("SHARED", shared), ("CHUNKS", 3)):
        monkeypatch.setattr(ranking, name, value)
    rng = random.Random(seed)
    skills = [f"s{i}" for i in range(12)]
    jobs = [(f"c{rng.randint(0, 19)}", "t", 1, rng.choices(skills, k=rng.randint(1, 4))) for _ in range(60)]
    modules = [(i, rng.choices([*skills, "none"], k=rng.randint(0, 4))) for i in range(40)] + [(40, [None, "s1"]), (41, None)]
    families, theirs = align.family_profiles(spark.createDataFrame(jobs, "code string, title string, is_good_job int, skills array<string>"))
    m = spark.createDataFrame(modules, "module_id int, skills array<string>")
    top = align.top_matches(m, align.module_skills(m), families, theirs, k=3, n=4, weights=weights)
    got = collections.defaultdict(list)
    for r in top.orderBy("module_id", "rank").collect():
        got[r.module_id].append(r.code)
        assert len(r.overlap) == r.overlap_count and r.overlap == sorted(set(r.overlap) & set(dict(modules)[r.module_id])) if r.overlap else r.score <= 0
    largest = [f.code for f in sorted(families.collect(), key=lambda f: (-f.job_count, f.code))]
    best = aligned([(i, s) for i, s in modules if s], families.collect(), theirs.collect(), 3, 4, weights)
    assert dict(got) == {i: (b := best.get(i, [])) + [c for c in largest if c not in b][: 4 - len(b)] for i, _ in modules}
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(module_id#\d+L?, code#", plan)
    lack = {(r.module_id, r.code): r.missing for r in align.missing_skills(top, theirs, n=2).collect()}
    by = collections.defaultdict(list)
    for r in theirs.orderBy("code", "rk").collect():
        by[r.code].append(r.skill)
    want = {(i, c): [s for s in by[c] if s not in (dict(modules)[i] or [])][:2] for i in got for c in got[i]}
    assert lack == {p: x for p, x in want.items() if x}


def test_alignment_is_lazy(spark):
    """Building a plan of matches starts no job and writes no table."""
    m = spark.createDataFrame([(1, ["a"])], "module_id int, skills array<string>")
    jobs = spark.createDataFrame([("c", "t", 1, ["a"])], "code string, title string, is_good_job int, skills array<string>")
    families, theirs = align.family_profiles(jobs)
    before = len(shared._made)
    spark.sparkContext.setJobGroup("lazy", "lazy")
    out = align.summary(align.module_metrics(m, align.top_matches(m, align.module_skills(m), families, theirs)), families)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy") and len(shared._made) == before
    assert out.first().top1_overlap_modules == 1


def test_occupations_are_counted_before_titles(spark):
    jobs = spark.createDataFrame([("25121", 1), ("25122", 0), ("25199", 1), ("99999", 1), (None, 1)], "ssoc_code string, is_good_job int")
    titles = spark.createDataFrame([("251", "Developers"), ("2512", "Software"), ("25121", "Engineer")], "code string, title string")
    got = sorted(tuple(r) for r in enrich.with_occupation(jobs, titles).select("ssoc_5d_title", "ssoc_4d_title", "ssoc_3d_title", "ssoc_3d_total_jobs", "ssoc_3d_good_jobs", "ssoc_3d_good_job_pct").collect())
    assert [r[2:] for r in got] == [("Developers", 3, 2, 0.6667)] * 3 and sorted(r[0] for r in got) == ["", "", "Engineer"]


# ---------------------------------------------------------------- phrases


def test_hundred_thousand_phrases(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    texts = [(i, " ".join(rng.choices(words, k=200))) for i in range(150)] + [(900, None), (901, "")]
    phrases = {" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(100_000)}
    df = spark.createDataFrame(texts, "id int, body string").repartition(3)
    want = collections.Counter()
    for i, t in texts:
        w = (t or "").split()
        want.update((i, p) for n in (1, 2, 3) for p in (" ".join(w[k : k + n]) for k in range(len(w) - n + 1)) if p in phrases)
    table = spark.createDataFrame([(p,) for p in phrases] + [(None,), ("",)], "phrase string")
    assert {(r.id, r.phrase): r.hits for r in patterns.find(df, "id", "body", table).collect()} == want
    assert {(r.id, r.phrase): r.hits for r in patterns.find(df, "id", "body", table, most=30_000).collect()} == want


def test_phrases_with_symbols(spark):
    texts = ["C++ and c; C# .NET net.", "a_b a-b R&D r & d", "é+e x+", "++ c+++"]
    phrases = ["c++", "c#", ".net", "net", "a_b", "a", "a-b", "r&d", "r & d", "é", "++", "+", "x+", "d r"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    got = {(r.id, r.phrase): r.hits for r in patterns.find(df, "id", "body", spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()}
    want = {(i, p): n for i, t in enumerate(texts) for p in phrases if (n := len(re.findall(rf"(?<![a-z0-9_])(?={re.escape(p)}(?![a-z0-9_]))", t.lower())))}
    assert got == want


def test_rules_as_a_table(spark):
    from tessera.operators import extract

    texts = ["We teach SQL, probability theory and risk.", "Co-managing retinal disease; solar pv!", None, "nothing here", "regression in python"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    table = patterns.rule_table(spark.createDataFrame([(i, list(p), list(s)) for i, (p, s) in enumerate(values.MODULE_RULES)], "i long, patterns array<string>, skills array<string>"), "i")
    want = {r.id: r.s for r in df.select("id", extract.rule_hits("body").alias("s")).collect()}
    assert {r.id: r.skills for r in patterns.rule_skills(df, "id", "body", table).collect()} == want and sum(map(bool, want.values())) == 3
    vocabulary = ["sql", "c++", "data mining", "r&d", "mining"]
    rows = spark.createDataFrame([(1, "Data mining. SQL; sql_x: R&D\nc++ c++"), (2, None)], "id int, body string")
    mine = patterns.keyword_skills(rows, "id", "body", spark.createDataFrame([(v,) for v in vocabulary], "skill string"))
    assert {tuple(r) for r in mine.collect()} == {tuple(r) for r in extract.keyword_hits(rows, "id", "body", vocabulary).collect()}


def test_ngrams_and_counts(spark, monkeypatch):
    rng = random.Random(3)
    lists = [[rng.choice(["a", "b", "é", "zz"]) for _ in range(rng.randint(0, 9))] for _ in range(60)] + [None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id int, w array<string>")
    grams_of = lambda w, n: [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    from tessera.functions import text

    monkeypatch.setattr(grams, "BLOCK_WORDS", 20)
    want = {i: sorted({g for n in (1, 2, 3) for g in grams_of(x or [], n)}, key=str.encode) for i, x in enumerate(lists)}
    assert {r.id: r.g for r in df.select("id", text.ngrams("w").alias("g")).collect()} == want
    freq, docs = collections.Counter(), collections.Counter()
    for x in lists:
        found = [g for n in (1, 2) for g in grams_of(x or [], n)]
        freq.update(found)
        docs.update(set(found))
    counts = rules.phrase_counts(df, "w", 1, 2)
    assert {r.phrase: (r.freq, r.docs) for r in counts.collect()} == {p: (freq[p], docs[p]) for p in freq}
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_fuzzy_lists_compare_few_pairs():
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(3, 18))) for _ in range(150)]

    def changed(w):
        w = list(w)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("abcdefghij ")
        return "".join(w)

    lists = [[changed(rng.choice(base)) for _ in range(rng.randint(0, 20))] for _ in range(150)] + [[], ["", ""], ["é", "e", "é"], ["a" * 300, "a" * 299 + "b"]]
    want = [fuzzy.greedy_distinct(x) for x in lists]
    found, compared = fuzzy.distinct_lists(lists)
    assert found == want and compared < 0.05 * sum(len(x) * (len(x) - 1) // 2 for x in lists)
    assert fuzzy.distinct_lists(lists, most_pairs=7)[0] == want and fuzzy.distinct_lists([]) == ([], 0)


# ---------------------------------------------------------------- vectors


@pytest.mark.parametrize("block", [1000, 7])
@pytest.mark.parametrize("k", [1, 3])
def test_nearest_in_blocks(spark, block, k):
    rng = random.Random(block + k)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    targets = sorted({*words[:30], "same", "same2"})
    model = embed.HashingEmbedder(32)
    left = spark.createDataFrame([(w,) for w in [*words, *words[:5]]], "p string")
    right = spark.createDataFrame([(t, t.upper()) for t in targets], "t string, l string")
    got = collections.defaultdict(list)
    for r in embed.nearest(left, right, model, "p", "t", "l", k=k, block=block).collect():
        got[r.p].append((round(-r.near, 5), r.l))
    near = model(sorted(set(words))).astype(np.float32) @ model(targets).astype(np.float32).T
    for p, row in zip(sorted(set(words)), near):
        want = sorted((round(float(-s), 5), t.upper()) for s, t in zip(row, targets))[:k]
        assert sorted(got[p]) == want
    assert embed.nearest(left, right.limit(0), model, "p", "t", "l").count() == 0


def test_semantic_matches(spark):
    f = mapping.Framework()
    f.add("Machine Learning", "hard", ["machine learning", "deep learning"])
    f.add("Poetry", "soft", ["poems"])
    rows = spark.createDataFrame([("machine learnings",), ("poem",), ("xylophone",)], "phrase string")
    got = {r.key: (r.canonical_skill, r.match_type) for r in mapping.map_phrases(rows, *f.tables(spark), embedder=embed.HashingEmbedder(), threshold=0.5).collect()}
    assert got == {"machine learnings": ("Machine Learning", "semantic"), "poem": ("Poetry", "semantic"), "xylophone": ("xylophone", "unmapped")}


def by_merging(vectors, limit):
    """Average linkage by merging the two closest clusters until none are within the limit."""
    groups = [[i] for i in range(len(vectors))]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    far = 1 - unit @ unit.T
    while len(groups) > 1:
        d, i, j = min((far[np.ix_(a, b)].mean(), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y)
        if d > limit:
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def test_clusters_by_components(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.standard_normal((1, 6)) * 3 + rng.standard_normal((n, 6)) * s for n, s in ((9, 0.3), (14, 0.9), (6, 2.0), (20, 1.2))]).astype(np.float32)
    names = [f"p{i:02}" for i in range(len(v))]
    df = spark.createDataFrame([(n, i + 1, x.tobytes()) for i, (n, x) in enumerate(zip(names, v))], "phrase string, freq int, v binary")
    monkeypatch.setattr(clusters, "BLOCK", 10)
    got = collections.defaultdict(set)
    for r in clusters.phrase_clusters(df, "phrase", "freq", "v").collect():
        got[r.cluster, r.support].add(names.index(r.phrase))
    want = by_merging(v.astype(float), 0.32)
    assert {frozenset(g) for g in got.values()} == want and 4 < len(want) < len(v)
    assert all(names[min(g)] == c and sum(i + 1 for i in g) == s for (c, s), g in got.items())
    assert clusters.phrase_clusters(df.limit(0), "phrase", "freq", "v").count() == 0


def test_similar_pairs(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((40, 3)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(v)], "k int, v binary")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if unit[i] @ unit[j] >= 0.8}
    for block in (100, 6):
        found = clusters.similar_pairs(df, "k", "v", 0.8, block).collect()
        assert len(found) == len(want) and {(r.a, r.b) for r in found} == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(70)] + [(100 + rng.randint(0, 60), 100 + rng.randint(0, 60)) for _ in range(45)]
    nodes = sorted({x for e in edges for x in e} | {999})
    label = {x: x for x in nodes}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = clusters.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == label


# ---------------------------------------------------------------- quantiles


@pytest.mark.parametrize("cells", [2, 16, 1024])
def test_quantiles_by_refinement(spark, cells):
    rng = random.Random(cells)
    rows = [("a", rng.gauss(0, 1)) for _ in range(301)] + [("b", float(rng.randint(0, 3))) for _ in range(50)] + [("c", 10.0 ** rng.randint(-30, 30)) for _ in range(40)]
    rows += [("d", 5.0), ("e", None), ("f", float("nan")), ("f", 1.0), ("f", None), (None, 2.0), (None, 4.0)]
    rows += [("g", x) for x in (float("inf"), float("-inf"), 1.0, 2.0, 3.0)] + [("h", 1.7e308), ("h", -1.7e308), ("h", 0.0)] + [("z", -0.0), ("z", 0.0), ("z", 5e-324)]
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: (r.n, r.q) for r in quantiles.group_quantiles(df, "g", "v", shares, cells).collect()}
    groups = collections.defaultdict(list)
    for g, v in rows:
        if v is not None and v == v:
            groups[g].append(v)
    assert set(got) == set(groups)
    for g, v in groups.items():
        v.sort()
        for s, q in zip(shares, got[g][1]):
            p = s * (len(v) - 1)
            low, high = v[int(np.floor(p))], v[int(np.ceil(p))]
            want = low if low == high else (np.ceil(p) - p) * low + (p - np.floor(p)) * high
            assert q == want or abs(q - want) <= 1e-9 * abs(want), (g, s)
        assert got[g][0] == len(v)
    held = {r.g: (r.n, r.q) for r in quantiles.quantiles(df.where("g <> 'g'"), "g", "v", shares).collect()}
    assert set(held) == {g for g in groups if g and g != "g"} and all(held[g][0] == got[g][0] and np.allclose(held[g][1], got[g][1]) for g in held)


def test_outliers_by_refinement(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), rng.choice([None, 1.0, rng.gauss(50, 10), 1000.0])) for i in range(300)] + [(900, None, 3.0), (901, "c", 7.0)]
    df = spark.createDataFrame(rows, "i int, g string, v double")
    want = {r.i: r.v for r in clean_jobs.outliers_to_median(df, "v", "g").collect()}
    monkeypatch.setattr(quantiles, "HELD_ROWS", 0)
    got = {r.i: r.v for r in clean_jobs.outliers_to_median(df, "v", "g").collect()}
    assert set(got) == set(want) and all(got[i] == want[i] or abs(got[i] - want[i]) < 1e-9 for i in want)


# ---------------------------------------------------------------- pages


def test_paged_source(spark, tmp_path):
    state, log = tmp_path / "pages", tmp_path / "log"
    state.write_text("23")
    log.write_text("")

    def fetch(page):
        with open(log, "a") as f:
            f.write(f"{page}\n")
        if page > int(state.read_text()):
            return None
        return json.dumps({"results": [{"code": page // 3, "n": page}, {"code": -page, "n": page}], "next": page < 23 or None})

    pages = paged.fetched(spark, fetch, lanes=4)
    assert sorted(r.page for r in pages.collect()) == list(range(1, 24))
    asked = [int(x) for x in log.read_text().split()]
    assert max(asked) <= 27 and len(asked) == len(set(asked)) == 27  # every page once, and one beyond the end for each lane
    found = {r.code: r.n for r in paged.listed_records(pages, "code int, n int").collect()}
    assert found == {**{c: max(1, 3 * c) for c in range(8)}, **{-p: p for p in range(1, 24)}}
    # kept up over runs: a second one fetches what is new
    table = paged.appended(spark, fetch, str(tmp_path / "kept"), lanes=3)
    assert sorted(r.page for r in table.collect()) == list(range(1, 24))
    log.write_text("")
    state.write_text("30")
    again = paged.appended(spark, fetch, str(tmp_path / "kept"), lanes=3)
    assert sorted(r.page for r in again.collect()) == list(range(1, 31))
    assert min(int(x) for x in log.read_text().split()) >= 23


def test_ends_of_pages(spark):
    def pages(*bodies):
        return spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in bodies], "page bigint, body string")

    some = lambda *codes, more=True: {"results": [{"code": c, "x": str(c)} for c in codes], "next": "url" if more else None}
    read = lambda *bodies: sorted(str(r.code) for r in paged.listed_records(pages(*bodies), "code string, x string").collect())
    assert read((1, some("a", "b")), (2, some("b", "c", more=False)), (3, some("d"))) == ["a", "b", "c"]
    assert read((1, some("a")), (2, some()), (3, some("d"))) == ["a"]
    assert read((1, some("a")), (3, some("d"))) == ["a"]
    assert read((1, some("a")), (2, "no json"), (3, some("d"))) == ["a"] and read((1, None)) == []
    assert read((1, some(None, None, "a", more=False))) == ["None", "a"]
    known = lambda *bodies: sorted(r.code for r in paged.records_until_known(pages(*bodies), "code string").collect())
    rows = lambda *codes: [{"code": c} for c in codes]
    assert known((1, rows("a")), (2, rows("a", "b")), (3, rows("b")), (4, rows("z"))) == ["a", "b"]
    assert known((1, rows("a")), (2, rows("b"))) == ["a", "b"] and known((1, rows()), (2, rows("b"))) == []


def test_document_of_any_size(spark, tmp_path):
    for n in (0, 1, 2500):
        rows = spark.range(n).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('é"\n'), "id")).alias("t"))
        writers.document_file(rows.repartition(5), str(tmp_path / str(n)))
        part, = [p for p in (tmp_path / str(n)).iterdir() if p.name.startswith("part-")]
        got = json.loads(part.read_text())
        assert sorted((r["id"], r["t"]) for r in got) == [(i, f'é"\n{i}' if i % 3 else None) for i in range(n)]


def test_shared_tables_go(spark):
    with shared.scratch():
        gone = shared.new_path(spark, "a")
        kept = shared.new_path(spark, "b")
        shared.lasting(kept)
        spark.range(2).write.parquet(gone)
        spark.range(3).write.parquet(kept)
    where, system = shared.files(spark, gone)
    assert not system.exists(where) and spark.read.parquet(kept).count() == 3
    assert shared.own_folder(spark) in kept


# ---------------------------------------------------------------- streams


@pytest.mark.parametrize("seed", [1, 2])
def test_profiles_whatever_the_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    versions = [(k, v, rng.choice(["c1", "c2", None, ""]), rng.choice([0, 1, None]), rng.choice([None, [], ["x"], ["x", "y", "x"], ["y", None]])) for k in range(30) for v in range(3)]
    versions += [versions[0], versions[0], (0, None, "c9", 1, ["z"])]
    rng.shuffle(versions)
    shape = "k int, version int, code string, good int, skills array<string>"
    for i in range(4):
        spark.createDataFrame(versions[i::4], shape).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    families, skills = profiles.kept_profile(profiles.changes(stream, "k", "version", "code", "good", "skills"), str(tmp_path / "out"))
    last = {}
    for k, v, c, g, s in versions:
        if k not in last or (v or 0) > last[k][0]:
            last[k] = (v or 0, c, g, s)
    jobs = spark.createDataFrame([(c, "", g or 0, [x for x in s or [] if x]) for _, c, g, s in last.values()], "code string, title string, is_good_job int, skills array<string>")
    want_families, want_skills = align.family_profiles(jobs, distinct=True)
    pick = lambda df, *cols: sorted(map(tuple, df.select(*cols).collect()))
    for got, want, cols in ((families, want_families, ("code", "job_count", "good_job_count", "good_job_pct")), (skills, want_skills, ("code", "skill", "cnt", "rk"))):
        assert pick(got, *cols) == pick(want, *cols)


def test_versions_never_leave_the_jvm(spark):
    """The last version of a posting is an aggregate of the engine's own: no row goes through Python."""
    rows = spark.createDataFrame([(1, 1, "a", 1, ["x"]), (1, 2, "b", None, ["y", "x", None]), (1, None, "c", 1, [])], "k int, version int, code string, good int, skills array<string>")
    last = profiles.changes(rows, "k", "version", "code", "good", "skills")
    assert "Python" not in (plan := last._jdf.queryExecution().executedPlan().toString()) and "Pandas" not in plan
    assert [tuple(r.last) for r in last.collect()] == [(2, "b", 0, ["x", "y"])]


# ---------------------------------------------------------------- curated values


def test_curated_lists(spark):
    assert [len(x[4]) for x in values.SCOPE_LISTS] == [6, 32, 0, 25, 1] and len(set((*values.COURSE_HARD_SKILLS, *values.COURSE_SOFT_SKILLS))) == len((*values.COURSE_HARD_SKILLS, *values.COURSE_SOFT_SKILLS)) - 2
    rows = [("nus", "Physics", None), ("NUS", "Law", "Science"), ("NTU", "Robotics (MAE)", ""), ("NTU", "Physics", "Science"), ("SUTD", "ASD", None), ("SUTD", "Humanities, Arts and Social Sciences", None), ("SUTD", None, None), ("X", "Physics", "Science")]
    df = spark.createDataFrame(rows, "university string, department string, faculty string")
    got = [r.b for r in df.select(scope.metadata_bucket("university", "department", "faculty").alias("b")).collect()]
    assert [b == "clear_stem" for b in got] == [True, True, True, False, True, False, False, False]
    listed = {(r.university, r.field, r.value): r.bucket for r in scope.university_lists(df).collect()}
    assert listed[("NUS", "department", "Law")] == "unclear_or_mixed" and listed[("SUTD", "department", "ASD")] == "clear_stem" and len(listed) == 8


def test_prototypes(spark):
    model = embed.HashingEmbedder(64)
    texts = ["linear algebra and machine learning", "novels and poems", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    mean = lambda xs: (lambda m: m / np.linalg.norm(m))(model(list(xs)).mean(0))
    one, other = mean(values.STEM_SENTENCES), mean(values.OTHER_SENTENCES)
    for r in scope.prototype_margin(df, "body", model).collect():
        v = model([texts[r.id] or ""])[0]
        assert r.stem_similarity == pytest.approx(v @ one) and r.non_stem_similarity == pytest.approx(v @ other) and r.margin == pytest.approx(v @ one - v @ other)


def test_frequent_mapping(spark):
    jobs = spark.createDataFrame([(["SQL", "sql ", "java"],), (["java", "welding"],), (None,)], "skills array<string>")
    raw = spark.createDataFrame([("Sql!",), ("javas",), ("zzz",), ("",), (None,), ("welding",)], "phrase string")
    rows = lambda **how: {r.raw_skill: (r.mapped_skill, r.match_type) for r in mapping.map_to_frequent(raw, jobs, **how).collect()}
    assert rows(n=2) == {"sql": ("sql", "exact"), "javas": ("javas", "unmapped_no_model"), "zzz": ("zzz", "unmapped_no_model"), "welding": ("welding", "unmapped_no_model")}
    got = rows(n=3, embedder=embed.HashingEmbedder(), threshold=0.5)
    assert got == {"sql": ("sql", "exact"), "welding": ("welding", "exact"), "javas": ("java", "semantic"), "zzz": ("zzz", "unmapped_below_threshold")}
    none = mapping.map_to_frequent(raw, jobs.limit(0))
    assert {r.match_type for r in none.collect()} == {"unmapped"}
    assert {r.match_type for r in mapping.map_to_frequent(raw, jobs.limit(0), embedder=embed.HashingEmbedder()).collect()} == {"unmapped"}


def test_listing_by_walk(spark):
    """The table function against the windows, documents of their own side by side."""
    from tessera.sources import listing, readers

    rng = random.Random(3)
    kinds = ["CORE", "50.00{} Algebra {}", "Term: {} {}", "Credits: {} {}", "credits", "terms", "", None, "tags"]
    rows = [(d, n, None if (k := rng.choice(kinds)) is None else k.format(rng.randint(0, 9), rng.randint(0, 9))) for d in range(12) for n in range(rng.randint(0, 40))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "d int, n int, l string").repartition(5)
    pick = lambda x: sorted(str(tuple(r)) for r in x.select("d", "code", "title", "course_type", "terms", "credits").collect())
    got = pick(listing.course_records(df, "d", "n", "l"))
    assert got == pick(readers.course_blocks(df, "d", "n", "l")) and len(got) > 20
    assert listing.course_records(df.limit(0), "d", "n", "l").count() == 0
