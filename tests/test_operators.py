"""Operators against hand-made tables, a dense scorer and their properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import align, clean_jobs, embed, explore, extract, mapping, rules, scope, search
from tessera.plans import pipelines
from tessera.sources import readers, writers


def dense(module, family, k, w=align.Weights()):
    """The definitions as they read, over one module and one family's counts."""
    if not module or not family:
        return 0.0, 0.0, 0.0, 1.0
    top = sorted(family, key=lambda s: (-family[s], s))[:k]
    cov = sum(s in module for s in top) / len(top)
    gap = 1 - sum(family[s] for s in top if s in module) / sum(family[s] for s in top)
    m = {s: 1 / len(module) for s in module}
    f = {s: c / sum(family.values()) for s, c in family.items()}
    keys = set(m) | set(f)
    wj = sum(min(m.get(s, 0), f.get(s, 0)) for s in keys) / sum(max(m.get(s, 0), f.get(s, 0)) for s in keys)
    cos = sum(m.get(s, 0) * f.get(s, 0) for s in keys) / math.sqrt(sum(v * v for v in m.values()) * sum(v * v for v in f.values()))
    return cov, wj, cos, gap


def test_alignment_example(spark):
    jobs = spark.createDataFrame([("x", "X", 1, ["A"]), ("x", "X", 0, ["A"]), ("x", "X", 0, ["A", "C"]), ("x", "X", 0, ["C"][:0] or ["A"][:0])], "code string, title string, is_good_job int, skills array<string>")
    families, theirs = align.family_profiles(jobs)
    modules = spark.createDataFrame([(1, ["A", "B"]), (2, [])], "module_id int, skills array<string>")
    got = {r.module_id: r for r in align.top_matches(modules, align.module_skills(modules), families, theirs).collect()}
    r = got[1]
    assert (r.coverage, r.jaccard, r.cosine, r.gap, r.score) == (0.5, 0.3333, 0.6708, 0.25, 0.53)
    assert r.job_count == 3 and r.good_job_pct == 0.3333
    assert (got[2].score, got[2].gap, got[2].overlap, got[2].rank) == (0.0, 1.0, [], 1)


def test_sparse_is_dense(spark):
    rng = random.Random(3)
    names = [f"s{i}" for i in range(12)]
    modules = [(i, rng.sample(names, rng.randint(0, 5))) for i in range(25)]
    jobs = [(f"f{rng.randint(0, 6)}", "T", rng.randint(0, 1), rng.sample(names, rng.randint(0, 4))) for _ in range(60)]
    jobs_df = spark.createDataFrame(jobs, "code string, title string, is_good_job int, skills array<string>")
    families, theirs = align.family_profiles(jobs_df)
    mods = spark.createDataFrame(modules, "module_id int, skills array<string>")
    for weights, n in ((align.Weights(), 5), (align.LEGACY, 4)):
        got = align.top_matches(mods, align.module_skills(mods), families, theirs, k=3, n=n, weights=weights).collect()
        counts: dict = {}
        size: dict = {}
        for code, _, _, skills in jobs:
            if skills:
                size[code] = size.get(code, 0) + 1
                for s in skills:
                    counts.setdefault(code, {}).setdefault(s, 0)
                    counts[code][s] += 1
        for i, skills in modules:
            want = []
            for code, family in counts.items():
                c, j, s, g = dense(set(skills), family, 3)
                total = weights.coverage * c + weights.jaccard * j + weights.cosine * s + weights.gain * (1 - g) - weights.loss * g
                total = max(0, min(1, total)) if weights.clamped else total
                want.append((-round(total, 4), -len(set(skills) & set(family)), -size[code], code))
            mine = [(-r.score, -r.overlap_count, -r.job_count, r.code) for r in sorted((r for r in got if r.module_id == i), key=lambda r: r.rank)]
            assert len(mine) == min(n, len(counts))
            for a, b in zip(mine, sorted(want)):
                assert abs(a[0] - b[0]) < 2e-4 and a[1:] == b[1:]


def test_renaming_skills_keeps_scores(spark):
    jobs = spark.createDataFrame([("x", "X", 1, ["A", "B"]), ("y", "Y", 0, ["B", "C"])], "code string, title string, is_good_job int, skills array<string>")
    mods = spark.createDataFrame([(1, ["A", "C"]), (2, ["B"])], "module_id int, skills array<string>")

    def scores(j, m):
        families, theirs = align.family_profiles(j)
        return sorted((r.module_id, r.code, r.score) for r in align.top_matches(m, align.module_skills(m), families, theirs).collect())

    rename = F.transform("skills", lambda s: F.concat(F.lit("new "), s))
    assert scores(jobs, mods) == scores(jobs.withColumn("skills", rename), mods.withColumn("skills", rename))


def test_outliers(spark):
    ten = [("a", float(v)) for v in [*range(1, 10), 100]]
    nine = [("b", float(v)) for v in [*range(1, 9), 100]]
    null = [("c", float(v)) for v in range(1, 11)] + [("c", None)]
    got = clean_jobs.outliers_to_median(spark.createDataFrame(ten + nine + null, "g string, v double"), "v", "g").collect()
    assert sorted(r.v for r in got if r.g == "a")[-1] == 9.0 and 5.5 in [r.v for r in got if r.g == "a"]
    assert 100.0 in [r.v for r in got if r.g == "b"]
    assert [r.v for r in got if r.g == "c"].count(5.5) == 1


def test_mode_tie_and_unknown(spark):
    rows = [(1, "Full Time", 10.0), (1, "Part Time", 20.0), (1, "Unknown", 5.0), (2, "Unknown", 50.0), (2, "Unknown", 1.0), (3, "Unknown", None)]
    got = clean_jobs.impute_work_type(spark.createDataFrame(rows, "g int, w string, p double"), "w", "p", "g").collect()
    assert sorted((r.g, r.w) for r in got) == [(1, "Full Time"), (1, "Full Time"), (1, "Part Time"), (2, "Full Time"), (2, "Part Time"), (3, "Unknown")]


@pytest.mark.parametrize(("exclusion", "expected"), [("documented", "excluded"), ("batch_compat", "exact")])
def test_mapping(spark, exclusion, expected):
    f = mapping.Framework(excluded=["regression"])
    f.add("Econometrics", "hard", ["regression"])
    f.add("Regression Analysis", "hard", ["regression"])
    phrases = spark.createDataFrame([("Regression!",), ("",), ("econometrics",), ("zzz",)], "phrase string")
    got = {r.key: r for r in mapping.map_phrases(phrases, *f.tables(spark), exclusion=exclusion).collect()}
    assert got["regression"].match_type == expected
    assert expected == "excluded" or got["regression"].canonical_skill == "Regression Analysis"
    assert got[""].match_type == "empty" and got["zzz"].canonical_skill == "zzz" and got["zzz"].match_type == "unmapped"
    near = mapping.map_phrases(phrases, *f.tables(spark), embedder=embed.HashingEmbedder(), threshold=0.99)
    assert {r.key: r.match_type for r in near.collect()}["zzz"] == "unmapped"
    again = mapping.map_phrases(mapping.map_phrases(phrases, *f.tables(spark)).where("match_type = 'exact'").select(F.col("canonical_skill").alias("phrase")), *f.tables(spark))
    assert all(r.match_type == "exact" for r in again.collect())


def test_pipeline(spark):
    f = mapping.Framework()
    f.add("SQL", "tool", ["sql", "databases"])
    modules = spark.createDataFrame([("m1", "NUS", "CS", ["databases", "poetry"]), ("m2", "NUS", "CS", [])], "id string, source string, department string, skills array<string>")
    jobs = spark.createDataFrame([("j1", "25121", 1, ["sql"]), ("j2", "2512", 1, ["sql"]), ("j3", "99999", 0, ["sql"])], "id string, ssoc_code string, is_good_job int, skills array<string>")
    titles = spark.createDataFrame([("251", "Developers")], "code string, title string")
    out = pipelines.alignment(modules, jobs, titles, f)
    s = out.summary.first()
    assert (s.module_count, s.empty_modules, s.job_group_count, s.top1_overlap_modules) == (2, 1, 1, 1)
    assert {r.module_id: r.score > 0 for r in out.matches.collect()} == {"m1": True, "m2": False}
    assert pipelines.comparison(out, out).where("change <> 0").count() == 0


def test_scope(spark):
    rows = [(1, "other", "why", -0.02, 5, True), (2, "other", "why", 0.06, 0, False), (3, "other", "why", 0.03, 1, False), (4, "other", "why", -0.01, 0, True), (5, "clear_stem", "meta", -1.0, 0, False), (6, "other", "why", 0.0, 0, False)]
    df = spark.createDataFrame(rows, "i int, base string, why string, m double, v int, k boolean")
    bucket, reason = scope.cascade("base", "why", "m", "v", "k")
    out = df.select("i", bucket.alias("b"), reason.alias("r")).withColumn("path", scope.path("b", "r"))
    assert [r.path for r in out.orderBy("i").collect()] == ["paragraph_non_stem", "paragraph_stem", "sentence_stem", "keyword_stem", "metadata_stem", "keyword_remainder"]
    edges = scope.flow_edges(out).collect()
    into, outof = {}, {}
    for e in edges:
        into[e.target] = into.get(e.target, 0) + e.value
        outof[e.source] = outof.get(e.source, 0) + e.value
    assert outof["All Modules"] == 6 == into["Final STEM"] + into["Final non-STEM"]
    assert into["Final STEM"] == out.where("b = 'clear_stem'").count()
    assert all(outof[n] == into[n] for n in into if not n.startswith("Final"))
    signal = df.select(scope.keyword_signal(F.lit("Python programming")).alias("a"), scope.keyword_signal(F.lit("Literary analysis by programming")).alias("b")).first()
    assert (signal.a, signal.b) == (4, 0)


def test_intent():
    got = search.interpret("part time data analyst above 3k at NUS", ["data", "data analyst"])
    assert (got.work_type, got.salary_min, got.school, got.core) == ("Part Time", 3000, "NUS", "data analyst at")
    assert got.tokens == ["data", "analyst"] and got.skills == ["data analyst"] and got.plain == []
    assert search.interpret("above $4,500").salary_min == 4500
    assert search.interpret("above $4,500", strict_compat=True).salary_min == 4


def test_answer(spark):
    jobs = spark.createDataFrame([("u1", "data analyst", ["data", "analyst"], ["sql"], [], ["sql"], ["sql"], "Full Time", 0, 3000.0, 4000.0, 3500.0)], "uuid string, title_norm string, title_tokens array<string>, description_tokens array<string>, category_tokens array<string>, skill_set array<string>, skills array<string>, work_type string, minimum_years_experience int, salary_minimum double, salary_maximum double, avg_salary double")
    modules = spark.createDataFrame([("m1", "NUS", ["data"], ["sql"])], "module_id string, source string, title_tokens array<string>, skills array<string>")
    got = search.answer(jobs, modules, "data analyst with sql", ["sql"])
    assert got["jobs"][0]["uuid"] == "u1" and got["modules"][0]["module_id"] == "m1" and "1 job postings" in got["summary"]
    with pytest.raises(ValueError):
        search.answer(jobs, modules, " ")


def test_extraction(spark):
    df = spark.createDataFrame([(1, "SQL and c++ here. More sql; data mining.")], "id int, body string")
    hits = {r.skill: r.hits for r in extract.keyword_hits(df, "id", "body", ["sql", "c++", "mining"]).collect()}
    assert hits == {"sql": 2, "c++": 1, "mining": 1}
    more = spark.createDataFrame([(1, "data  mining; Data Mining, R&D. datamining; data-mining here")], "id int, body string")
    assert {r.skill: r.hits for r in extract.keyword_hits(more, "id", "body", ["data mining", "r&d", "data", "here r"]).collect()} == {"data mining": 1, "r&d": 1, "data": 3}
    got = df.select(extract.rule_hits("body", [(["c++"], ["C++"]), (["java"], ["Java"])]).alias("x")).first().x
    assert got == ["C++"]
    like = df.select(*[extract.skill_like(F.lit(s)).alias(s) for s in ("economics", "course design", "SQL", "x")]).first()
    assert tuple(like) == (False, False, True, False)
    assert df.select(extract.merged(F.array(F.lit("A"), F.lit("b")), F.array(F.lit("a"), F.lit("C")), n=2).alias("x")).first().x == ["A", "b"]
    ok = df.select(rules.valid_phrase(F.lit("data mining")).alias("a"), rules.valid_phrase(F.lit("design data")).alias("b"), rules.valid_phrase(F.lit("year 1")).alias("c")).first()
    assert tuple(ok) == (True, False, False)


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "MCF-1.json").write_text('{"title": "T",\n "skills": [{"skill": " x "}, {"skill": ""}], "metadata": {"originalPostingDate": "2024"}}')
    row = readers.flatten_jobs(readers.job_files(spark, str(tmp_path))).first()
    assert (row.uuid, row.skills, row.posting_date) == ("MCF-1", ["x"], "2024")
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n[]x\n')
    assert readers.json_rows(spark, str(tmp_path / "r.jsonl"), "a int").where("a = 1").count() == 1
    lines = [(1, i, s) for i, s in enumerate(["CORE", "50.001 Algebra", "Term: 1", "Credits: 12", "50.002 Sets"])]
    got = readers.course_blocks(spark.createDataFrame(lines, "d int, n int, l string"), "d", "n", "l").orderBy("code").collect()
    assert [(r.code, r.title, r.course_type, r.credits) for r in got] == [("50.001", "Algebra", "CORE", 12), ("50.002", "Sets", "Credits: 12", None)]
    title, heading, body, details = readers.page_record('<title>t</title><h1>H</h1><p>one</p><p>one</p><h2>Prerequisites</h2><p>no</p><tr><td>k</td><td>v</td></tr><script type="application/ld+json">{"@type":"Course","name":"N"}</script>')
    assert (title, heading, body, details) == ("N", "H", "one", {"k": "v"})
    assert writers.document(spark.createDataFrame([(["é"],)], "x array<string>")) == '[{"x": ["é"]}]'
    writers.csv(spark.createDataFrame([(["a", "b"],)], "x array<string>"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().x == "a | b"


def test_samples(spark):
    df = spark.range(100).withColumn("b", F.col("id") % 7)
    got = explore.stratified(df, "b", F.col("id"), 30)
    assert got.count() == 30 and got.groupBy("b").count().agg(F.min("count")).first()[0] >= 4
    assert explore.sampled(df, "id", 10).collect() == explore.sampled(df, "id", 10).collect()


def test_serial_numbers(spark):
    from tessera.functions.serial import numbered

    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"))
    got = numbered(df, "k").collect()
    assert sorted((r.serial, r.k) for r in got) == [(i + 1, i) for i in range(1000)]


def test_courses(spark):
    nus = spark.createDataFrame([("CS1010", "T", "D", "F", "<p>one two three four five six seven eight nine ten</p>"), ("CS5000", "T", "D", "F", "x " * 12)], "moduleCode string, title string, department string, faculty string, description string")
    ntu = spark.createDataFrame([("CZ1", "T", "one " * 12, "CSE"), ("CZ2", "T", "Offered as a graduate level course " * 3, "CSE")], "code string, title string, description string, departmentMaintaining string")
    dims = spark.createDataFrame([("CSE", "Computing")], "short string, department string")
    from tessera.operators import clean_courses

    got = clean_courses.clean(readers.courses(nus, ntu, departments=dims)).orderBy("serial").collect()
    assert [(r.serial, r.university, r.code, r.department) for r in got] == [(1, "NTU", "CZ1", "Computing"), (2, "NUS", "CS1010", "D")]
    assert got[1].description_clean == "one two three four five six seven eight nine ten"


def test_phrases_of_whole_texts(spark, tmp_path):
    from tessera import catalog

    rows = [(1, "a " * 2000 + "copper kettle"), (2, "é " * 150 + "red fox"), (3, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: set(r.phrases) for r in catalog.QUERIES["mmr_phrases"](spark, str(tmp_path)).collect()}
    assert got[1] == {"copper", "kettle", "copper kettle"} and got[2] == {"red", "fox", "red fox"}


def test_hashed_grams_are_those_of_crc32():
    from zlib import crc32

    for s in ["", "x", "two words", "naïve café"]:
        want = [0.0] * 64
        for n in (2, 3, 4):
            for i in range(len(s) + 3 - n):
                h = crc32(f" {s} "[i : i + n].encode())
                want[h % 64] += 1 if h >> 16 & 1 else -1
        size = math.sqrt(sum(x * x for x in want)) or 1
        assert embed.HashingEmbedder(64)([s, "y"])[0].tolist() == pytest.approx([x / size for x in want])
