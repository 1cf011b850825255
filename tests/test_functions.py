"""Scalar, array and fuzzy functions on literal tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays, fuzzy, numeric, text


@pytest.fixture
def one(spark):
    def run(column, **values):
        schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
        return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first().x

    return run


@pytest.mark.parametrize(
    ("given", "expected"),
    [("Excellent Communication Skills!", "communication"), ("Risk Management", "risk management"), ("Team Player", None), ("Excel Skills", "excel"), ("R&D", "randd"), ("", None), (None, None)],
)
def test_job_skill(one, given, expected):
    assert one(text.job_skill("s"), s=("string", given)) == expected


@pytest.mark.parametrize(("given", "expected"), [("  **Data  Analysis!! ", "data analysis"), ("C++", "c++"), (None, ""), ("a  b", "a b")])
def test_phrase_key(one, given, expected):
    assert one(text.phrase_key("s"), s=("string", given)) == expected


def test_texts(one):
    assert one(text.chunks("s"), s=("string", "a. b; c:d\ne")) == ["a", "b", "c:d", "e"]
    assert one(text.sentences("s"), s=("string", "A b. C d! E")) == ["A b.", "C d!", "E"]
    assert one(text.skill_label("s"), s=("string", "- C++ ,")) == "C++"
    assert one(text.titled("s"), s=("string", "theory OF the state")) == "Theory of the State"
    assert one(text.shortened("s", 10), s=("string", "abcdefg hijklm")) == "abcdefg..."
    assert one(text.slug("s"), s=("string", "Arts & Ideas!")) == "arts-and-ideas"
    assert one(text.tokens("s"), s=("string", "The job of C 12 data-Analyst")) == ["data", "analyst"]
    assert one(text.ngrams("s", 1, 2), s=("array<string>", ["b", "a"])) == ["a", "b", "b a"]
    assert one(text.ngrams("s", 2, 3), s=("array<string>", ["b"])) == []


def test_phrase_bounds(one):
    assert not one(text.contains_phrase("s", "sql"), s=("string", "nosql"))
    assert one(text.contains_phrase("s", "c++"), s=("string", "c++ code"))
    assert not one(text.contains_phrase("s", "c++", compat=True), s=("string", "c++ code"))


@pytest.mark.parametrize(("a", "b", "same"), [("engineer", "engineering", True), ("data", "database", False), ("sql", "sql", True)])
def test_soft_equal(one, a, b, same):
    assert one(text.soft_equal("a", "b"), a=("string", a), b=("string", b)) is same


@pytest.mark.parametrize(("given", "expected"), [("5k", 5000), ("$4,500", 4500), ("3.5k", 3500), ("abc", None)])
def test_money(one, given, expected):
    assert one(numeric.money("s"), s=("string", given)) == expected


@pytest.mark.parametrize(("given", "expected"), [("21412.0", ("21412", "2141", "214")), ("2141", (None,) * 3), ("A-25121", ("25121", "2512", "251"))])
def test_occupation_code(one, given, expected):
    assert tuple(one(numeric.occupation_code("s", n), s=("string", given)) for n in (5, 4, 3)) == expected


@pytest.mark.parametrize(("given", "expected"), [("Yes", 1), ("0", 0), ("2", 1), (None, 0), ("no", 0)])
def test_flag(one, given, expected):
    assert one(numeric.flag("s"), s=("string", given)) == expected


@pytest.mark.parametrize(("low", "high", "expected"), [(12.0, 15.0, (360, 900)), (90.0, 2500.0, (2700, 150000)), (100.0, 100.0, (100, 100)), (None, 50.0, (None, 3000))])
def test_hourly(one, low, high, expected):
    assert tuple(one(c, a=("double", low), b=("double", high)) for c in numeric.hourly_to_weekly("a", "b")) == expected


def test_arrays(one):
    x = ("array<string>", ["Full Time", "Contract", "Permanent"])
    assert one(arrays.by_priority("x", ("Permanent", "Contract")), x=x) == "Permanent"
    assert one(arrays.by_position("x", ("Part Time", "Full Time")), x=("array<string>", ["Contract", "Part Time", "Full Time"])) == "Part Time"
    assert one(arrays.by_priority("x", ("Permanent",)), x=("array<string>", None)) == "Unknown"
    assert one(arrays.first_by_key("x", F.array(F.lit("contract"), F.lit("New"))), x=x) == ["Full Time", "Contract", "Permanent", "New"]
    assert one(arrays.list_cell("x"), x=("string", "['a', 'b']")) == ["a", "b"]
    assert one(arrays.list_cell("x"), x=("string", "a")) == ["a"]
    assert one(arrays.sorted_set("x"), x=("array<string>", ["b", None, "a", "b", ""])) == ["a", "b"]
    assert one(arrays.dot("x", "x"), x=("array<float>", [3.0, 4.0])) == 25.0


def test_fuzzy(spark):
    assert fuzzy.greedy_distinct(["java", "java script", "javascript"]) == ["java", "java script"]
    assert fuzzy.page_text("<p>a &amp; b<script>x</script></p>") == "a & b"
    df = spark.createDataFrame([(["ab", "xyz", None],), (None,)], "v array<string>")
    assert [r.x for r in df.select(fuzzy.near_distinct("v").alias("x")).collect()] == [["ab", "xyz"], []]
    assert fuzzy.mmr(np.array([1.0, 0]), np.array([[1.0, 0], [0.99, 0.14], [0.6, 0.8]]), 2, 0.8) == [0, 2]


def test_mmr_equals_all_pairs():
    rng = np.random.default_rng(4)
    v, q = rng.standard_normal((60, 8)), rng.standard_normal(8)
    picked = [int(np.argmax(v @ q))]
    while len(picked) < 10:
        left = [i for i in range(60) if i not in picked]
        picked.append(max(left, key=lambda i: 0.2 * (v[i] @ q) - 0.8 * max(v[i] @ v[j] for j in picked)))
    assert fuzzy.mmr(q, v, 10, 0.8) == picked and fuzzy.mmr(q, v[:2], 5) in ([0, 1], [1, 0])
