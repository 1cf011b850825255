"""Bounds of samples, and columns that bear the operators' own names."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import decontaminate, minhash, toxicity


def sentence(rng, n):
    return " ".join(f"w{rng.randint(0, 900)}" for _ in range(n))


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(9)
    rows = [(i, sentence(rng, 60) + (" grumbletoad snarkfiend" * 4 if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    in_order = [r[0] for r in spark.createDataFrame([(i,) for i, *_ in rows], "k bigint").where(toxicity.learns("k")).orderBy(F.xxhash64("k")).collect()]
    return rows, in_order


@pytest.mark.parametrize("place", [0, 0.5, 1])
def test_one_long_text_keeps_no_other_out(spark, marked, monkeypatch, place):
    """A labelled text larger than the whole sample, first, in the middle and last by hash."""
    rows, in_order = marked
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1 << 17)
    long = in_order[int(place * (len(in_order) - 1))]
    rng = random.Random(1)
    texts = [(i, t if i != long else t + " " + sentence(rng, 60000)) for i, t, _ in rows]
    assert max(len(t) for _, t in texts) > 1 << 18
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    assert sum(got[i] == y for i, _, y in rows) >= 298
    kept = {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()}
    assert kept == {i for i, p in got.items() if not p}


def test_nothing_to_learn_from_is_said(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    with pytest.warns(UserWarning, match="no labelled text"):
        model = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert len({r.score for r in toxicity.score(docs, model).collect()}) == 1


def test_levels():
    import numpy as np

    for sizes, total in (([5, 5, 5], 9), ([1, 100], 50), ([10**9], 7), ([3, 3], 100)):
        level = toxicity.level(np.array(sizes), total)
        assert np.minimum(sizes, level).sum() <= total
    assert toxicity.level(np.array([1, 100]), 50) == 49


def test_columns_with_the_operators_names(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "a", "b", "c"), (2, text, "a", "b", "c"), (3, "other words of its own " + text[::-1], "a", "b", "c"), (None, text, "a", "b", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _loose string, _leak string, _LOOSE_ string")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3]
    items = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(10, 60)))], "item_id bigint, text string")
    clean = decontaminate.keep_clean(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [0, 3]


def test_levels_of_many_long_texts():
    """Several texts above the level: it is the largest that fits, not what the last of them leaves."""
    import numpy as np

    rng = random.Random(3)
    for sizes, total in [([10, 100, 100, 100], 100), ([90, 60, 60], 120)] + [([rng.randint(1, 60) for _ in range(rng.randint(1, 30))], rng.randint(60, 400)) for _ in range(200)]:
        fits = [k for k in range(1, total + 1) if np.minimum(sizes, k).sum() <= total]
        assert toxicity.level(np.array(sizes), total) == max(fits)


def test_many_long_texts_still_teach(spark, marked, monkeypatch):
    rows, _ = marked
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", sum(len(t) for _, t, _ in rows) // 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).where("held_out").collect()}
    assert min(scores[i] for i, _, y in rows if y and i in scores) > max(scores[i] for i, _, y in rows if not y and i in scores)


def test_sampled_texts_stay_off_the_driver(spark, marked, monkeypatch):
    """The sample is learnt from in a task, to the same model as here."""
    rows = [(i, f"{'vile' if i % 2 else 'kind'} words of text {i % 7} stand here", i % 2) for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    taught = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    arrow = DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: pytest.fail("texts at the driver") if "x" in df.columns else arrow(df))
    model = toxicity.fit(docs, labels)
    here = toxicity.train([r[1] for r in taught], np.array([r[2] for r in taught]))
    assert model.bias == here.bias and np.array_equal(model.margin, here.margin) and model.margin.any()
