"""Finding 1 of round 4: tables that Spark takes for small are not sent through the driver."""

from tessera.llm import spelling, work


def test_no_join_of_spelling_is_a_broadcast(spark, monkeypatch):
    """Candidates are far more than the file of words they are made from lets Spark think."""
    plans, written = [], work.written
    monkeypatch.setattr(work, "written", lambda df, *a, **how: plans.append(df) or written(df, *a, **how))
    rows = [(w,) for w, n in (("letters", 25), ("lettters", 5), ("leters", 5), ("apart", 9)) for _ in range(n)]
    out = spelling.variants(spark.createDataFrame(rows, "word string"), least_length=5)
    text = [df._jdf.queryExecution().executedPlan().toString() for df in (*plans, out)]
    assert sum("SortMergeJoin" in t for t in text) >= 3 and not any("Broadcast" in t for t in text)
    assert {(r.word, r.form, r.root, r.n_near) for r in out.collect()} == {("letters", None, "letters", 2), ("lettters", "letters", "letters", 1), ("leters", "letters", "letters", 1), ("apart", None, "apart", 0)}
