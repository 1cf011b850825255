"""Files and charts: numbered lines over several blocks, fallbacks, SVG."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from tessera.operators import clean_courses, clean_jobs, extract, scope
from tessera.sources import charts, readers, shared


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    for name, n in (("a.txt", 5000), ("b.txt", 3), ("c.txt", 0)):
        (tmp_path / name).write_text("".join(f"{name} {i} {'x' * (i % 40)}\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5003 and all(int(r.value.split()[1]) == r.line and r.file.endswith(r.value.split()[0]) for r in rows)


def test_checked_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_bytes(b'{"a": 1}\n\n[1]\n{"a": "x"}\n{"a": 2}\n\x80\x04binary\n')
    good, bad = readers.checked_json_lines(spark, str(tmp_path / "r.jsonl"), "a int")
    assert sorted((r.line, r.a) for r in good.collect()) == [(1, 1), (5, 2)]
    assert sorted(r.line for r in bad.collect()) == [3, 4, 6]


def test_fetching_and_fallbacks(spark, tmp_path):
    path = str(tmp_path / "doc")
    readers.json_document(spark, path, "a int", lambda: '[{"a": 1}, {"a": 2}]')

    def fails():
        raise OSError("no network")

    assert sorted(r.a for r in readers.json_document(spark, path, "a int", fails).collect()) == [1, 2]
    with pytest.raises(Exception):
        readers.saved_table(spark, str(tmp_path / "none.parquet"), "a int").count()


def test_charts(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("a", "c", 1), ("b", "d", 3), ("c", "d<", 1)], "source string, target string, value bigint")
    flows = ET.fromstring(charts.flows(edges))
    assert len([x for x in flows if x.tag.endswith("path")]) == 4 and len([x for x in flows if x.tag.endswith("rect")]) == 5
    bands = {(r.source, r.target): (r.source_offset, r.target_offset) for r in scope.flow_bands(edges).collect()}
    assert bands[("a", "c")] == (3, 0) and bands[("a", "b")] == (0, 0)
    bars = ET.fromstring(charts.bars(edges, "target", "value"))
    widths = [float(x.get("width")) for x in bars if x.tag.endswith("rect")]
    assert widths == sorted(widths, reverse=True) and len(widths) == 4
    with pytest.raises(ValueError):
        charts.bars(spark.range(60).withColumn("n", F.lit(1)), "id", "n")
    assert "<svg" in charts.flows(edges.limit(0)) and "<svg" in charts.bars(edges.limit(0), "target", "value")


def test_approximate_quartiles(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in [*range(1, 100), 1000]] + [("a", None)], "g string, v double")
    got = [r.v for r in clean_jobs.outliers_to_median(rows, "v", "g", accuracy=1000).collect()]
    assert max(got) == 99.0 and None not in got


def test_metadata_and_reuse(spark):
    meta = spark.createDataFrame([("k", "D", " "), ("k", "C", None), (None, "x", "x")], "id string, department string, faculty string")
    rows = spark.createDataFrame([(" k ", "own", "own"), ("z", "own", None), (None, "a", "b")], "id string, department string, faculty string")
    assert [tuple(r) for r in scope.with_metadata(rows, meta, "id", "department", "faculty").collect()] == [(" k ", "D", "own"), ("z", "own", None), (None, "a", "b")]
    course = spark.createDataFrame([("c", None)], "code string, title string")
    saved = spark.createDataFrame([("c", None, ["x"]), ("c", None, ["a"])], "code string, title string, skills_embedding array<string>")
    assert clean_courses.reuse_skills(course, [saved.drop("title"), saved], keys=("code", "title")).first().skills_embedding == ["a"]
    assert clean_courses.reuse_skills(course, [], keys=("code", "title")).first().skills_embedding is None


def test_cleaning_runs_whole(spark, tmp_path):
    """The pipeline of postings from nested rows to frequent skills, and its kept table."""
    skills = [["Excel Skills", "SQL", "Team Player", "communication skills"], ["sql", "excel", "Effective Communication"], ["SQL", "Excel", "communications"], ["welding"]]
    made = [(str(i), f"Clerk {i}", "a description of ten words or more for the clerk " * 2, 1, s, ["Permanent", "Full Time"], [], ["11111"][0], 3000.0 + i, 4000.0, 1) for i, s in enumerate(skills)]
    jobs = spark.createDataFrame(made, "uuid string, title string, description string, minimum_years_experience int, skills array<string>, employment_types array<string>, flexible_work_arrangements array<string>, ssoc_code string, salary_minimum double, salary_maximum double, number_of_vacancies int")
    got = {r.uuid: (sorted(r.skills_clean), r.num_skills, r.work_type) for r in clean_jobs.clean(jobs).collect()}
    assert got == {str(i): (["communication", "excel", "sql"], 3, "Full Time") for i in range(3)}
    assert shared.kept(jobs).count() == 4
