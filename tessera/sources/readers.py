"""Scans: job postings, courses of three universities, lookups, JSON with checks, and page records."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schemas, values
from tessera.functions import text
from tessera.sources import shared
from tessera.functions.arrays import mapped_first, named_values
from tessera.operators.clean_courses import undergraduate, undergraduate_code


def job_files(spark: SparkSession, path: str, pattern: str = "MCF-*.json", strict: bool = True) -> DataFrame:
    """One posting a file, in all folders below ``path``; a malformed file fails, or is left out."""
    reader = spark.read.schema(schemas.JOB_POSTING).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("multiLine", True)
    rows = reader.option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return rows.withColumn("file", F.regexp_replace(F.col("_metadata.file_name"), "\\.json$", ""))


def flatten_jobs(rows: DataFrame) -> DataFrame:
    """Nested postings to flat columns; the id falls back to the metadata's and the file's."""
    return rows.select(
        F.coalesce("uuid", "metadata.jobPostId", *(["file"] if "file" in rows.columns else [])).alias("uuid"),
        "title",
        "description",
        F.col("minimumYearsExperience").alias("minimum_years_experience"),
        named_values("skills", "skill").alias("skills"),
        named_values("employmentTypes", "employmentType").alias("employment_types"),
        named_values("positionLevels", "position").alias("position_levels"),
        named_values("flexibleWorkArrangements", "flexibleWorkArrangement", "arrangement", "name").alias("flexible_work_arrangements"),
        named_values("categories", "category").alias("categories"),
        F.col("ssocCode").alias("ssoc_code"),
        F.col("ssocVersion").alias("ssoc_version"),
        F.col("salary.minimum").alias("salary_minimum"),
        F.col("salary.maximum").alias("salary_maximum"),
        F.col("salary.type.salaryType").alias("salary_type"),
        F.coalesce("metadata.newPostingDate", "metadata.originalPostingDate").alias("posting_date"),
        F.col("metadata.expiryDate").alias("expiry_date"),
        F.col("numberOfVacancies").alias("number_of_vacancies"),
    )


def json_document(spark: SparkSession, path: str, schema: str, fetch: Callable[[], str] | None = None) -> DataFrame:
    """One JSON document, an object or an array of them, as rows.  ``fetch`` gets the document first and
    its text is kept at ``path``; where it fails, what ``path`` holds already is read."""
    if fetch is not None:
        try:
            got = fetch()
        except Exception as e:  # as a download that fails: said, and the kept copy is used
            print(f"not fetched: {e}")
        else:
            spark.createDataFrame([(got,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_rows(spark: SparkSession, path: str, schema: str, array: bool = False) -> DataFrame:
    """JSON lines, or one array; rows that are no objects of the schema are in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", array).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def saved_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A saved table: Parquet at ``path``, or where there is none the JSON lines beside it, under the same
    name with ``.jsonl``."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path.removesuffix(".parquet") + ".jsonl")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines counted from 1 in each file.  Files are read in blocks; a
    line's number is its place in its block and the lines of the blocks before, so no file is one task."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sizes.select(F.col("file").alias("f"), F.col("block").alias("b"), before.alias("before"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("id"))
    both = rows.withColumn("place", place).join(blocks, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    return both.select("file", (F.col("before") + F.col("place")).alias("line"), "value")


def checked_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of JSON lines: blank lines are skipped, and a line that is no object of ``schema``
    becomes (file, line, value) in errors.  A file that is no text, such as a pickle, errs in every line."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull() | ~F.trim("value").startswith("{")
    return parsed.where(~bad).select("line", "row.*").drop("_corrupt"), parsed.where(bad).select("file", "line", "value")


def lookup(spark: SparkSession, path: str) -> DataFrame:
    """A code table (CSV or Parquet): codes of 3 to 5 digits."""
    rows = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).schema(schemas.OCCUPATION).csv(path)
    return rows.select(F.trim(F.col("code").cast("string")).alias("code"), text.display("title").alias("title")).where(F.col("code").rlike("^[0-9]{3,5}$"))


def courses(nus: DataFrame | None = None, ntu: DataFrame | None = None, sutd: DataFrame | None = None, departments: DataFrame | None = None, pillars: dict[str, str] | None = values.PILLARS, excluded_faculties: tuple[str, ...] = (), least_words: int = 10) -> DataFrame:
    """The three course lists in one schema: undergraduate codes, texts long enough."""
    common = ["code", "title", "department", "faculty", "description", "course_type", "university"]
    parts = []
    if nus is not None:
        rows = nus.withColumnRenamed("moduleCode", "code").withColumn("university", F.lit("NUS")).where(undergraduate_code("code"))
        parts.append(rows.where(~F.coalesce(F.col("faculty").isin(*excluded_faculties), F.lit(False))) if excluded_faculties else rows)
    if ntu is not None:
        rows = ntu.where(undergraduate_code("code")).withColumn("university", F.lit("NTU"))
        if departments is not None:
            rows = rows.join(departments.select(F.col("short").alias("_s"), "department"), F.col("departmentMaintaining") == F.col("_s"), "left").drop("_s", "departmentMaintaining")
        else:
            rows = rows.withColumnRenamed("departmentMaintaining", "department")
        parts.append(rows)
    if sutd is not None:
        name = mapped_first("affiliations", pillars) if pillars else F.get("affiliations", F.lit(0))
        parts.append(sutd.withColumn("department", name).withColumn("university", F.lit("SUTD")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    for c in common:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    out = out.where((text.n_words("description") >= least_words) & undergraduate("title", "description", "course_type"))
    return out.select(*common)


def unseen(rows: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys no row of ``seen`` has."""
    return rows.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def course_blocks(lines: DataFrame, doc: str, no: str, line: str, head: str = "^([0-9]{2}\\.[0-9]{3})\\s+(.+)$") -> DataFrame:
    """Lines of a listing to course records.  A line that fits ``head`` opens a block; the line before
    it is the course type; "Term", "Credits" and tags follow."""
    by = Window.partitionBy(doc).orderBy(no)
    opened = F.col(line).rlike(head)
    rows = lines.withColumn("_open", opened).withColumn("_before", F.lag(line).over(by)).withColumn("_block", F.sum(F.col("_open").cast("int")).over(by)).where(F.col("_block") > 0)
    pick = lambda pattern, group=1: F.first(F.when(F.col(line).rlike(pattern), F.regexp_extract(line, pattern, group)), ignorenulls=True)
    return rows.groupBy(doc, "_block").agg(
        pick(head, 1).alias("code"),
        pick(head, 2).alias("title"),
        F.first(F.when(F.col("_open"), F.col("_before")), ignorenulls=True).alias("course_type"),
        pick("(?i)^terms?:?\\s*(.+)$").alias("terms"),
        pick("(?i)^credits?:?\\s*([0-9]+)").try_cast("int").alias("credits"),
    ).drop("_block")


def details(urls: DataFrame, fetch: Callable[[str], str], url: str = "url") -> DataFrame:
    """(url, body, error): pages fetched in parallel by the tasks; a failure becomes a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for u in pdf[url]:
                try:
                    rows.append((u, fetch(u), None))
                except Exception as e:  # the row says so
                    rows.append((u, None, str(e)))
            yield pd.DataFrame(rows, columns=[url, "body", "error"])

    return urls.select(url).mapInPandas(run, f"`{url}` string, body string, error string")


class _Record(HTMLParser):
    """Title, first heading, paragraphs after it up to "prerequisite", and two-cell table rows."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.heading, self.paragraphs, self.details = "", "", [], {}
        self.json: list[str] = []
        self.on: list[str] = []
        self.cells: list[str] = []
        self.buffer = ""
        self.ended = False

    def handle_starttag(self, tag, attrs):
        if tag == "script":
            tag = "json" if ("type", "application/ld+json") in attrs else tag
        if tag in ("title", "h1", "h2", "h3", "h4", "p", "td", "th", "script", "style", "json"):
            self.on.append(tag)
            self.buffer = ""
        elif tag == "tr":
            self.cells = []

    def handle_endtag(self, tag):
        words = " ".join(self.buffer.split())
        if tag == "script" and self.on and self.on[-1] == "json":
            tag = "json"
        if self.on and self.on[-1] == tag:
            self.on.pop()
            if tag == "title":
                self.title = self.title or words
            elif tag == "json":
                self.json.append(self.buffer)
            elif tag == "h1":
                self.heading = self.heading or words
            elif tag in ("h2", "h3", "h4"):
                self.ended |= "prerequisite" in words.lower()
            elif tag == "p" and words and not self.ended and not re.match(r"(?i)number of credits|tags\b", words):
                if words not in self.paragraphs:
                    self.paragraphs.append(words)
            elif tag in ("td", "th"):
                self.cells.append(words)
        elif tag == "tr" and len(self.cells) == 2 and self.cells[0] and not self.cells[0].isdigit():
            self.details[self.cells[0]] = self.cells[1]

    def handle_data(self, data):
        if self.on:
            self.buffer += data


def page_record(html: str | None) -> tuple[str, str, str, dict[str, str]]:
    """(title, heading, description, details); a JSON-LD course wins for title and description."""
    r = _Record()
    r.feed(html or "")
    r.close()
    title, description = r.title, " ".join(r.paragraphs)
    for block in r.json:
        try:
            found = json.loads(block)
        except ValueError:
            continue
        for item in found if isinstance(found, list) else [found]:
            if isinstance(item, dict) and item.get("@type") == "Course":
                title, description = item.get("name") or title, item.get("description") or description
    return title, r.heading, description, r.details


def page_records(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, title, heading, description, details) of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [page_record(x) for x in pdf[html]]
            out = pd.DataFrame(rows, columns=["title", "heading", "description", "details"])
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    kind = pages.schema[key].dataType.simpleString()
    return shared.dealt(pages.select(key, html), key).mapInPandas(run, f"`{key}` {kind}, title string, heading string, description string, details map<string,string>")


def course_url(base: str, code: str, title: str, discovered: str | None = None):
    """A link that was found, else the one that code and title make."""
    made = F.concat(F.lit(base), F.regexp_replace(F.lower(F.col(code)), "[^0-9a-z]", "-"), F.lit("-"), text.slug(title))
    return F.coalesce(F.col(discovered), made) if discovered else made
