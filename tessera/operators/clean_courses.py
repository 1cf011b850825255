"""Course texts: cleaning and the undergraduate filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import values
from tessera.functions import text
from tessera.functions.fuzzy import html_text
from tessera.functions.serial import numbered

# Fixed value: course codes of undergraduate levels.
CODE = "^[A-Z]+[0-4]"


def undergraduate_code(code: Column | str) -> Column:
    return F.coalesce(F.upper(F.trim(text.col(code))).rlike(CODE), F.lit(False))


def undergraduate(title: Column | str = "title", description: Column | str | None = "description", course_type: Column | str | None = None) -> Column:
    """Neither title nor course type names postgraduate study, and the description does not list the
    course as a graduate's; nulls do not."""
    hit = F.lit(False)
    for x, pattern in ((title, values.POSTGRADUATE_TITLE), (description, values.POSTGRADUATE_DESCRIPTION), (course_type, values.POSTGRADUATE_TITLE)):
        if x is not None:
            hit = hit | F.coalesce(text.col(x).rlike(pattern), F.lit(False))
    return ~hit


def reuse_skills(courses: DataFrame, saved: Sequence[DataFrame], skills: str = "skills_embedding", keys: Sequence[str] = ("code", "title", "department", "description", "university")) -> DataFrame:
    """Courses with the skills saved for the same keys, from the first of ``saved`` that has all columns
    and matches any course; null where there are none.  Saved rows that repeat a key: the first by
    their skills.  Null keys are equal, as the tables hold them."""
    rows = courses.drop(skills)
    for table in saved:
        if not {*keys, skills} <= set(table.columns):
            continue
        once = table.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(skills).alias(skills))
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        found = rows.join(once, on, "left").drop(*[f"_{k}" for k in keys])
        if not found.where(F.col(skills).isNotNull()).isEmpty():
            return found
    return rows.withColumn(skills, F.lit(None).cast("array<string>"))


def cleaned(x: Column | str, html: bool = False) -> Column:
    """Spelling made American and control characters gone; with ``html`` tags and entities too."""
    t = html_text(text.col(x)) if html else text.display(x)
    return text.display(text.no_controls(text.american(t)))


def clean(courses: DataFrame, least_words: int = 10, html: bool = True) -> DataFrame:
    """description_clean, description_chunks and a serial number by university and code."""
    out = courses.where(undergraduate("title", "description", "course_type" if "course_type" in courses.columns else None)).withColumn("description_clean", cleaned("description", html))
    out = out.where(text.n_words("description_clean") >= least_words).withColumn("description_chunks", text.chunks("description_clean"))
    return numbered(out, "university", "code")


def portable_modules(courses: DataFrame, least_words: int = 10) -> DataFrame:
    """The earlier export: rows with code, source, title and words enough, each once."""
    fine = F.col("code").isNotNull() & F.col("source").isNotNull() & F.col("title").isNotNull() & (text.n_words("description") >= least_words)
    return courses.where(fine).dropDuplicates(["source", "code", "title", "description"])


def module_rows(courses: DataFrame, least_chars: int = 80) -> DataFrame:
    """The module export: id, texts and lower-cased skill lists of courses long enough."""
    lower = lambda c: F.filter(F.transform(c, lambda s: F.lower(text.display(s))), lambda s: s != "")
    out = courses.where(F.length(text.display("description")) >= least_chars)
    return out.select(F.concat_ws("::", "university", "code").alias("id"), F.col("university").alias("source"), "code", text.display("title").alias("title"), text.display("department").alias("department"), "university", text.display("description").alias("description"), *[lower(c).alias(c) for c in ("skills", "hard_skills", "soft_skills")], F.size("skills").alias("num_skills"))


def job_rows(jobs: DataFrame, least_chars: int = 80) -> DataFrame:
    """The job export; every cleaned job counts as one for fresh graduates."""
    out = jobs.where(F.length(text.display("description")) >= least_chars)
    return out.select(F.col("uuid").alias("id"), F.lit("jobs").alias("source"), text.display("title").alias("title"), text.display("description").alias("description"), "ssoc_code", "ssoc_3d", "contract_type", "work_type", "avg_salary", F.col("skills_clean").alias("skills"), F.col("skills_clean").alias("all_relevant_skills"), F.lit(True).alias("is_freshgrad"), "is_good_job")


def fresh_graduate(levels: Column | str, years: Column | str, body: Column | str, most: float = 1, texts: Sequence[str] = values.FRESH_TEXTS) -> tuple[Column, Column, Column, Column]:
    """(by one of the levels, by years, by text, conflict of any of these with three years or more)."""
    by_level = F.coalesce(F.exists(text.col(levels), lambda x: F.contains(F.lower(x), F.lit(values.FRESH_LEVEL))), F.lit(False))
    by_years = F.coalesce(text.col(years) <= most, F.lit(False))
    by_text = F.coalesce(F.lower(text.col(body)).rlike("|".join(texts)), F.lit(False))
    return by_level, by_years, by_text, (by_level | by_years | by_text) & F.coalesce(text.col(years) >= 3, F.lit(False))


def portable_jobs(jobs: DataFrame) -> DataFrame:
    """The earlier export: jobs with id and occupation, their cleaned skills or else the raw ones."""
    skills = F.coalesce("skills_clean", "skills") if "skills_clean" in jobs.columns else F.col("skills")
    return jobs.where(F.col("uuid").isNotNull() & F.col("ssoc_code").isNotNull()).select("uuid", "title", "description", "ssoc_code", skills.alias("skills"))


def fresh_only(rows: DataFrame, flag: str = "is_freshgrad") -> DataFrame:
    """Rows whose flag holds or is missing; all rows where there is no such column."""
    return rows.where(F.coalesce(F.col(flag), F.lit(True))) if flag in rows.columns else rows
