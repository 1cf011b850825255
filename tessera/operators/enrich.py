"""Occupation hierarchy and family statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import occupation_code, ratio


def with_occupation(jobs: DataFrame, titles: DataFrame, code: str = "ssoc_code", good: str = "is_good_job") -> DataFrame:
    """Codes and titles at 5, 4 and 3 digits; rows whose 3-digit title is unknown go.  The family's
    jobs, good jobs and good share (4 places) are counted once per family and broadcast, so a family of a
    third of all jobs is no single task."""
    coded = jobs.withColumns({f"ssoc_{digits}d_code": occupation_code(code, digits) for digits in (3, 4, 5)})
    family = coded.groupBy(F.col("ssoc_3d_code").alias("_f")).agg(F.count("*").alias("ssoc_3d_total_jobs"), F.sum(good).cast("long").alias("ssoc_3d_good_jobs"))
    family = family.withColumn("ssoc_3d_good_job_pct", F.round(ratio("ssoc_3d_good_jobs", "ssoc_3d_total_jobs"), 4))
    # three digits make a thousand families at most; they are counted before titles are joined, and meet them first
    named = family.join(titles.select(F.col("code").alias("_f"), F.col("title").alias("ssoc_3d_title")), "_f")
    out = coded.join(F.broadcast(named), F.col("ssoc_3d_code") == F.col("_f")).drop("_f")
    for digits in (4, 5):
        name = f"ssoc_{digits}d"
        dim = titles.select(F.col("code").alias(f"{name}_code"), F.col("title").alias(f"{name}_title"))
        out = out.join(dim, f"{name}_code", "left").withColumn(f"{name}_title", F.coalesce(f"{name}_title", F.lit("")))
    return out


def hierarchy_counts(jobs: DataFrame) -> DataFrame:
    """Jobs at every level of the hierarchy at once."""
    return jobs.rollup("ssoc_3d_code", "ssoc_4d_code", "ssoc_5d_code").agg(F.count("*").alias("jobs"))
