"""The three pipelines as functions of DataFrames: one logical plan each, nothing collected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import align, benchmark, enrich, mapping
from tessera.operators.embed import Embedder


@dataclass
class Result:
    matches: DataFrame
    metrics: DataFrame
    summary: DataFrame
    departments: DataFrame


def alignment(modules: DataFrame, jobs: DataFrame, titles: DataFrame, framework: mapping.Framework, level: str = "3d", embedder: Embedder | None = None, threshold: float = 0.72, exclusion: str = "documented", denominator: str = "all", k: int = 10, n: int = 5) -> Result:
    """Jobs get their occupations, both sides' skills become canonical (each distinct phrase mapped
    once), and every module is matched with the families of ``level``."""
    spark = modules.sparkSession
    skills, aliases, excluded = framework.tables(spark)
    jobs = enrich.with_occupation(jobs, titles)
    phrases = modules.select(F.explode("skills").alias("phrase")).unionAll(jobs.select(F.explode("skills").alias("phrase")))
    mapped = mapping.map_phrases(phrases, skills, aliases, excluded, exclusion=exclusion, embedder=embedder, threshold=threshold)
    modules, jobs = mapping.map_lists(modules, mapped), mapping.map_lists(jobs, mapped)
    families, theirs = align.family_profiles(jobs, f"ssoc_{level}_code", f"ssoc_{level}_title", skills="canonical_skills")
    modules = modules.withColumnRenamed("id", "module_id")
    matches = align.top_matches(modules, align.module_skills(modules, skills="canonical_skills"), families, theirs, k=k, n=n)
    metrics = align.module_metrics(modules, matches)
    return Result(matches, metrics, align.summary(metrics, families, "canonical_skills", denominator), align.department_summary(metrics, "source", "department", skills="canonical_skills"))


def comparison(baseline: Result, experiment: Result) -> DataFrame:
    """The measures of two runs over the same jobs beside each other."""
    return benchmark.compare(baseline.summary, experiment.summary)
