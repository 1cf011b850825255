"""Schemas of the datasets, and the check that a frame has the columns an operator needs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

JOB_POSTING = """uuid string, title string, description string, minimumYearsExperience int,
skills array<struct<skill: string, isKeySkill: boolean>>, employmentTypes array<struct<employmentType: string>>,
positionLevels array<struct<position: string>>,
flexibleWorkArrangements array<struct<flexibleWorkArrangement: string, arrangement: string, name: string>>,
categories array<struct<category: string>>, ssocCode string, ssocVersion string,
salary struct<minimum: double, maximum: double, type: struct<salaryType: string>>,
metadata struct<jobPostId: string, newPostingDate: string, originalPostingDate: string, expiryDate: string>,
numberOfVacancies int"""
NUS_COURSE = "moduleCode string, title string, department string, faculty string, description string"
NTU_COURSE = "code string, title string, description string, departmentMaintaining string"
SUTD_COURSE = "code string, title string, course_type string, description string, terms string, credits int, affiliations array<string>, url string, description_found boolean, error string"
OCCUPATION = "code string, title string"
MODULES = "id string, source string, code string, title string, department string, university string, description string, skills array<string>, hard_skills array<string>, soft_skills array<string>, num_skills int"
JOBS = "id string, source string, title string, description string, ssoc_code string, ssoc_3d string, contract_type string, work_type string, avg_salary double, skills array<string>, all_relevant_skills array<string>, is_freshgrad boolean, is_good_job int"
FRAMEWORK = "canonical_skill string, skill_type string, aliases array<string>, notes string"


def require_columns(df: DataFrame, columns: Iterable[str], name: str = "input") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks the columns {', '.join(missing)}")
    return df
