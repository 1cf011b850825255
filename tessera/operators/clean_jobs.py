"""Cleaning of job postings: filters, salaries, work types, skills, job score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.arrays import by_position, by_priority, sorted_set
from tessera.functions.fuzzy import near_distinct
from tessera.functions.numeric import hourly_to_weekly, mean_of
from tessera.operators.quantiles import quantiles

# What marks internships and postgraduate posts, and the types of contract and work.
INTERN = "\\bintern(?:ship)?s?\\b"
POSTGRADUATE_TITLE = "\\b(?:postdoc(?:toral)?|research fellow|senior research fellow|assistant professor|associate professor|professor|lecturer|medical doctor)\\b"
POSTGRADUATE_NEED = "(?:require(?:ment|s|d)?|minimum|preferred|qualification|qualifications|possess|holding|hold|must have|with|degree in).{0,120}\\b(?:ph\\.?d|doctor(?:al|ate)|master(?:'s)? degree|masters degree|master degree|postgraduate|graduate diploma|graduate certificate)\\b"
CONTRACTS = ("Permanent", "Contract", "Temporary", "Freelance")
WORK = ("Full Time", "Part Time")


def filters(title: str = "title", description: str = "description", years: str = "minimum_years_experience", types: str | None = "employment_types", least_words: int = 10) -> dict[str, Column]:
    """The filters in order, by name; each is never null."""
    t, d = F.lower(title), F.lower(description)
    intern = t.rlike(INTERN) | d.rlike(INTERN)
    if types:
        intern = intern | F.coalesce(F.exists(types, lambda x: F.contains(F.lower(x), F.lit("intern"))), F.lit(False))
    return {
        "experience": F.coalesce(F.col(years).isin(0, 1), F.lit(False)),
        "description": F.col(title).isNotNull() & F.col(description).isNotNull() & (text.n_words(d) >= least_words),
        "undergraduate": ~F.coalesce(intern | t.rlike(POSTGRADUATE_TITLE) | d.rlike(POSTGRADUATE_NEED), F.lit(False)),
    }


def attrition(rows: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """One row: how many rows are left after each step, counted in one pass."""
    passed, out = F.lit(True), [F.count("*").alias("raw")]
    for name, step in steps.items():
        passed = passed & step
        out.append(F.count_if(passed).alias(f"after_{name}"))
    return rows.agg(*out)


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def types_of_work(jobs: DataFrame, types: str = "employment_types") -> DataFrame:
    """contract_type by priority and work_type by position; permanent posts of unknown work type are
    full time; rows with neither known go."""
    out = jobs.withColumn("contract_type", by_priority(types, CONTRACTS)).withColumn("work_type", by_position(types, WORK))
    out = out.where(~((F.col("contract_type") == "Unknown") & (F.col("work_type") == "Unknown")))
    return out.withColumn("work_type", F.when((F.col("work_type") == "Unknown") & (F.col("contract_type") == "Permanent"), "Full Time").otherwise(F.col("work_type")))


def scaled_salaries(jobs: DataFrame, low: str = "salary_minimum", high: str = "salary_maximum") -> DataFrame:
    """Hourly pay scaled, then rows with a bound still below 10 (zeros) dropped."""
    a, b = hourly_to_weekly(low, high)
    out = jobs.withColumns({low: a, high: b})
    return out.where(~F.coalesce((F.col(low) < 10) | (F.col(high) < 10), F.lit(False)))


def outliers_to_median(rows: DataFrame, value: str, group: str, least_rows: int = 10, reach: float = 1.5, accuracy: int | None = None) -> DataFrame:
    """In groups of ``least_rows`` or more, values outside the quartiles by ``reach`` ranges become the
    group's median, and so do nulls.  Quartiles are computed once per group and joined back rather than
    over every row's window.  They are exact and no task holds a large group (``quantiles``); with
    ``accuracy`` they are approximate, from sketches of bounded size."""
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"), *([] if accuracy is None else [F.percentile_approx(value, [0.25, 0.5, 0.75], accuracy).alias("q")]))
    if accuracy is None:
        found = quantiles(rows, group, value, (0.25, 0.5, 0.75)).select("g", "q")
        sizes = sizes.join(found, F.col("_g").eqNullSafe(F.col("g")), "left")
    stats = sizes.select("_g", "_n", F.get("q", F.lit(0)).alias("_q1"), F.get("q", F.lit(1)).alias("_m"), F.get("q", F.lit(2)).alias("_q3"))
    both = rows.join(stats, F.col(group).eqNullSafe(F.col("_g")))
    span = (F.col("_q3") - F.col("_q1")) * reach
    inside = F.coalesce(F.col(value).between(F.col("_q1") - span, F.col("_q3") + span), F.lit(False))
    fixed = F.when((F.col("_n") >= least_rows) & F.col(group).isNotNull() & ~inside, F.col("_m")).otherwise(F.col(value))
    return both.select(*[fixed.alias(c) if c == value else F.col(c) for c in rows.columns])


def impute_work_type(rows: DataFrame, work: str, pay: str, group: str) -> DataFrame:
    """Unknown work types: the group's most frequent known one (the least of equals), else full or
    part time by pay against the middle of the two medians, else unknown."""
    known = rows.where(F.col(work) != "Unknown")
    modes = known.groupBy(F.col(group).alias("_g")).agg(F.mode(work, True).alias("_mode"))
    median = lambda part: quantiles(part, None, pay, (0.5,)).agg(F.max(F.get("q", F.lit(0))).alias("m"))
    full, part, every = (median(x).withColumnRenamed("m", name) for x, name in ((known.where(F.col(work) == "Full Time"), "ft"), (known.where(F.col(work) == "Part Time"), "pt"), (rows, "all")))
    cut = full.crossJoin(part).crossJoin(every).select(F.coalesce((F.col("ft") + F.col("pt")) / 2, "all").alias("_cut"))
    guess = F.coalesce("_mode", F.when(F.col(pay) >= F.col("_cut"), "Full Time").when(F.col(pay) < F.col("_cut"), "Part Time"), F.lit("Unknown"))
    both = rows.join(modes, F.col(group) == F.col("_g"), "left").crossJoin(F.broadcast(cut))
    return both.select(*[F.when(F.col(work) == "Unknown", guess).otherwise(F.col(work)).alias(c) if c == work else F.col(c) for c in rows.columns])


def job_score(rows: DataFrame, pay: str = "avg_salary", flexible: str = "has_flexible_work", permanent: str = "is_permanent_fulltime", vacancies: str = "number_of_vacancies", quantile: float = 0.7, weights: Sequence[float] = (0.6, 0.15, 0.15, 0.1)) -> DataFrame:
    """job_score, its min-max normal form, and is_good_job: 1 from the ``quantile`` of the scores on.
    The terms are not normalised first, so pay outweighs the rest."""
    score = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in zip((flexible, permanent, vacancies), weights[1:])), F.col(pay) * weights[0])
    out = rows.withColumn("job_score", score)
    at = quantiles(out, None, "job_score", (quantile,)).agg(F.max(F.get("q", F.lit(0))).alias("_q"))
    span = out.agg(F.min("job_score").alias("_lo"), F.max("job_score").alias("_hi")).crossJoin(at)
    both = out.crossJoin(F.broadcast(span))
    normal = (F.col("job_score") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return both.withColumn("job_score_normal", normal).withColumn("is_good_job", F.coalesce((F.col("job_score") >= F.col("_q")).cast("int"), F.lit(0))).drop("_lo", "_hi", "_q")


def clean_skills(jobs: DataFrame, skills: str = "skills") -> DataFrame:
    """skills_clean: keyed, sorted, distinct, and without near-duplicates."""
    keyed = sorted_set(F.transform(skills, lambda s: text.job_skill(s)))
    return jobs.withColumn("skills_clean", near_distinct(F.coalesce(keyed, F.array().cast("array<string>"))))


def frequent_skills(rows: DataFrame, key: str, skills: str = "skills_clean", least_count: int = 3, least_skills: int = 3) -> DataFrame:
    """Rows with the skills that occur ``least_count`` times in the corpus; rows left with fewer than
    ``least_skills`` go.  Lists keep their order."""
    each = rows.select(key, F.posexplode(skills).alias("_pos", "_skill"))
    often = each.groupBy("_skill").agg(F.count("*").alias("_c")).where(F.col("_c") >= least_count).select("_skill")
    kept = each.join(often, "_skill", "left_semi").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_skill"))), lambda s: s["_skill"]).alias("_kept"))
    kept = kept.where(F.size("_kept") >= least_skills)
    out = rows.join(kept, key)
    return out.select(*[F.col("_kept").alias(c) if c == skills else F.col(c) for c in rows.columns], F.size("_kept").alias("num_skills"))


def clean(jobs: DataFrame) -> DataFrame:
    """The whole cleaning of flattened postings (``sources.jobs.flatten``), up to score and skills."""
    steps = filters()
    out = jobs.where(steps["experience"] & steps["description"] & steps["undergraduate"])
    out = first_of(out, ["title", "description"], ["uuid"])
    out = out.withColumn("has_flexible_work", F.coalesce(F.size("flexible_work_arrangements") > 0, F.lit(False))).withColumn("ssoc_3d", F.left("ssoc_code", F.lit(3)))
    out = scaled_salaries(types_of_work(out))
    for bound in ("salary_minimum", "salary_maximum"):
        out = outliers_to_median(out, bound, "ssoc_3d")
    out = out.withColumn("avg_salary", mean_of("salary_minimum", "salary_maximum"))
    out = impute_work_type(out, "work_type", "avg_salary", "ssoc_3d")
    out = out.withColumn("is_permanent_fulltime", ((F.col("contract_type") == "Permanent") & (F.col("work_type") == "Full Time")).cast("int"))
    return frequent_skills(clean_skills(job_score(out)), "uuid")
