"""Tables for human review, and comparison of two runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import values
from tessera.functions.text import col, shortened


def domain(x: Column | str, buckets: Mapping[str, Sequence[str]] = values.DOMAINS, default: str = "other") -> Column:
    """The first bucket of which a keyword is in the text."""
    t = F.lower(F.coalesce(col(x), F.lit("")))
    out = F.when(F.lit(False), "")
    for name, words in buckets.items():
        out = out.when(F.exists(F.lit(list(words)), lambda w: F.contains(t, w)), name)
    return out.otherwise(default)


def match_summary(matches: DataFrame, key: str, n: int = 3) -> DataFrame:
    """(key, matches): a row's n best matches as one text, code, title and score of each."""
    shown = F.concat("code", F.lit(" "), "title", F.lit(" ("), F.col("score").cast("string"), F.lit(")"))
    lists = matches.where(F.col("rank") <= n).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", shown.alias("s")))).alias("m"))
    return lists.select(key, F.array_join(F.transform("m", lambda m: m["s"]), " | ").alias("matches"))


def side_by_side(rows: DataFrame, key: str, sources: Mapping[str, DataFrame], skills: str = "skills", description: str = "description") -> DataFrame:
    """Rows with the skills of each source beside each other (empty where it has none), a snippet, and
    blank review columns."""
    out = rows.withColumn("description_snippet", shortened(description))
    for name, source in sources.items():
        out = out.join(source.select(F.col(key).alias("_k"), F.col(skills).alias(f"{name}_skills")), F.col(key) == F.col("_k"), "left").drop("_k")
        out = out.withColumn(f"{name}_skills", F.coalesce(f"{name}_skills", F.array().cast("array<string>")))
    return out.withColumns({c: F.lit("") for c in ("review_skills", "review_notes")})


def compare(one: DataFrame, two: DataFrame) -> DataFrame:
    """(measure, first, second, change) of two one-row summaries."""
    names = [c for c in one.columns if c in two.columns]
    long = lambda d, n: d.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias(n)) for c in names])))
    return long(one, "first").join(long(two, "second"), "measure").withColumn("change", F.round(F.col("second") - F.col("first"), 4))
