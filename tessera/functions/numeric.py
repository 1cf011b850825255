"""Numbers from text and guarded arithmetic, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import col

Number = Column | str


def money(x: Number) -> Column:
    """``5k``, ``$4,500`` and ``3.5k`` as whole numbers; null where there is no number."""
    t = F.trim(F.regexp_replace(F.lower(col(x)), "[,$]", ""))
    n = F.regexp_replace(t, "k$", "").try_cast("double")
    return (n * F.when(t.endswith("k"), 1000).otherwise(1)).cast("long")


def number(x: Number) -> Column:
    return col(x).try_cast("double")


def mean_of(*values: Number) -> Column:
    """Mean of the values that are not null; null if all are."""
    n = sum((F.when(col(v).isNotNull(), 1).otherwise(0) for v in values[1:]), F.when(col(values[0]).isNotNull(), 1).otherwise(0))
    total = sum((F.coalesce(col(v), F.lit(0.0)) for v in values[1:]), F.coalesce(col(values[0]), F.lit(0.0)))
    return total / F.nullif(n, F.lit(0))


def clamp(x: Number) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(x)))


def ratio(a: Number, b: Number) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def hourly_to_weekly(low: Number, high: Number) -> tuple[Column, Column]:
    """If either bound is below 100 both are hourly: low x 30, high x 60."""
    small = F.coalesce((col(low) < 100) | (col(high) < 100), F.lit(False))
    return F.when(small, col(low) * 30).otherwise(col(low)), F.when(small, col(high) * 60).otherwise(col(high))


def flag(x: Number) -> Column:
    """0 or 1 from booleans, numbers and words; null is 0."""
    t = F.lower(F.trim(col(x).cast("string")))
    return F.when(t.isin("true", "yes", "y", "t"), 1).otherwise(F.coalesce(F.when(t.try_cast("double") != 0, 1), F.lit(0))).cast("int")


def specificity(freq: Number, phrase: Number) -> Column:
    return col(freq) * (1 + F.log1p(F.size(F.split(F.trim(col(phrase)), "\\s+"))))


def experience_bucket(years: Number) -> Column:
    y = col(years)
    return F.when(y.isNull(), "unknown").when(y <= 1, "0-1").when(y <= 2, "1-2").otherwise("2+")


def occupation_code(x: Number, digits: int = 5) -> Column:
    """The first ``digits`` of a code's digits; null if it has fewer than five."""
    t = F.regexp_replace(F.regexp_replace(col(x).cast("string"), "\\.0+$", ""), "[^0-9]", "")
    return F.when(F.length(t) >= 5, F.left(t, F.lit(digits)))
