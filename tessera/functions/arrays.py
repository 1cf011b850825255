"""Array functions, Column to Column."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import values
from tessera.functions.text import col

Array = Column | str


def sorted_set(x: Array) -> Column:
    return F.array_sort(F.array_distinct(F.filter(col(x), lambda v: v.isNotNull() & (v != ""))))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def first_by_key(*arrays: Array) -> Column:
    """All values of the arrays in order; of those equal but for case and blanks the first stays."""
    flat = F.filter(F.flatten(F.array(*[F.coalesce(col(a), F.array().cast("array<string>")) for a in arrays])), lambda v: v.isNotNull() & (F.trim(v) != ""))

    def first(values: Column, keys: Column) -> Column:
        return F.transform(F.filter(values, lambda v, i: F.array_position(keys, F.get(keys, i)) == i + 1), lambda v: F.trim(v))

    return once(flat, lambda values: once(F.transform(values, lambda v: F.lower(F.trim(v))), lambda keys: first(values, keys)))


def named_values(items: Array, *keys: str) -> Column:
    """The first non-blank of ``keys`` of each struct, trimmed; blanks are left out."""
    return F.filter(F.transform(col(items), lambda x: F.trim(F.coalesce(*[F.nullif(F.trim(x[k]), F.lit("")) for k in keys]))), lambda v: v.isNotNull() & (v != ""))


def by_priority(x: Array, order: Sequence[str], default: str | None = "Unknown") -> Column:
    """The first of ``order`` that the array has."""
    return F.coalesce(F.get(F.filter(F.lit(list(order)), lambda p: F.array_contains(col(x), p)), F.lit(0)), F.lit(default))


def by_position(x: Array, allowed: Sequence[str], default: str | None = "Unknown") -> Column:
    """The array's first value that is allowed."""
    return F.coalesce(F.get(F.filter(col(x), lambda v: v.isin(*allowed)), F.lit(0)), F.lit(default))


def mapped_first(x: Array, names: Mapping[str, str]) -> Column:
    """Codes to names; the first that has one."""
    table = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return F.get(F.filter(F.transform(col(x), lambda c: F.try_element_at(table, F.upper(F.trim(c)))), lambda v: v.isNotNull()), F.lit(0))


def split_members(x: Array, members: Sequence[str]) -> tuple[Column, Column]:
    """(values in ``members``, the others)."""
    inside = lambda v: F.array_contains(F.lit(list(members)), v)
    return F.filter(col(x), inside), F.filter(col(x), lambda v: ~inside(v))


def split_hints(x: Array, hints: Sequence[str] = values.SOFT_HINTS, words: Sequence[str] = values.SOFT_WORDS) -> tuple[Column, Column]:
    """(values that hold one of ``hints`` or are one of ``words``, the others), each without repeats
    whatever their case."""
    hit = lambda v: F.exists(F.lit(list(hints)), lambda h: F.contains(F.lower(v), h)) | F.lower(v).isin(*words)
    return first_by_key(F.filter(col(x), hit)), first_by_key(F.filter(col(x), lambda v: ~hit(v)))


def kept_skills(skills: Array, text: Array) -> Column:
    """Of ``array<struct<skill, isKeySkill>>`` the skills that the text names, that are key, or that
    have two words or more."""
    lowered = F.lower(col(text))
    keep = F.filter(col(skills), lambda s: F.contains(lowered, F.lower(s["skill"])) | F.coalesce(s["isKeySkill"], F.lit(False)) | (F.size(F.split(F.trim(s["skill"]), "\\s+")) >= 2))
    return F.transform(keep, lambda s: s["skill"])


def as_list(x: Array) -> Column:
    """One value as a list of it, trimmed; null and blank as an empty list."""
    v = F.trim(col(x).cast("string"))
    return F.when(v.isNull() | (v == ""), F.array().cast("array<string>")).otherwise(F.array(v))


def list_cell(x: Array) -> Column:
    """A cell that holds a list literal, or else one value, as an array."""
    text = F.trim(col(x))
    parsed = F.from_json(F.regexp_replace(text, "'", '"'), "array<string>")
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.coalesce(F.when(text.startswith("["), parsed), F.array(text)))


def dot(a: Array, b: Array) -> Column:
    """Inner product of two vectors, in doubles."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(x: Array) -> Column:
    """The vector over its length; a null vector gives itself."""
    n = F.sqrt(dot(x, x))
    return F.transform(col(x), lambda v: F.when(n > 0, v.cast("double") / n).otherwise(v.cast("double")))
