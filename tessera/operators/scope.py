"""Which modules belong to a scope: metadata, then vectors, then keywords."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import values
from tessera.functions import text
from tessera.functions.arrays import dot
from tessera.operators.embed import Embedder


def _hits(t: Column, patterns: Sequence[str]) -> Column:
    return sum((text.finds(t, p).cast("int") for p in patterns[1:]), text.finds(t, patterns[0]).cast("int")) if patterns else F.lit(0)


def _any(t: Column, patterns: Sequence[str]) -> Column:
    return text.finds(t, *patterns) if patterns else F.lit(False)


def keyword_signal(x: Column | str, strong: Sequence[str] = values.STEM_STRONG, weak: Sequence[str] = values.STEM_WEAK, blocked: Sequence[str] = values.STEM_BLOCKED) -> Column:
    """2 for each strong pattern, 1 for each weak one, 0 if a blocked one is there."""
    t = F.lower(F.coalesce(text.col(x), F.lit("")))
    return F.when(_any(t, blocked), 0).otherwise(_hits(t, strong) * 2 + _hits(t, weak))


def keyword_stem(x: Column | str, least: int = 2, strong: Sequence[str] = values.STEM_STRONG, weak: Sequence[str] = values.STEM_WEAK, blocked: Sequence[str] = values.STEM_BLOCKED, against: Sequence[str] = values.STEM_AGAINST) -> Column:
    """Whether the signal reaches ``least``; with one strong hit at most a context against vetoes it."""
    t = F.lower(F.coalesce(text.col(x), F.lit("")))
    return (keyword_signal(x, strong, weak, blocked) >= least) & ~((_hits(t, strong) <= 1) & _any(t, against))


def reference_lists(rows: DataFrame, column: str, stem: Sequence[str], other: Sequence[str] = (), with_other: bool = False) -> DataFrame:
    """(value, bucket): the distinct values of a string or list column against curated sets.  Values in
    neither are mixed, and so are those listed against unless ``with_other``."""
    values = rows.select(F.explode(column) if rows.schema[column].dataType.typeName() == "array" else F.col(column)).toDF("value")
    return values.where(F.col("value").isNotNull() & (F.trim("value") != "")).distinct().select("value", bucket("value", stem, other if with_other else ()).alias("bucket"))


def university_lists(courses: DataFrame, lists: Sequence[tuple] = values.SCOPE_LISTS, university: str = "university") -> DataFrame:
    """(university, field, value, bucket): the distinct faculties and departments of each university's
    courses, by the curated lists.  Each list tells the bucket of the values that it names and of those
    that it does not; fields may be strings or lists; blanks and nulls are no values."""
    parts = None
    for name, field, rest, named, names in lists:
        rows = courses.where(F.upper(F.trim(F.col(university))) == name.upper())
        found = rows.select(F.explode(field) if rows.schema[field].dataType.typeName() == "array" else F.col(field)).toDF("value").select(F.trim("value").alias("value"))
        inside = F.col("value").isin(*names) if names else F.lit(False)
        part = found.where("value is not null and value <> ''").distinct().select(F.lit(name).alias("university"), F.lit(field).alias("field"), "value", F.when(inside, named).otherwise(rest).alias("bucket"))
        parts = part if parts is None else parts.unionAll(part)
    return parts


def metadata_bucket(university: Column | str, department: Column | str, faculty: Column | str, lists: Sequence[tuple] = values.SCOPE_LISTS) -> Column:
    """The bucket of a course by its university's lists: its department's where the lists say something
    of it, else its faculty's; clear_stem of either wins; a missing value says nothing."""
    u = F.upper(F.trim(text.col(university)))
    said = {"department": F.trim(text.col(department)), "faculty": F.trim(text.col(faculty))}
    stem = F.lit(False)
    for name, field, rest, named, names in lists:
        value = said[field]
        inside = value.isin(*names) if names else F.lit(False)
        hit = F.when(inside, F.lit(named)).otherwise(F.lit(rest)) == "clear_stem"
        stem = stem | F.coalesce((u == name.upper()) & (value != "") & hit, F.lit(False))
    return F.when(stem, "clear_stem").otherwise("unclear_or_mixed")


def prototype_margin(rows: DataFrame, body: str, embedder: Embedder, one: Sequence[str] = values.STEM_SENTENCES, other: Sequence[str] = values.OTHER_SENTENCES) -> DataFrame:
    """``rows`` with stem_similarity, non_stem_similarity and margin: a text's vector against the mean
    vectors, of unit length, of the sentences for the scope and against it.  A null text is empty."""
    def centre(sentences: Sequence[str]) -> np.ndarray:
        mean = np.asarray(embedder(list(sentences)), np.float64).mean(axis=0)
        return mean / (np.linalg.norm(mean) or 1.0)

    centres = np.stack([centre(one), centre(other)], axis=1)

    @F.arrow_udf("struct<one: double, other: double>")
    def near(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), 2))
        for low in range(0, len(texts), 1024):
            out[low : low + 1024] = np.asarray(embedder([x or "" for x in texts.slice(low, 1024).to_pylist()]), np.float64) @ centres
        return pa.StructArray.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["one", "other"])

    both = rows.withColumn("_near", near(F.col(body)))
    return both.withColumns({"stem_similarity": F.col("_near.one"), "non_stem_similarity": F.col("_near.other"), "margin": F.col("_near.one") - F.col("_near.other")}).drop("_near")


def earlier_cascade(
    base: Column | str,
    base_reason: Column | str,
    department: Column | str,
    body: Column | str,
    least: int = 3,
    strong: Sequence[str] = values.EARLIER_STRONG,
    weak: Sequence[str] = values.EARLIER_WEAK,
    blocked: Sequence[str] = values.STEM_BLOCKED,
    excluded: Sequence[tuple[str, str]] = values.EXCLUDED_MODULES,
    stem: Sequence[str] = values.STEM_DEPARTMENTS,
    other: Sequence[str] = values.OTHER_DEPARTMENTS,
) -> tuple[Column, Column]:
    """(bucket, reason) of the classifier without vectors: exclusions first, metadata, department words
    where metadata says nothing, then ``quant_non_stem`` for texts outside the scope whose keyword
    signal reaches ``least``.  ``department`` may be department and faculty together; exclusions look at
    it and at the text.  Its keep rule is clear_stem or quant_non_stem."""
    base, why = text.col(base), text.col(base_reason)
    t, d = F.lower(F.coalesce(text.col(body), F.lit(""))), F.lower(F.coalesce(text.col(department), F.lit("")))
    open_ = base == "unclear_or_mixed"
    is_stem, is_other = open_ & _any(d, stem), open_ & _any(d, other)
    first = F.when(is_stem, "clear_stem").when(is_other, "clear_non_stem").otherwise(base)
    reason = F.when(is_stem, "department_text_heuristic_stem").when(is_other, "department_text_heuristic_non_stem").otherwise(why)
    quant = (first != "clear_stem") & (keyword_signal(body, strong, weak, blocked) >= least)
    note = F.when(first == "clear_non_stem", "quant_semantic_override_non_stem").otherwise("quant_semantic_override_unclear")
    whole, out, left_out = F.concat_ws(" ", t, d), F.lit(False), F.lit(None).cast("string")
    for name, pattern in reversed(excluded):
        hit = text.finds(whole, pattern)
        out, left_out = out | hit, F.when(hit, name).otherwise(left_out)
    return F.when(out, "clear_non_stem").when(quant, "quant_non_stem").otherwise(first), F.when(out, left_out).when(quant, note).otherwise(reason)


def with_metadata(rows: DataFrame, metadata: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows whose ``columns`` come from the metadata of their key, or where that has none, or only
    blanks, from the row itself.  Metadata that repeat a key: the last in the order of the values."""
    at = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    known = metadata.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_m")).agg(*[F.max(at(c)).alias(f"_{c}") for c in columns])
    both = rows.join(known, F.trim(F.col(key)) == F.col("_m"), "left")
    return both.select(*[F.coalesce(f"_{c}", F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


@dataclass(frozen=True)
class Limits:
    keep: float = 0.02
    take: float = 0.06
    vote: float = 0.04
    votes: int = 1


def sentence_votes(sentences: DataFrame, key: str, one: str, other: str, limit: float = 0.04) -> DataFrame:
    """Votes of a text's sentences from their similarities to the two centroids."""
    m = F.col(one) - F.col(other)
    up, down = F.count_if(m >= limit), F.count_if(m <= -limit)
    return sentences.groupBy(key).agg(up.alias("support_count"), down.alias("oppose_count"), F.count("*").alias("total_sentences"), F.round(F.avg(m), 6).alias("avg_margin"), F.round(F.max(one), 6).alias("max_stem_similarity"), F.round(up / (up + down + F.lit(1e-9)), 6).alias("confidence"))


def document_margin(rows: DataFrame, vector: str, centroids: DataFrame, label: str, one: object, other: object) -> DataFrame:
    """Similarities to the centroids of the two labels and their difference."""
    pick = lambda v, name: F.first(F.when(F.col(label) == v, F.col("centroid")), ignorenulls=True).alias(name)
    pair = centroids.agg(pick(one, "_one"), pick(other, "_other"))
    both = rows.crossJoin(F.broadcast(pair))
    return both.withColumn("stem_similarity", dot(vector, "_one")).withColumn("non_stem_similarity", dot(vector, "_other")).withColumn("margin", F.col("stem_similarity") - F.col("non_stem_similarity")).drop("_one", "_other")


def bucket(value: Column | str, stem: Sequence[str], other: Sequence[str]) -> Column:
    """The bucket that metadata alone gives: listed, listed against, or neither."""
    v = text.col(value)
    inside = lambda names: v.isin(*names) if names else F.lit(False)
    return F.when(inside(stem), "clear_stem").when(inside(other), "clear_non_stem").otherwise("unclear_or_mixed")


def cascade(base: Column | str, base_reason: Column | str, margin: Column | str, votes: Column | str, keyword: Column | str, limits: Limits = Limits()) -> tuple[Column, Column]:
    """(bucket, reason): metadata, then the text's margin both ways, then votes, then keywords."""
    base, why, m, v, k = (text.col(c) for c in (base, base_reason, margin, votes, keyword))
    reason = (
        F.when(base == "clear_stem", why)
        .when(m <= -limits.keep, "paragraph_semantic_non_stem_guard")
        .when(m >= limits.take, "paragraph_semantic_stem_override")
        .when((m >= 0) & (v >= limits.votes), "stem_semantic_sentence_override")
        .when(k, "stem_keyword_override")
        .otherwise(why)
    )
    taken = reason.isin("paragraph_semantic_stem_override", "stem_semantic_sentence_override", "stem_keyword_override")
    return F.when(taken, "clear_stem").otherwise(base), reason


def with_costly(rows: DataFrame, cheap: Column, costly) -> DataFrame:
    """Applies ``costly`` (DataFrame to DataFrame) only to the rows for which ``cheap`` does not hold:
    functions inside a ``when`` may be evaluated for every row."""
    hard = F.coalesce(cheap, F.lit(False))
    return rows.where(hard).unionByName(costly(rows.where(~hard)), allowMissingColumns=True)


def path(bucket: Column | str, reason: Column | str) -> Column:
    """The step of the cascade that decided."""
    r = text.col(reason)
    return (
        F.when(r == "paragraph_semantic_stem_override", "paragraph_stem")
        .when(r == "paragraph_semantic_non_stem_guard", "paragraph_non_stem")
        .when(r == "stem_semantic_sentence_override", "sentence_stem")
        .when(r == "stem_keyword_override", "keyword_stem")
        .when(r.startswith("excluded_"), "excluded_non_stem")
        .when(text.col(bucket) == "clear_stem", "metadata_stem")
        .otherwise("keyword_remainder")
    )


# The flow from step to step; each edge carries the counts of the paths that take it.
_STEPS = {"metadata_stem": "Metadata clear STEM", "excluded_non_stem": "Excluded non-STEM pattern", "paragraph_stem": "Paragraph STEM override", "paragraph_non_stem": "Paragraph non-STEM guard", "sentence_stem": "Sentence STEM override", "keyword_stem": "Keyword STEM override", "keyword_remainder": "Remain non-STEM or mixed"}
_TAKEN = ("metadata_stem", "paragraph_stem", "sentence_stem", "keyword_stem")
_ROUTES = {
    "metadata_stem": ("All Modules",),
    "excluded_non_stem": ("All Modules",),
    "paragraph_stem": ("All Modules", "Enter semantic pipeline"),
    "paragraph_non_stem": ("All Modules", "Enter semantic pipeline"),
    "sentence_stem": ("All Modules", "Enter semantic pipeline", "Enter sentence stage"),
    "keyword_stem": ("All Modules", "Enter semantic pipeline", "Enter sentence stage", "Enter keyword fallback"),
    "keyword_remainder": ("All Modules", "Enter semantic pipeline", "Enter sentence stage", "Enter keyword fallback"),
}


def flow_edges(rows: DataFrame, step: str = "path") -> DataFrame:
    """(source, target, value): how many modules pass from each step to the next.  A module walks the
    whole route of its path, so every node lets out what it takes in."""
    routes = F.create_map(*[x for p, nodes in _ROUTES.items() for x in (F.lit(p), F.lit([*nodes, _STEPS[p], "Final STEM" if p in _TAKEN else "Final non-STEM"]))])
    counts = rows.groupBy(step).agg(F.count("*").alias("n"))
    route = F.element_at(routes, F.col(step))
    edges = F.transform(F.sequence(F.lit(1), F.size(route) - 1), lambda i: F.struct(F.element_at(route, i).alias("source"), F.element_at(route, i + 1).alias("target")))
    return counts.select("n", F.inline(edges)).groupBy("source", "target").agg(F.sum("n").alias("value"))


def flow_bands(edges: DataFrame) -> DataFrame:
    """Edges with where their bands begin at both nodes: the running sums of the values of a node's
    edges, by the name of the node at the other end."""
    at = lambda node, other: F.coalesce(F.sum("value").over(Window.partitionBy(node).orderBy(other).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return edges.withColumns({"source_offset": at("source", "target"), "target_offset": at("target", "source")})


def path_counts(rows: DataFrame, step: str = "path") -> DataFrame:
    """One row: modules at every step, and those that enter the later ones."""
    n = lambda *paths: F.count_if(F.col(step).isin(*paths))
    later = ("paragraph_stem", "paragraph_non_stem", "sentence_stem", "keyword_stem", "keyword_remainder")
    return rows.agg(
        F.count("*").alias("total"),
        *[n(p).alias(p) for p in _ROUTES],
        n(*later).alias("semantic_entry"),
        n(*later[2:]).alias("sentence_entry"),
        n(*later[3:]).alias("keyword_entry"),
        n(*_TAKEN).alias("final_stem"),
        (F.count("*") - n(*_TAKEN)).alias("final_non_stem"),
    )
