"""The canonical skill framework: one vocabulary merged from tables of curated skills, rules, evidence,
labels and phrases that are no skills.

Every source is a table, so rules learnt from a corpus (``operators.rules``) merge like the curated ones.
Nothing is collected: the merge is one long table of (skill, alias, source) and its aggregations.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import values
from tessera.functions.text import phrase_key

#: Kinds of sources in the order in which provenance lists them.
KINDS = ("base", "rules", "evidence", "labels")


@dataclass
class Sources:
    """base: canonical_skill, skill_type, aliases, place (of several rows of a skill the last place's type
    counts).  rules: patterns, skills.  evidence: canonical_skill, phrases.  labels: canonical_skill.
    blocked: phrase."""

    base: DataFrame
    rules: DataFrame
    evidence: DataFrame
    labels: DataFrame
    blocked: DataFrame

    def and_(self, other: Sources) -> Sources:
        """Both, the other's base rows after these where places are equal."""
        return Sources(*(getattr(self, name).unionByName(getattr(other, name)) for name in ("base", "rules", "evidence", "labels", "blocked")))


def curated(spark: SparkSession) -> Sources:
    """The fixed values as tables: 18 curated skills, 70 rules, 3 strict skills, 71 labels, 24 exclusions."""
    make = spark.createDataFrame
    return Sources(
        make([(s, kind, list(aliases), i) for i, (s, kind, aliases) in enumerate(values.BASE_SKILLS)], "canonical_skill string, skill_type string, aliases array<string>, place long"),
        make([(list(p), list(s)) for p, s in values.MODULE_RULES], "patterns array<string>, skills array<string>"),
        make([(s, list(p)) for s, p in values.STRICT_EVIDENCE.items()], "canonical_skill string, phrases array<string>"),
        make([(s,) for s in values.MODULE_SKILLS], "canonical_skill string"),
        make([(p,) for p in (*values.BLOCKED_PHRASES, *values.EXCLUDED_PHRASES)], "phrase string"),
    )


def no_sources(spark: SparkSession) -> Sources:
    """Empty tables of all kinds."""
    like = curated(spark)
    return Sources(*(getattr(like, name).limit(0) for name in ("base", "rules", "evidence", "labels", "blocked")))


@dataclass
class Framework:
    """skills: canonical_skill, skill_type, n_aliases, sources.  aliases: alias, canonical_skill, sources.
    excluded: phrase."""

    skills: DataFrame
    aliases: DataFrame
    excluded: DataFrame

    def tables(self, spark: SparkSession | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.skills, self.aliases, self.excluded

    def collisions(self) -> DataFrame:
        """(alias, skills, exact, nearest, is_excluded): aliases of several skills, with the skill that an
        exact match means (the last by name) and the one that a nearest match means (the first)."""
        several = self.aliases.groupBy("alias").agg(F.array_sort(F.collect_set("canonical_skill")).alias("skills")).where(F.size("skills") > 1)
        out = several.select("alias", "skills", F.array_max("skills").alias("exact"), F.array_min("skills").alias("nearest"))
        return _marked(out, self.excluded)

    def shadowed(self) -> DataFrame:
        """(alias, canonical_skill): aliases that exclusion keeps from ever being met."""
        return _marked(self.aliases, self.excluded).where("is_excluded").select("alias", "canonical_skill")

    @functools.cached_property
    def version(self) -> str:
        """A fingerprint of what decides a mapping, whatever the order of rows: two frameworks that map alike
        by their tables have the same."""
        def part(df: DataFrame, *columns: str) -> str:
            h = F.xxhash64(*columns)
            row = df.select(*columns).distinct().agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).alias("s")).first()
            return f"{row['n']:x}-{row['x'] & (2**64 - 1):016x}-{int(row["s"]) & (2**64 - 1):016x}"

        return "_".join([part(self.skills, "canonical_skill", "skill_type"), part(self.aliases, "alias", "canonical_skill"), part(self.excluded, "phrase")])

    def kept(self, path: str) -> Framework:
        """The framework written to ``path`` and read back: what mapping runs start from."""
        for name in ("skills", "aliases", "excluded"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        return read(self.skills.sparkSession, path)


def read(spark: SparkSession, path: str) -> Framework:
    return Framework(*(spark.read.parquet(f"{path}/{name}") for name in ("skills", "aliases", "excluded")))


def _marked(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    out = excluded.select(F.col("phrase").alias("_x")).distinct()
    return rows.join(out, F.col("alias") == F.col("_x"), "left").withColumn("is_excluded", F.col("_x").isNotNull()).drop("_x")


def build(sources: Sources, types: Sequence[tuple[str, Sequence[str]]] = values.SKILL_TYPES) -> Framework:
    """The merged framework.

    Every skill is an alias of itself; a rule makes its patterns aliases of all its skills.  Aliases are
    phrase keys, each once a skill, with the kinds of sources that gave it.  A skill's type is its base
    row's, else that of the first of ``types`` that names it, else hard.  Rows without a skill are left
    out, and keys that come out empty; a skill all of whose keys are empty stays without aliases.
    """
    named = lambda df, kind, aliases, skill_type=None, place=None: df.select(
        "canonical_skill", F.lit(kind).alias("kind"), F.explode(F.array_append(aliases, F.col("canonical_skill"))).alias("alias"),
        (F.lit(None).cast("string") if skill_type is None else F.col(skill_type)).alias("given"), (F.lit(None).cast("long") if place is None else F.col(place)).alias("place"),
    )
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    rules = sources.rules.select(F.explode("skills").alias("canonical_skill"), "patterns")
    said = (
        named(sources.base, "base", listed(F.col("aliases")), "skill_type", "place")
        .unionAll(named(rules, "rules", listed(F.col("patterns"))))
        .unionAll(named(sources.evidence, "evidence", listed(F.col("phrases"))))
        .unionAll(named(sources.labels, "labels", listed(F.lit(None).cast("array<string>"))))
    )
    said = said.where(F.trim("canonical_skill") != "").withColumn("alias", phrase_key("alias"))
    in_order = lambda kinds: F.filter(F.lit(list(KINDS)), lambda k: F.array_contains(kinds, k))
    aliases = said.where("alias <> ''").groupBy("alias", "canonical_skill").agg(in_order(F.collect_set("kind")).alias("sources"))
    inferred = F.lit("hard")
    for kind, names in reversed(list(types)):
        inferred = F.when(F.col("canonical_skill").isin(*names), kind).otherwise(inferred)
    skills = said.groupBy("canonical_skill").agg(F.max_by("given", F.when(F.col("given").isNotNull(), F.col("place"))).alias("given"), F.count_distinct(F.nullif("alias", F.lit(""))).alias("n_aliases"), in_order(F.collect_set("kind")).alias("sources"))
    skills = skills.select("canonical_skill", F.coalesce("given", inferred).alias("skill_type"), "n_aliases", "sources")
    excluded = sources.blocked.select(phrase_key("phrase").alias("phrase")).where("phrase <> ''").distinct()
    return Framework(skills, aliases, excluded)
