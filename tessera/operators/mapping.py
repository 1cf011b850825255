"""Phrases to canonical skills: excluded, exact, semantic or unmapped."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import phrase_key
from tessera.operators.embed import Embedder, nearest


@dataclass
class Framework:
    """Skills with a type and aliases, and phrases that are none."""

    skills: dict[str, tuple[str, list[str]]] = field(default_factory=dict)
    excluded: list[str] = field(default_factory=list)

    def add(self, skill: str, kind: str = "hard", aliases: Iterable[str] = ()) -> None:
        """Adds aliases to a skill; of its kinds the first in the order of ``PRECEDENCE`` stays."""
        old = self.skills.get(skill)
        merged = list(dict.fromkeys([*(old[1] if old else [skill]), *aliases]))
        kinds = [old[0] if old else kind, kind]
        self.skills[skill] = (min(kinds, key=PRECEDENCE.index), merged)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(skills, aliases, excluded).  ``skill_order`` follows the sorted names."""
        names = sorted(self.skills)
        skills = spark.createDataFrame([(s, self.skills[s][0], i) for i, s in enumerate(names)], "canonical_skill string, skill_type string, skill_order int")
        aliases = spark.createDataFrame([(a, s, i) for i, s in enumerate(names) for a in self.skills[s][1]], "alias string, canonical_skill string, skill_order int")
        return skills, aliases.withColumn("alias", phrase_key("alias")), spark.createDataFrame([(x,) for x in self.excluded], "phrase string").select(phrase_key("phrase").alias("phrase"))


PRECEDENCE = ["seed", "tool", "soft", "domain", "hard"]


def map_phrases(phrases: DataFrame, skills: DataFrame, aliases: DataFrame, excluded: DataFrame, phrase: str = "phrase", exclusion: str = "documented", embedder: Embedder | None = None, threshold: float = 0.72) -> DataFrame:
    """One row per distinct key of ``phrases``: key, canonical_skill, skill_type, match_type, score.

    ``exclusion``: ``documented`` tests excluded phrases first, ``batch_compat`` never does.  An alias
    of several skills means the last of them by name when it is met exactly, and the first when it is
    nearest.  Phrases that match nothing are their own label.  Each key is mapped once.
    """
    keys = phrases.select(phrase_key(phrase).alias("key")).distinct()
    exact = aliases.groupBy(F.col("alias").alias("a_key")).agg(F.max("canonical_skill").alias("exact"))
    out = keys.join(excluded.select(F.col("phrase").alias("x_key")).distinct(), F.col("key") == F.col("x_key"), "left").join(exact, F.col("key") == F.col("a_key"), "left")
    is_out = F.col("x_key").isNotNull() if exclusion == "documented" else F.lit(False)
    kind = F.when(F.col("key") == "", "empty").when(is_out, "excluded").when(F.col("exact").isNotNull(), "exact")
    out = out.select("key", "exact", kind.alias("match_type"))
    if embedder is not None:
        targets = aliases.groupBy("alias").agg(F.min("canonical_skill").alias("target"))
        near = nearest(out.where(F.col("match_type").isNull()).select("key"), targets, embedder, "key", "alias", "target")
        out = out.join(near.withColumnRenamed("key", "n_key"), F.col("key") == F.col("n_key"), "left")
    else:
        out = out.withColumn("target", F.lit(None).cast("string")).withColumn("near", F.lit(0.0))
    hit = F.coalesce(F.col("near") >= threshold, F.lit(False)) & F.col("target").isNotNull()
    label = F.when(F.col("match_type").isin("empty", "excluded"), "").when(F.col("match_type") == "exact", F.col("exact")).when(hit, F.col("target")).otherwise(F.col("key"))
    score = F.when(F.col("match_type") == "empty", 0.0).when(F.col("match_type").isNotNull(), 1.0).otherwise(F.round(F.coalesce("near", F.lit(0.0)), 6))
    out = out.select("key", label.alias("canonical_skill"), score.alias("score"), F.coalesce("match_type", F.when(hit, "semantic").otherwise("unmapped")).alias("match_type"))
    kinds = skills.select(F.col("canonical_skill").alias("s_skill"), "skill_type")
    known = F.col("match_type").isin("exact", "semantic")
    return out.join(kinds, F.col("canonical_skill") == F.col("s_skill"), "left").select("key", "canonical_skill", F.when(known, F.coalesce("skill_type", F.lit(""))).otherwise("").alias("skill_type"), "match_type", "score")


def map_lists(rows: DataFrame, mapped: DataFrame, skills: str = "skills", key: str = "id") -> DataFrame:
    """``canonical_skills`` (sorted, distinct) and ``canonical_skills_details`` of every row, by joining
    the mapped keys back on the phrases."""
    each = rows.select(key, F.posexplode(skills).alias("pos", "raw_phrase")).withColumn("normalized_phrase", phrase_key("raw_phrase"))
    table = mapped.withColumnRenamed("key", "_m")
    both = each.join(table, F.col("normalized_phrase") == F.col("_m"), "left")
    detail = F.struct("pos", "raw_phrase", "normalized_phrase", "canonical_skill", "skill_type", "match_type", "score")
    lists = both.groupBy(key).agg(F.array_sort(F.collect_list(detail)).alias("_d"))
    names = F.array_sort(F.array_distinct(F.filter(F.transform("_d", lambda d: d["canonical_skill"]), lambda s: s != "")))
    lists = lists.select(F.col(key).alias("_k"), names.alias("canonical_skills"), F.transform("_d", lambda d: d.dropFields("pos")).alias("canonical_skills_details"))
    out = rows.join(lists, F.col(key) == F.col("_k"), "left").drop("_k")
    return out.withColumn("canonical_skills", F.coalesce("canonical_skills", F.array().cast("array<string>")))


def frequent_vocabulary(jobs: DataFrame, skills: str = "skills", n: int = 8000) -> DataFrame:
    """The earlier mapper's canonical skills: the n most frequent job skills."""
    counts = jobs.select(F.explode(skills).alias("skill")).groupBy("skill").agg(F.count("*").alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "skill").limit(n)


def map_to_frequent(raw: DataFrame, jobs: DataFrame, phrase: str = "phrase", skills: str = "skills", embedder: Embedder | None = None, threshold: float = 0.62, n: int = 8000) -> DataFrame:
    """The earlier mapper's audit rows (raw_skill, mapped_skill, match_type, similarity), one for each
    distinct key of ``raw``: exact among the ``n`` most frequent job skills, else the nearest of these
    from ``threshold`` on, else itself.  Empty keys are left out.  Without an embedder the rest is
    ``unmapped_no_model``, without any job skill ``unmapped``."""
    keyed = jobs.select(F.filter(F.transform(skills, lambda s: phrase_key(s)), lambda s: s != "").alias("skills"))
    known = frequent_vocabulary(keyed, "skills", n).select(F.col("skill").alias("target"))
    keys = raw.select(phrase_key(phrase).alias("raw_skill")).where("raw_skill <> ''").distinct()
    out = keys.join(known, F.col("raw_skill") == F.col("target"), "left")
    exact = out.where(F.col("target").isNotNull()).select("raw_skill", F.col("target").alias("mapped_skill"), F.lit("exact").alias("match_type"), F.lit(1.0).alias("similarity"))
    rest = out.where(F.col("target").isNull()).select("raw_skill")
    if embedder is None:
        none = known.agg((F.count("*") == 0).alias("none"))
        left = rest.crossJoin(F.broadcast(none)).select("raw_skill", F.col("raw_skill").alias("mapped_skill"), F.when(F.col("none"), "unmapped").otherwise("unmapped_no_model").alias("match_type"), F.lit(0.0).alias("similarity"))
        return exact.unionAll(left)
    near = nearest(rest, known.select(F.col("target").alias("t"), F.col("target").alias("l")), embedder, "raw_skill", "t", "l")
    met = rest.join(near.withColumnRenamed("raw_skill", "_r"), F.col("raw_skill") == F.col("_r"), "left")
    hit = F.coalesce(F.col("near") >= threshold, F.lit(False))
    kind = F.when(F.col("near").isNull(), "unmapped").when(hit, "semantic").otherwise("unmapped_below_threshold")
    return exact.unionAll(met.select("raw_skill", F.when(hit, F.col("l")).otherwise(F.col("raw_skill")).alias("mapped_skill"), kind.alias("match_type"), F.round(F.coalesce("near", F.lit(0.0)), 6).alias("similarity")))
