"""Alignment of modules with job families in skill space.

Families and modules are long tables of weighted skills.  The best families of a module are found in tasks
(``ranking``), where pairs are sums in arrays and never rows; ``top_scores`` gives the pairs that bounds
cannot rule out (``candidate_pairs``) as rows, for callers that want more of them than the best.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import clamp, ratio
from tessera.operators import ranking


@dataclass(frozen=True)
class Weights:
    """score = coverage, jaccard and cosine terms, plus ``gain`` * (1 - gap), or minus ``loss`` * gap."""

    coverage: float = 0.4
    jaccard: float = 0.25
    cosine: float = 0.2
    gain: float = 0.15
    loss: float = 0.0
    clamped: bool = True

    def score(self, coverage: Column, jaccard: Column, cosine: Column, gap: Column) -> Column:
        total = coverage * self.coverage + jaccard * self.jaccard + cosine * self.cosine
        if self.gain:
            total = total + (1 - gap) * self.gain
        if self.loss:
            total = total - gap * self.loss
        return clamp(total) if self.clamped else total

    def of_arrays(self, coverage: np.ndarray, jaccard: np.ndarray, cosine: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """``score`` of arrays."""
        total = coverage * self.coverage + jaccard * self.jaccard + cosine * self.cosine + (1 - gap) * self.gain - gap * self.loss
        return np.clip(total, 0, 1) if self.clamped else total


#: How many times longer a skill's list of families gets for those of which it is a top skill.
MORE = 4
#: Weights of the earlier scorer, which took 20 skills of a family and listed 10 matches.
LEGACY = Weights(0.35, 0.35, 0.30, gain=0.0, loss=0.20, clamped=False)


def rounded(x: Column | str, places: int = 4) -> Column:
    """Rounded after dropping the last bits, which depend on the order of a sum."""
    return F.round(F.round(x, 10), places)


def family_profiles(jobs: DataFrame, code: str | Column = "code", title: str | Column = "title", good: str = "is_good_job", skills: str = "skills", distinct: bool = False) -> tuple[DataFrame, DataFrame]:
    """(families, skills): one row per family, and one per family and skill.

    families: code, title, job_count, good_job_count, good_job_pct (4 places).  skills: code, skill, cnt
    (jobs that list it), w (share of the family's counts), rk (by count, then name).  Jobs without a
    code or without skills take no part.
    """
    code = F.col(code) if isinstance(code, str) else code
    title = F.col(title) if isinstance(title, str) else title
    listed = F.array_distinct(skills) if distinct else F.col(skills)
    taken = jobs.select(code.alias("code"), title.alias("title"), F.col(good).alias("good"), listed.alias("skills")).where(F.col("code").isNotNull() & (F.col("code") != "") & (F.size("skills") > 0))
    families = taken.groupBy("code").agg(F.max("title").alias("title"), F.count("*").alias("job_count"), F.sum("good").cast("long").alias("good_job_count"))
    families = families.withColumn("good_job_pct", F.round(F.col("good_job_count") / F.col("job_count"), 4))
    counts = taken.select("code", F.explode("skills").alias("skill")).groupBy("code", "skill").agg(F.count("*").alias("cnt"))
    return families, weighted(counts, "code")


def weighted(counts: DataFrame, key: str) -> DataFrame:
    """Adds w, the share of the key's counts, and rk, the rank by count and then skill."""
    by = Window.partitionBy(key)
    return counts.withColumn("w", F.col("cnt") / F.sum("cnt").over(by)).withColumn("rk", F.row_number().over(by.orderBy(F.desc("cnt"), "skill")))


def module_skills(modules: DataFrame, key: str = "module_id", skills: str = "skills") -> DataFrame:
    """(key, skill, cnt, w, rk) of modules' skill lists."""
    return weighted(modules.select(key, F.explode(skills).alias("skill")).groupBy(key, "skill").agg(F.count("*").alias("cnt")), key)


def _sums(k: int) -> dict[str, Column]:
    """What the scores of a pair are made of, as sums over shared skills."""
    top = F.col("rk") <= k
    return {
        "overlap_count": F.count("*"),
        "common": F.sum(F.least("mw", "fw")),
        "dot": F.sum(F.col("mw") * F.col("fw")),
        "hits": F.sum(F.when(top, 1).otherwise(0)),
        "hit_cnt": F.sum(F.when(top, F.col("cnt")).otherwise(0)),
        **{c: F.first(c) for c in ("m_norm", "f_norm", "top_n", "top_cnt")},
    }


def _measures(weights: Weights) -> dict[str, Column]:
    coverage = F.col("hits") / F.col("top_n")
    jaccard = F.col("common") / (2 - F.col("common"))  # both sides' weights sum to 1
    cosine = F.col("dot") / F.sqrt(F.col("m_norm") * F.col("f_norm"))
    gap = 1 - F.col("hit_cnt") / F.col("top_cnt")
    return {"coverage": coverage, "jaccard": jaccard, "cosine": cosine, "gap": gap, "score": weights.score(coverage, jaccard, cosine, gap)}


def _module_side(mine: DataFrame, key: str) -> DataFrame:
    norm = mine.groupBy(key).agg(F.sum(F.col("w") * F.col("w")).alias("m_norm"))
    return mine.join(norm, key).select(key, "skill", F.col("w").alias("mw"), "m_norm")


def _family_side(theirs: DataFrame, k: int, also: list[str]) -> DataFrame:
    top = theirs.groupBy("code").agg(F.sum(F.col("w") * F.col("w")).alias("f_norm"), F.least(F.count("*"), F.lit(k)).alias("top_n"), F.sum(F.when(F.col("rk") <= k, F.col("cnt"))).alias("top_cnt"))
    return theirs.join(top, "code").select("code", "skill", *also, F.col("w").alias("fw"), "cnt", "rk", "f_norm", "top_n", "top_cnt")


def pair_scores(mine: DataFrame, theirs: DataFrame, key: str = "module_id", k: int = 10, weights: Weights = Weights(), inside: DataFrame | None = None, within: str | None = None, lists: bool = False) -> DataFrame:
    """Scores, unrounded, of the pairs that share a skill: coverage of the family's k top skills,
    weighted Jaccard, cosine, gap and the combined score.

    ``inside`` (key, within) restricts the pairs to those of which ``theirs`` has the same ``within``;
    it is part of the join's key, so other pairs are never made.  ``lists`` adds the shared skills.
    """
    also = [within] if within else []
    left, right = _module_side(mine, key), _family_side(theirs, k, also)
    if inside is not None:
        left = left.join(inside, key)
    shared = {"overlap": F.array_sort(F.collect_list("skill"))} if lists else {}
    pairs = left.join(right, ["skill", *also]).groupBy(key, *also, "code").agg(*[c.alias(n) for n, c in (_sums(k) | shared).items()])
    return pairs.select(key, *also, "code", "overlap_count", *shared, *[c.alias(n) for n, c in _measures(weights).items()])


def candidate_pairs(mine: DataFrame, theirs: DataFrame, key: str = "module_id", k: int = 10, n: int = 5, weights: Weights = Weights(), head: int = 16, salts: int = 8) -> DataFrame:
    """(key, codes): families among which each module's n best are; null codes mean any family.

    Every term of a score grows with each shared skill.  Only the ``head`` families in which a skill counts
    most (``MORE`` times as many, if it is one of their top skills) are joined with the modules that have
    it; what any other family could add through the skill is
    bounded by the greatest values behind the head.  The n-th best score by heads alone is a score that n
    families reach at least; families whose bound stays below it, in the 4 places that matches are ranked
    by, cannot be among the n best.  If even a family in no head could reach it, or fewer than n
    families are known, all stay.  A skill's head is dealt over ``salts`` keys, so of the modules with
    a hot skill one task joins no more than their share; a module's row never holds more than ``MORE *
    head`` families for each of its skills.
    """
    right = _family_side(theirs, k, [])
    gain, hit = weights.gain + weights.loss, F.when(F.col("rk") <= k, 1).otherwise(0)
    covers, fills = hit / F.col("top_n"), hit * F.col("cnt") / F.col("top_cnt")
    angle = F.col("fw") / F.sqrt("f_norm")
    impact = covers * weights.coverage + fills * gain + F.col("fw") * weights.jaccard + angle * weights.cosine
    place = F.row_number().over(Window.partitionBy("skill").orderBy(impact.desc(), "code"))
    ahead = (F.col("place") <= head) | ((F.col("covers") > 0) & (F.col("place") <= MORE * head))
    placed = right.select("code", "skill", "fw", covers.alias("covers"), fills.alias("fills"), angle.alias("angle"), place.alias("place")).withColumn("ahead", ahead)
    behind = lambda c: F.max(F.when(F.col("ahead"), 0.0).otherwise(F.col(c)))
    first = F.collect_list(F.when(F.col("ahead"), F.struct("code", "fw", "covers", "fills", "angle")))
    heads = placed.groupBy("skill").agg(first.alias("first"), *[behind(c).alias(f"r_{c}") for c in ("fw", "covers", "fills", "angle")])
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def worth(covers: Column, fills: Column, fw: Column, angle: Column) -> Column:
        """What one shared skill adds at most: a Jaccard of s / (2 - s) is never above s."""
        return covers * weights.coverage + fills * gain + F.least(F.col("mw"), fw) * weights.jaccard + F.col("mw") / F.sqrt("m_norm") * angle * weights.cosine

    left = _module_side(mine, key).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    rest = worth(F.col("r_covers"), F.col("r_fills"), F.col("r_fw"), F.col("r_angle"))
    joined = left.join(heads, ["skill", "salt"]).select(key, "mw", "m_norm", rest.alias("rest"), "first")
    # a row of its own (no code) carries the bound of a family that is in no head
    rows = joined.select(key, "mw", "m_norm", "rest", F.explode(F.array_append("first", F.lit(None).cast(heads.schema["first"].dataType.elementType))).alias("f")).select(key, "mw", "m_norm", "rest", "f.*")
    more = worth(F.col("covers"), F.col("fills"), F.col("fw"), F.col("angle"))
    nil = F.lit(0.0)
    known = rows.groupBy(key, "code").agg(
        F.sum(F.coalesce("covers", nil)).alias("covers"), F.sum(F.coalesce("fills", nil)).alias("fills"), F.sum(F.coalesce(F.least("mw", "fw"), nil)).alias("common"),
        F.sum(F.coalesce(F.col("mw") / F.sqrt("m_norm") * F.col("angle"), nil)).alias("cosine"), F.sum(F.coalesce(more, nil)).alias("most"), F.sum("rest").alias("rest"),
    )
    least = F.col("covers") * weights.coverage + F.col("fills") * gain + F.col("common") / (2 - F.col("common")) * weights.jaccard + F.col("cosine") * weights.cosine
    listed = F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", least.alias("least"), (F.col("most") - F.col("rest")).alias("most"))))
    per = known.groupBy(key).agg(listed.alias("listed"), F.max(F.when(F.col("code").isNull(), F.col("rest"))).alias("rest"))
    nth = F.when(F.size("listed") >= n, F.element_at(F.sort_array(F.transform("listed", lambda x: x["least"]), asc=False), n))
    # sums in another order may differ in their last bits, and matches are ranked by 4 places
    bar = nth - 1e-4
    codes = F.transform(F.filter("listed", lambda x: x["most"] + F.col("rest") >= bar), lambda x: x["code"])
    return per.select(key, F.when(F.col("rest") < bar, codes).alias("codes"))


def top_scores(mine: DataFrame, theirs: DataFrame, key: str = "module_id", k: int = 10, n: int = 5, weights: Weights = Weights(), head: int = 16, salts: int = 8) -> DataFrame:
    """``pair_scores`` of pairs among which are the n best of every module: those of ``candidate_pairs``."""
    found = candidate_pairs(mine, theirs, key, k, n, weights, head, salts)
    # a list of all families (a thousand at most) where none can be ruled out
    everything = theirs.agg(F.collect_set("code").alias("all"))
    pairs = found.crossJoin(F.broadcast(everything)).select(key, F.explode(F.coalesce("codes", "all")).alias("code"))
    deal = F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")
    left = _module_side(mine, key).join(pairs, key).withColumn("salt", deal)
    right = _family_side(theirs, k, []).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sums = [c.alias(name) for name, c in _sums(k).items()]
    out = left.join(right, ["code", "skill", "salt"]).groupBy(key, "code").agg(*sums)
    return out.select(key, "code", "overlap_count", *[c.alias(name) for name, c in _measures(weights).items()])


def top_matches(modules: DataFrame, mine: DataFrame, families: DataFrame, theirs: DataFrame, key: str = "module_id", k: int = 10, n: int = 5, weights: Weights = Weights()) -> DataFrame:
    """The n best families of every module, by rounded score, overlap, job count and code.

    A family without overlap scores 0 (with clamped weights, else minus ``loss``, and no overlap scores
    below that), as every family does for a module without skills; such families follow by job count
    and code.
    """
    zero = 0.0 if weights.clamped else -weights.loss
    best = ranking.best_families(modules, mine, families, theirs, key, k, n, weights.of_arrays, zero)
    columns = ["code", "title", "job_count", "good_job_count", "good_job_pct", "overlap_count", "overlap"]
    shown = [rounded(c).alias(c) for c in ("coverage", "jaccard", "cosine", "gap", "score")]
    # families are a thousand at most
    return best.join(F.broadcast(families), "code").select(key, "rank", *columns, *shown, rounded(F.col("score") * F.col("good_job_pct")).alias("quality"))


def module_metrics(modules: DataFrame, matches: DataFrame, key: str = "module_id", n: int = 3) -> DataFrame:
    """Every module with its first match's measures and the score-weighted good-job share of its n first."""
    top = matches.groupBy(key).agg(
        *[F.max(F.when(F.col("rank") == 1, F.col(c))).alias(f"top1_{c}") for c in ("overlap_count", "score", "good_job_pct", "quality")],
        F.sum(F.when(F.col("rank") <= n, F.col("score") * F.col("good_job_pct"))).alias("weighted"),
        F.sum(F.when(F.col("rank") <= n, F.col("score"))).alias("weight"),
    )
    pct = F.when(F.col("weight") > 0, rounded(F.col("weighted") / F.col("weight"))).otherwise(0.0)
    return modules.join(top, key, "left").withColumn("top3_pct", F.when(F.col("weight").isNotNull(), pct)).drop("weighted", "weight")


def _rates(denominator: Column) -> list[Column]:
    mean = lambda c: F.coalesce(rounded(F.sum(c) / F.nullif(denominator, F.lit(0))), F.lit(0.0))
    return [mean("top1_score").alias("average_top1_score"), mean("top1_good_job_pct").alias("average_top1_good_job_pct"), mean("top1_quality").alias("average_top1_quality"), mean("top3_pct").alias("average_top3_pct")]


def summary(metrics: DataFrame, families: DataFrame, skills: str = "skills", denominator: str = "all") -> DataFrame:
    """One row of measures of a run.  ``denominator``: ``all`` modules or those ``non_empty``; with the
    latter, empty modules count in no rate."""
    m = metrics if denominator == "all" else metrics.where(F.size(skills) > 0)
    n = F.count("*")
    out = m.agg(
        n.alias("module_count"),
        F.count_if(F.coalesce(F.size(skills), F.lit(0)) <= 0).alias("empty_modules"),
        F.count_if(F.col("top1_score") > 0).alias("top1_positive_modules"),
        F.count_if(F.col("top1_overlap_count") > 0).alias("top1_overlap_modules"),
        F.round(ratio(F.count_if(F.col("top1_score") > 0), n), 4).alias("top1_positive_rate"),
        F.round(ratio(F.count_if(F.col("top1_overlap_count") > 0), n), 4).alias("top1_overlap_rate"),
        *_rates(n),
    )
    return out.crossJoin(families.agg(F.count("*").alias("job_group_count")))


def department_summary(metrics: DataFrame, *by: str, skills: str = "skills") -> DataFrame:
    """The measures by department; averages run over modules that have a match."""
    n = F.count("*")
    empty, overlap = F.count_if(F.coalesce(F.size(skills), F.lit(0)) <= 0), F.count_if(F.col("top1_overlap_count") > 0)
    out = metrics.groupBy(*by).agg(n.alias("module_count"), empty.alias("empty_modules"), F.round(ratio(empty, n), 4).alias("empty_module_rate"), overlap.alias("top1_overlap_modules"), F.round(ratio(overlap, n), 4).alias("top1_overlap_rate"), *_rates(F.count("top1_score")))
    return out.orderBy(F.desc("average_top1_quality"), F.desc("average_top1_score"), F.desc("module_count"), *by)


def rerank_listings(matches: DataFrame, mine: DataFrame, listings: DataFrame, key: str = "module_id", families: int = 3, k: int = 20, n: int = 10, weights: Weights = LEGACY) -> DataFrame:
    """The n best single listings of a module inside its first families.

    ``listings``: job_id, code, skills.  A listing is scored as a family of one, in tasks (``ranking``).
    """
    inside = matches.where(F.col("rank") <= families).select(key, F.col("code").alias("family"))
    jobs = listings.where(F.size("skills") > 0)
    each = jobs.select(F.col("job_id").alias("code"), F.col("code").alias("family"), F.explode(F.array_distinct("skills")).alias("skill"))
    theirs = weighted(each.groupBy("code", "skill").agg(F.count("*").alias("cnt"), F.first("family").alias("family")), "code")
    return ranking.best_listings(inside, mine, theirs, key, k, n, weights.of_arrays)


def missing_skills(matches: DataFrame, theirs: DataFrame, key: str = "module_id", n: int = 10) -> DataFrame:
    """The first n skills of each matched family that the module lacks: those that ``overlap`` doesn't list.
    A family's skills meet its matches as one list, so that no row is made for a skill of a match."""
    known = theirs.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "skill"))), lambda s: s["skill"]).alias("known"))
    lack = F.slice(F.array_except("known", "overlap"), 1, n)
    return matches.select(key, "code", "overlap").join(known, "code").select(key, "code", lack.alias("missing")).where(F.size("missing") > 0)


def rollup_counts(rows: DataFrame, tags: str, skills: str = "skills") -> DataFrame:
    """Skill counts of departments or programmes: every distinct tag of a module gets all its skills."""
    return rows.select(F.explode(F.array_distinct(tags)).alias("tag"), skills).select("tag", F.explode(skills).alias("skill")).groupBy("tag", "skill").agg(F.count("*").alias("cnt"))
