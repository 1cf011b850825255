"""Findings of round 4: only pairs that share a skill are scored, and equal modules once."""

import random

import pytest

from tessera import catalog, registry  # noqa: F401  (the catalogue fills the register)
from tessera.operators import align, ranking


def _jobs(spark, rng, codes, skills):
    return align.family_profiles(spark.createDataFrame([(f"c{rng.randrange(codes):03}", "t", 1, rng.sample(skills, 2)) for _ in range(3 * codes)], "code string, title string, is_good_job int, skills array<string>"))


@pytest.mark.parametrize("weights", [align.Weights(), align.LEGACY, align.Weights(0.4, -0.9, 0.1, gain=0.0, clamped=False)])
def test_equal_modules_are_ranked_once_and_only_where_they_share(spark, weights):
    """Few of all modules times families are scored; results are those of all of them, one by one."""
    rng, skills = random.Random(3), [f"s{i}" for i in range(90)]
    families, theirs = _jobs(spark, rng, 120, skills)
    kinds = [rng.sample([*skills, "none"], rng.randint(1, 3)) for _ in range(12)] + [["none"], [], None, [None, "s1"], ["s1"], ["s1", "s1", "s2"], ["s1", "s2"]]
    modules = [(i, kinds[i % len(kinds)]) for i in range(40 * len(kinds))]
    m = spark.createDataFrame(modules, "module_id long, skills array<string>").repartition(5)
    scored = spark.sparkContext.accumulator(0)

    def score(*measures):
        scored.add(len(measures[0].ravel()))
        return weights.of_arrays(*measures)

    zero = 0.0 if weights.clamped else -weights.loss
    got = ranking.best_families(m, align.module_skills(m), families, theirs, "module_id", 10, 6, score, zero).collect()
    assert scored.value < 0.05 * len(modules) * families.count()
    assert len(got) == 6 * len(modules) == len({(r.module_id, r["rank"]) for r in got})
    pairs = {(r.module_id, r.code): (r.overlap_count, r.score) for r in align.pair_scores(align.module_skills(m.where(f"module_id < {len(kinds)}")), theirs, k=10, weights=weights).collect()}
    jobs = {f.code: f.job_count for f in families.collect()}
    for r in got:
        kind = r.module_id % len(kinds)
        overlap, value = pairs.get((kind, r.code), (0, zero))
        assert r.overlap_count == overlap == len(r.overlap) and abs(r.score - value) < 1e-9
    for kind in range(len(kinds)):
        key = lambda c: (-round(pairs.get((kind, c), (0, zero))[1], 4), -pairs.get((kind, c), (0, 0))[0], -jobs[c], c)
        want = sorted(jobs, key=key)[:6]
        assert all([r.code for r in sorted((r for r in got if r.module_id == i), key=lambda r: r["rank"])] == want for i in (kind, kind + 13 * len(kinds)))


def test_best_families_are_found_once_for_listings(spark, sf):
    """What ranks listings reads the modules' families from a table, not from a plan repeated for each use."""
    plan = registry.QUERIES["align_listing_rerank"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
