"""The query catalogue over the test tables: every query beside the SQL that gives the same rows.

Role mapping: a posting is an order of status F, a module an order of status O, a skill is brand and type of a line's part, a code is nation, priority digit and customer suffix; texts
are documents, web pages are pages, vectors are embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import values
from tessera.functions import arrays, fuzzy, numeric, serial, text
from tessera.operators import align, benchmark, clean_courses, clean_jobs, clusters, embed, enrich, explore, extract, mapping, patterns, rules, scope, search
from tessera.registry import ORACLE, QUERIES, Tables, query  # noqa: F401
from tessera.sources import readers, shared
from tessera.streaming import families as streaming

# ---------------------------------------------------------------- alignment


def order_skills(t: Tables, lines: DataFrame | None = None) -> DataFrame:
    lines = (t.lineitem if lines is None else lines).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.concat_ws(" ", "p_brand", "p_type").alias("skill"))
    return lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("skill").alias("skills"))


def _owned(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))


def postings(t: Tables) -> DataFrame:
    rows = _owned(t).where("o_orderstatus = 'F'")
    cut = t.orders.where("o_orderstatus = 'F'").agg(F.percentile("o_totalprice", F.lit(0.7)).alias("cut"))
    code = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.left("o_orderpriority", F.lit(1)), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"))
    rows = rows.crossJoin(F.broadcast(cut)).select(F.col("o_orderkey").alias("job_id"), code.alias("code5"), F.col("n_name").alias("title"), (F.col("o_totalprice") >= F.col("cut")).cast("int").alias("is_good_job"))
    return rows.join(order_skills(t), F.col("job_id") == F.col("k")).drop("k")


def modules(t: Tables) -> DataFrame:
    rows = _owned(t).where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("module_id"), F.col("n_name").alias("source"), F.col("c_mktsegment").alias("department"))
    return rows.join(order_skills(t), F.col("module_id") == F.col("k"), "left").drop("k")


def _aligned(t: Tables, digits: int = 3, **how) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    m = modules(t)
    families, theirs = align.family_profiles(postings(t), F.left("code5", F.lit(digits)))
    mine = align.module_skills(m)
    return m, mine, families, theirs, align.top_matches(m, mine, families, theirs, **how)


_SKILLS = "sk AS (SELECT DISTINCT l_orderkey AS k, p_brand || ' ' || p_type AS skill FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _align_sql(digits: int = 3, k: int = 10, n: int = 5, score: str = "greatest(0, least(1, cov * 0.4 + wj * 0.25 + cs * 0.2 + (1 - gap) * 0.15))") -> str:
    return f"""
WITH {_SKILLS},
own AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
post AS (SELECT o_orderkey AS job_id, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || left(o_orderpriority, 1) || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS code5, n_name AS title,
  CAST(o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.7) FROM orders WHERE o_orderstatus = 'F') AS INT) AS good
  FROM own WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT k FROM sk)),
mods AS (SELECT o_orderkey AS module_id, n_name AS source, c_mktsegment AS department FROM own WHERE o_orderstatus = 'O'),
fam AS (SELECT left(code5, {digits}) AS code, max(title) AS title, count(*) AS job_count, sum(good) AS good_job_count, round(sum(good) / count(*), 4) AS good_job_pct FROM post GROUP BY 1),
fs AS (SELECT left(code5, {digits}) AS code, skill, count(*) AS cnt FROM post JOIN sk ON job_id = k GROUP BY 1, 2),
fw AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY code) AS w, row_number() OVER (PARTITION BY code ORDER BY cnt DESC, skill) AS rk FROM fs),
ft AS (SELECT code, sum(w * w) AS fn, least(count(*), {k}) AS tn, sum(cnt) FILTER (rk <= {k}) AS tc FROM fw GROUP BY 1),
mw AS (SELECT module_id, skill, 1.0::DOUBLE / count(*) OVER (PARTITION BY module_id) AS w FROM mods JOIN sk ON module_id = k),
mn AS (SELECT module_id, sum(w * w) AS mn FROM mw GROUP BY 1),
pr AS (SELECT module_id, code, count(*) AS overlap_count, list_sort(list(skill)) AS overlap, sum(least(mw.w, fw.w)) AS s, sum(mw.w * fw.w) AS d, count(*) FILTER (rk <= {k}) AS h, coalesce(sum(cnt) FILTER (rk <= {k}), 0) AS hc FROM mw JOIN fw USING (skill) GROUP BY 1, 2),
cand AS (SELECT module_id, code FROM pr UNION SELECT module_id, code FROM mods, (SELECT code, row_number() OVER (ORDER BY job_count DESC, code) AS i FROM fam) WHERE i <= {n} + (SELECT coalesce(max(c), 0) FROM (SELECT count(*) AS c FROM pr GROUP BY module_id))),
sc AS (SELECT m.module_id, m.source, m.department, fam.*, coalesce(overlap_count, 0) AS overlap_count, coalesce(overlap, []) AS overlap, coalesce(h / tn, 0) AS cov, coalesce(s / (2 - s), 0) AS wj, coalesce(d / sqrt(mn * fn), 0) AS cs, coalesce(1 - hc / tc, 1) AS gap
  FROM mods m JOIN cand ON cand.module_id = m.module_id JOIN fam ON fam.code = cand.code LEFT JOIN pr ON pr.module_id = m.module_id AND pr.code = fam.code LEFT JOIN ft ON ft.code = fam.code LEFT JOIN mn ON mn.module_id = m.module_id),
al AS (SELECT *, {score} AS raw FROM sc),
rk AS (SELECT *, round(round(raw, 10), 4) AS score, round(round(raw * good_job_pct, 10), 4) + 0 AS quality, row_number() OVER (PARTITION BY module_id ORDER BY round(round(raw, 10), 4) DESC, overlap_count DESC, job_count DESC, code) AS rank FROM al),
top AS (SELECT * FROM rk WHERE rank <= {n}),
one AS (SELECT module_id, any_value(source) AS source, any_value(department) AS department, count(*) FILTER (rank = 1) AS has, max(overlap_count) FILTER (rank = 1) AS o1, max(score) FILTER (rank = 1) AS s1, max(good_job_pct) FILTER (rank = 1) AS g1, max(quality) FILTER (rank = 1) AS q1,
  CASE WHEN sum(score) FILTER (rank <= 3) > 0 THEN round(round(sum(score * good_job_pct) FILTER (rank <= 3) / sum(score) FILTER (rank <= 3), 10), 4) ELSE 0 END AS p3,
  module_id NOT IN (SELECT k FROM sk) AS empty FROM top GROUP BY 1)
"""


_MATCH = "module_id, rank, code, title, job_count, good_job_count, good_job_pct, overlap_count, array_to_string(overlap, ', ') AS overlap, round(round(cov, 10), 4) AS coverage, round(round(wj, 10), 4) AS jaccard, round(round(cs, 10), 4) AS cosine, round(round(gap, 10), 4) AS gap, score, quality"


def _shown(matches: DataFrame) -> DataFrame:
    return matches.withColumn("overlap", F.array_join("overlap", ", "))


@query(_align_sql() + f"SELECT {_MATCH} FROM top")
def align_top_matches(t):
    return _shown(_aligned(t)[4])


@query(_align_sql(5, n=3) + f"SELECT {_MATCH} FROM top")
def align_level_5d(t):
    return _shown(_aligned(t, 5, n=3)[4])


@query(_align_sql(k=20, n=10, score="cov * 0.35 + wj * 0.35 + cs * 0.3 - gap * 0.2") + f"SELECT {_MATCH} FROM top")
def align_legacy_weights(t):
    return _shown(_aligned(t, k=20, n=10, weights=align.LEGACY)[4])


@query(_align_sql() + "SELECT code, title, job_count, good_job_count, good_job_pct, array_to_string(list(skill ORDER BY rk) FILTER (rk <= 5), ', ') AS top_skills FROM fam JOIN fw USING (code) GROUP BY ALL")
def align_family_profile(t):
    families, skills = align.family_profiles(postings(t), F.left("code5", F.lit(3)))
    top = skills.where("rk <= 5").groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "skill"))), lambda s: s["skill"]), ", ").alias("top_skills"))
    return families.join(top, "code")


_AVERAGES = "round(round(avg(s1), 10), 4) AS average_top1_score, round(round(avg(g1), 10), 4) AS average_top1_good_job_pct, round(round(avg(q1), 10), 4) AS average_top1_quality, round(round(avg(p3), 10), 4) AS average_top3_pct"
_SUMMARY = f"SELECT count(*) AS module_count, count(*) FILTER (empty) AS empty_modules, count(*) FILTER (s1 > 0) AS top1_positive_modules, count(*) FILTER (o1 > 0) AS top1_overlap_modules, round(count(*) FILTER (s1 > 0) / count(*), 4) AS top1_positive_rate, round(count(*) FILTER (o1 > 0) / count(*), 4) AS top1_overlap_rate, {_AVERAGES}, (SELECT count(*) FROM fam) AS job_group_count FROM one"


def _metrics(t: Tables) -> tuple[DataFrame, DataFrame]:
    m, _, families, _, top = _aligned(t)
    return align.module_metrics(m, top), families


@query(_align_sql() + _SUMMARY)
def align_summary(t):
    return align.summary(*_metrics(t))


@query(_align_sql() + _SUMMARY + " WHERE NOT empty")
def align_summary_nonempty(t):
    return align.summary(*_metrics(t), denominator="non_empty")


@query(_align_sql() + f"SELECT department, count(*) AS module_count, count(*) FILTER (empty) AS empty_modules, round(count(*) FILTER (empty) / count(*), 4) AS empty_module_rate, count(*) FILTER (o1 > 0) AS top1_overlap_modules, round(count(*) FILTER (o1 > 0) / count(*), 4) AS top1_overlap_rate, {_AVERAGES} FROM one GROUP BY 1")
def align_department_summary(t):
    return align.department_summary(_metrics(t)[0], "department")


@query(_align_sql() + """, jw AS (SELECT job_id, left(code5, 3) AS family, skill, 1.0::DOUBLE / count(*) OVER (PARTITION BY job_id) AS w, row_number() OVER (PARTITION BY job_id ORDER BY skill) AS rk FROM post JOIN sk ON job_id = k),
jt AS (SELECT job_id, sum(w * w) AS fn, least(count(*), 20) AS tn, least(count(*), 20) AS tc FROM jw GROUP BY 1),
jp AS (SELECT module_id, job_id, any_value(family) AS family, count(*) AS overlap_count, sum(least(mw.w, jw.w)) AS s, sum(mw.w * jw.w) AS d, count(*) FILTER (rk <= 20) AS h FROM mw JOIN jw USING (skill) GROUP BY 1, 2),
js AS (SELECT jp.*, round(round(h / tn * 0.35 + s / (2 - s) * 0.35 + d / sqrt(mn * fn) * 0.3 - (1 - h / tc) * 0.2, 10), 4) AS score FROM jp JOIN jt USING (job_id) JOIN mn USING (module_id) JOIN (SELECT module_id, code AS family FROM top WHERE rank <= 3) USING (module_id, family)),
jr AS (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY score DESC, overlap_count DESC, job_id) AS rank FROM js)
SELECT module_id, family, job_id, overlap_count, score, rank FROM jr WHERE rank <= 10""")
def align_listing_rerank(t):
    _, mine, _, _, top = _aligned(t)
    listings = postings(t).select("job_id", F.left("code5", F.lit(3)).alias("code"), "skills")
    return align.rerank_listings(top, mine, listings)


@query(_align_sql(n=1) + ", ms AS (SELECT module_id, code, skill, row_number() OVER (PARTITION BY module_id, code ORDER BY rk) AS i FROM (SELECT module_id, code FROM top) JOIN fw USING (code) WHERE NOT EXISTS (SELECT 1 FROM mw WHERE mw.module_id = top.module_id AND mw.skill = fw.skill)) SELECT module_id, code, array_to_string(list(skill ORDER BY i), ', ') AS missing FROM ms WHERE i <= 10 GROUP BY 1, 2".replace("(SELECT module_id, code FROM top) JOIN fw", "top JOIN fw"))
def align_missing_skills(t):
    _, _, _, theirs, top = _aligned(t, n=1)
    return align.missing_skills(top, theirs).withColumn("missing", F.array_join("missing", ", "))


@query(f"WITH {_SKILLS}, m AS (SELECT o_orderkey AS k, c_mktsegment AS a, n_name AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O') SELECT tag, skill, count(*) AS cnt FROM (SELECT k, a AS tag FROM m UNION SELECT k, b FROM m) JOIN sk USING (k) GROUP BY 1, 2")
def programme_rollup(t):
    return align.rollup_counts(modules(t).withColumn("tags", F.array("department", "source")), "tags")


def _run_sql(mine: str) -> str:
    """The summary of a run whose modules have the skills of ``mine`` (k, skill)."""
    sql = _align_sql().replace(_SKILLS, f"{_SKILLS}, sk2 AS ({mine})")
    return sql.replace("FROM mods JOIN sk ON module_id = k", "FROM mods JOIN sk2 ON module_id = k").replace("module_id NOT IN (SELECT k FROM sk) AS empty", "module_id NOT IN (SELECT k FROM sk2) AS empty") + _SUMMARY


_BULK = "SELECT DISTINCT l_orderkey AS k, p_brand || ' ' || p_type AS skill FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 25"
_MEASURES = ("module_count", "empty_modules", "top1_positive_modules", "top1_overlap_modules", "top1_positive_rate", "top1_overlap_rate", "average_top1_score", "average_top1_good_job_pct", "average_top1_quality", "average_top3_pct", "job_group_count")


@query(f"WITH a AS ({_run_sql('SELECT * FROM sk')}), b AS ({_run_sql(_BULK)}) " + " UNION ALL ".join(f"SELECT '{m}' AS measure, a.{m}::DOUBLE AS first, b.{m}::DOUBLE AS second, round(b.{m}::DOUBLE - a.{m}::DOUBLE, 4) AS change FROM a, b" for m in _MEASURES))
def run_comparison(t):
    """Two alignments with the same jobs: modules with all their skills, and with those of another
    extractor, which sees lines of 25 pieces or more only."""
    m, _, families, theirs, top = _aligned(t)
    bulk = order_skills(t, t.lineitem.where("l_quantity >= 25"))
    m2 = m.drop("skills").join(bulk, F.col("module_id") == F.col("k"), "left").drop("k")
    top2 = align.top_matches(m2, align.module_skills(m2), families, theirs)
    return benchmark.compare(align.summary(align.module_metrics(m, top), families), align.summary(align.module_metrics(m2, top2), families))


# ---------------------------------------------------------------- jobs

_OCC = "lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || left(o_orderpriority, 1)"


@query(f"""WITH j AS (SELECT o_orderkey AS job_id, {_OCC} || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS ssoc_5d_code, CAST(o_totalprice > 200000 AS INT) AS good FROM orders JOIN customer ON o_custkey = c_custkey),
d AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || p AS code, n_name || ' ' || p AS title FROM nation, (VALUES ('1'), ('2'), ('3'), ('10'), ('21'), ('211'), ('305')) v(p)),
e AS (SELECT job_id, ssoc_5d_code, left(ssoc_5d_code, 4) AS ssoc_4d_code, left(ssoc_5d_code, 3) AS ssoc_3d_code, good, d.title, coalesce(f.title, '') AS four, coalesce(g.title, '') AS five FROM j JOIN d ON left(ssoc_5d_code, 3) = d.code LEFT JOIN d f ON f.code = left(ssoc_5d_code, 4) LEFT JOIN d g ON g.code = ssoc_5d_code)
SELECT job_id, ssoc_3d_code, title AS ssoc_3d_title, ssoc_4d_code, four AS ssoc_4d_title, ssoc_5d_code, five AS ssoc_5d_title, count(*) OVER (PARTITION BY ssoc_3d_code) AS ssoc_3d_total_jobs, sum(good) OVER (PARTITION BY ssoc_3d_code) AS ssoc_3d_good_jobs, round(sum(good) OVER (PARTITION BY ssoc_3d_code) / count(*) OVER (PARTITION BY ssoc_3d_code), 4) AS ssoc_3d_good_job_pct FROM e""")
def ssoc_enrich(t):
    code = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.left("o_orderpriority", F.lit(1)), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"))
    jobs = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("job_id"), code.alias("ssoc_code"), (F.col("o_totalprice") > 200000).cast("int").alias("is_good_job"))
    titles = t.nation.select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("c"), "n_name", F.explode(F.lit(["1", "2", "3", "10", "21", "211", "305"])).alias("p")).select(F.concat("c", "p").alias("code"), F.concat_ws(" ", "n_name", "p").alias("title"))
    return enrich.with_occupation(jobs, titles).drop("ssoc_code", "is_good_job")


@query("SELECT left(c, 3) AS ssoc_3d_code, left(c, 4) AS ssoc_4d_code, c AS ssoc_5d_code, count(*) AS jobs FROM (SELECT " + _OCC + " || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS c FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY ROLLUP (1, 2, 3)")
def ssoc_rollup(t):
    code = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.left("o_orderpriority", F.lit(1)), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"))
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(*[F.left(code, F.lit(n)).alias(f"ssoc_{n}d_code") for n in (3, 4, 5)])
    return enrich.hierarchy_counts(rows)


@query("""WITH r AS (SELECT o_orderkey, c_nationkey AS g, CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN o_totalprice * 9 ELSE o_totalprice END AS v FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT g, count(*) AS n, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, median(v) AS m FROM r GROUP BY 1)
SELECT o_orderkey, g, round(CASE WHEN n >= 10 AND (v IS NULL OR v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) THEN m ELSE v END, 4) AS v FROM r JOIN s USING (g)""")
def salary_outlier_median(t):
    v = F.when(F.col("o_orderkey") % 17 == 0, None).when(F.col("o_orderkey") % 101 == 0, F.col("o_totalprice") * 9).otherwise(F.col("o_totalprice"))
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("g"), v.alias("v"))
    return clean_jobs.outliers_to_median(rows, "v", "g").withColumn("v", F.round("v", 4))


_TYPES = "CASE WHEN o_orderpriority LIKE '4%' THEN 'Unknown' WHEN o_orderkey % 3 = 0 THEN 'Part Time' ELSE 'Full Time' END"


@query(f"""WITH r AS (SELECT o_orderkey, c_nationkey AS g, o_totalprice AS pay, CASE WHEN c_nationkey % 5 = 0 THEN 'Unknown' ELSE {_TYPES} END AS work FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT g, work AS mode FROM (SELECT g, work, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, work) AS n FROM r WHERE work <> 'Unknown' GROUP BY 1, 2) WHERE n = 1),
c AS (SELECT coalesce((median(pay) FILTER (work = 'Full Time') + median(pay) FILTER (work = 'Part Time')) / 2, median(pay)) AS cut FROM r)
SELECT o_orderkey, g, pay, CASE WHEN work <> 'Unknown' THEN work ELSE coalesce(mode, CASE WHEN pay >= cut THEN 'Full Time' ELSE 'Part Time' END) END AS work FROM r LEFT JOIN m USING (g), c""")
def work_type_impute(t):
    work = F.when(F.col("c_nationkey") % 5 == 0, "Unknown").when(F.col("o_orderpriority").startswith("4"), "Unknown").when(F.col("o_orderkey") % 3 == 0, "Part Time").otherwise("Full Time")
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("g"), F.col("o_totalprice").alias("pay"), work.alias("work"))
    return clean_jobs.impute_work_type(rows, "work", "pay", "g")


@query("""WITH r AS (SELECT o_orderkey, o_totalprice * 0.6 + CAST(o_orderstatus = 'P' AS INT) * 0.15 + CAST(o_orderpriority LIKE '1%' AS INT) * 0.15 + (o_orderkey % 5) * 0.1 AS s FROM orders)
SELECT o_orderkey, round(s, 4) AS job_score, round((s - (SELECT min(s) FROM r)) / ((SELECT max(s) FROM r) - (SELECT min(s) FROM r)), 4) AS job_score_normal, CAST(s >= (SELECT quantile_cont(s, 0.7) FROM r) AS INT) AS is_good_job FROM r""")
def job_score_flag(t):
    rows = t.orders.select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "P").alias("flex"), F.col("o_orderpriority").startswith("1").alias("perm"), (F.col("o_orderkey") % 5).alias("vac"))
    out = clean_jobs.job_score(rows, "o_totalprice", "flex", "perm", "vac")
    return out.select("o_orderkey", F.round("job_score", 4).alias("job_score"), F.round("job_score_normal", 4).alias("job_score_normal"), "is_good_job")


@query("""WITH r AS (SELECT event_id, floor(value) AS lo, floor(value * 2) AS hi FROM events), s AS (SELECT event_id, CASE WHEN lo < 100 OR hi < 100 THEN lo * 30 ELSE lo END AS lo, CASE WHEN lo < 100 OR hi < 100 THEN hi * 60 ELSE hi END AS hi FROM r)
SELECT event_id, CAST(lo AS BIGINT) AS salary_minimum, CAST(hi AS BIGINT) AS salary_maximum FROM s WHERE NOT coalesce(lo < 10 OR hi < 10, false)""")
def salary_hourly_scale(t):
    return clean_jobs.scaled_salaries(t.events.select("event_id", F.floor("value").alias("salary_minimum"), F.floor(F.col("value") * 2).alias("salary_maximum")))


_NAMED = {"1-URGENT": "Permanent", "2-HIGH": "Contract", "3-MEDIUM": "Full Time", "4-NOT SPECIFIED": "Other", "5-LOW": "Part Time"}
_NAMED_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMED.items()) + " END"


@query(f"""WITH l AS (SELECT o_custkey, list({_NAMED_SQL} ORDER BY o_orderkey) AS x FROM orders GROUP BY 1),
p AS (SELECT o_custkey, CASE WHEN list_contains(x, 'Permanent') THEN 'Permanent' WHEN list_contains(x, 'Contract') THEN 'Contract' ELSE 'Unknown' END AS c, coalesce(list_filter(x, lambda v: v IN ('Full Time', 'Part Time'))[1], 'Unknown') AS w FROM l)
SELECT o_custkey, c AS contract_type, CASE WHEN w = 'Unknown' AND c = 'Permanent' THEN 'Full Time' ELSE w END AS work_type FROM p WHERE NOT (c = 'Unknown' AND w = 'Unknown')""")
def contract_type_priority(t):
    names = F.create_map(*[F.lit(v) for kv in _NAMED.items() for v in kv])
    listed = t.orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.element_at(names, F.col("o_orderpriority")).alias("n")))), lambda s: s["n"]).alias("employment_types"))
    return clean_jobs.types_of_work(listed).drop("employment_types")


_POSTS = ["Intern, kitchen", "Internal auditor", "Research Fellow", "Professor of law", "Clerk", "Sales internships"]
_NEEDS = ["", " PhD required", " Requirements: a strong record and a Master's degree.", " master plan", " A doctorate is no requirement"]


@query(f"""WITH d AS (SELECT doc_id % 4 AS y, lower(source || ' ' || {_POSTS!r}[CAST(doc_id % 6 AS INT) + 1]) AS ti, lower(text || ' ' || {str(_NEEDS).replace(chr(34) + ' Requirements', chr(39) + ' Requirements').replace('degree.' + chr(34), 'degree.' + chr(39)).replace("Master's", "Master''s")}[CAST(doc_id % 5 AS INT) + 1]) AS de, [lang, CASE WHEN doc_id % 9 = 0 THEN 'Internship/Attachment' END] AS ty, text FROM documents),
f AS (SELECT coalesce(y IN (0, 1), false) AS a, ti IS NOT NULL AND text IS NOT NULL AND trim(de) <> '' AND len(regexp_split_to_array(trim(regexp_replace(de, '\\s+', ' ', 'g')), ' ')) >= 10 AS b,
  NOT coalesce(regexp_matches(ti, '\\bintern(?:ship)?s?\\b') OR regexp_matches(de, '\\bintern(?:ship)?s?\\b') OR len(list_filter(ty, lambda v: contains(lower(v), 'intern'))) > 0
    OR regexp_matches(ti, '\\b(?:postdoc(?:toral)?|research fellow|senior research fellow|assistant professor|associate professor|professor|lecturer|medical doctor)\\b')
    OR regexp_matches(de, '(?:require(?:ment|s|d)?|minimum|preferred|qualification|qualifications|possess|holding|hold|must have|with|degree in).{{0,120}}\\b(?:ph\\.?d|doctor(?:al|ate)|master(?:''s)? degree|masters degree|master degree|postgraduate|graduate diploma|graduate certificate)\\b'), false) AS c FROM d)
SELECT count(*) AS raw, count(*) FILTER (a) AS after_experience, count(*) FILTER (a AND b) AS after_description, count(*) FILTER (a AND b AND c) AS after_undergraduate FROM f""")
def jobs_filter_chain(t):
    pick = lambda values: F.element_at(F.lit(values), (F.col("doc_id") % len(values) + 1).cast("int"))
    types = F.array("lang", F.when(F.col("doc_id") % 9 == 0, "Internship/Attachment"))
    rows = t.documents.select(F.concat_ws(" ", "source", pick(_POSTS)).alias("title"), F.concat("text", F.lit(" "), pick(_NEEDS)).alias("description"), (F.col("doc_id") % 4).cast("int").alias("minimum_years_experience"), types.alias("employment_types"))
    return clean_jobs.attrition(rows, clean_jobs.filters())


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_keep_first(t):
    return clean_jobs.first_of(t.documents, ["text"], ["doc_id"]).select("doc_id", "lang")


_WORDS_SQL = "list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) > 3))"


@query(f"""WITH d AS (SELECT doc_id, list_sort({_WORDS_SQL}) AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS s FROM d), o AS (SELECT s FROM e GROUP BY 1 HAVING count(*) >= 3),
k AS (SELECT doc_id, s FROM e JOIN o USING (s)) SELECT doc_id, md5(string_agg(s, ' ' ORDER BY s)) AS skills_md5, CAST(count(*) AS INT) AS num_skills FROM k GROUP BY 1 HAVING count(*) >= 3""")
def skill_freq_filter(t):
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 3)))
    out = clean_jobs.frequent_skills(t.documents.select("doc_id", words.alias("skills_clean")), "doc_id")
    return out.select("doc_id", F.md5(F.array_join("skills_clean", " ").cast("binary")).alias("skills_md5"), "num_skills")


_SKILL_SQL = "trim(regexp_replace(regexp_replace(replace(lower(trim(x)), '&', 'and'), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Team Player' WHEN 1 THEN 'Risk Management' WHEN 2 THEN p_name || ' & Communication Skills!' WHEN 3 THEN p_type || ' Skills' WHEN 4 THEN '  ' ELSE p_name || '  R&D' END AS x FROM part), s AS (SELECT p_partkey, {_SKILL_SQL} AS s FROM p)
SELECT p_partkey, CASE WHEN s IN ('', 'team player') THEN NULL WHEN s = 'risk management' THEN s WHEN contains(s, 'communication') THEN 'communication' ELSE nullif(trim(regexp_replace(regexp_replace(s, '\\bskills\\b', '', 'g'), '\\s+', ' ', 'g')), '') END AS skill FROM s""")
def skill_normalize(t):
    k = F.col("p_partkey") % 6
    raw = F.when(k == 0, "Team Player").when(k == 1, "Risk Management").when(k == 2, F.concat("p_name", F.lit(" & Communication Skills!"))).when(k == 3, F.concat("p_type", F.lit(" Skills"))).when(k == 4, "  ").otherwise(F.concat("p_name", F.lit("  R&D")))
    return t.part.select("p_partkey", text.job_skill(raw).alias("skill"))


@query()
def fuzzy_dedup(t):
    names = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    return names.select("l_orderkey", F.size("names").alias("n"), fuzzy.near_distinct("names").alias("kept"))


# ---------------------------------------------------------------- exploration


@query("SELECT p_type, count(*) AS cnt FROM part GROUP BY 1")
def value_counts_type(t):
    return explore.value_counts(t.part, "p_type")


@query("SELECT event_type, count(*) AS cnt FROM events GROUP BY 1")
def value_counts_event(t):
    return explore.value_counts(t.events, "event_type")


@query(f"WITH {_SKILLS} SELECT skill AS value, count(*) AS cnt FROM sk GROUP BY 1")
def value_counts_skill(t):
    return explore.exploded_counts(order_skills(t), "skills")


@query("SELECT count(value) AS cnt, round(avg(value), 4) AS mean, round(stddev(value), 4) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q3, max(value) AS max FROM events")
def describe_value(t):
    return explore.describe(t.events, "value")


@query("SELECT p_name, count(*) AS cnt, round(avg(p_retailprice), 4) AS mean, round(median(p_retailprice), 4) AS median, min(p_retailprice) AS min, max(p_retailprice) AS max FROM part GROUP BY 1")
def multi_agg_title(t):
    return explore.group_stats(t.part, "p_name", "p_retailprice")


@query("SELECT p_name, count(*) AS postings, count(DISTINCT w) AS unique_skills FROM (SELECT p_name, p_partkey, unnest(list_value(p_brand, p_type, p_brand || p_type)) AS w FROM part) GROUP BY 1".replace("count(*)", "count(DISTINCT p_partkey)"))
def unique_skills_per_title(t):
    return explore.distinct_values(t.part.select("p_name", F.array("p_brand", "p_type", F.concat("p_brand", "p_type")).alias("v")), "p_name", "v")


@query("""WITH r AS (SELECT n_name, p_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey), c AS (SELECT n_name, p_name, count(*) AS cnt FROM r GROUP BY 1, 2),
g AS (SELECT n_name, sum(cnt) AS total, row_number() OVER (ORDER BY sum(cnt) DESC, n_name) AS group_rank FROM c GROUP BY 1), i AS (SELECT c.*, g.total, g.group_rank, row_number() OVER (PARTITION BY n_name ORDER BY cnt DESC, p_name) AS item_rank FROM c JOIN g USING (n_name) WHERE group_rank <= 10)
SELECT n_name, p_name, cnt, CAST(total AS BIGINT) AS total, group_rank, item_rank FROM i WHERE item_rank <= 10""")
def top_titles_top_skills(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return explore.top_within_top(rows.select("n_name", "p_name"), "n_name", "p_name")


@query("SELECT n_name, o_orderpriority, count(*) AS cnt, count(*) < 10 AS rare FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def rare_combo(t):
    return explore.rare_pairs(_owned(t), "n_name", "o_orderpriority")


_TITLES = ["Senior Data Analyst", "Database Clerk", "Head of Business Intelligence", "ML Engineer (green)", "Research Analysts", "Analytics lead", "BI Developer", "Waiter"]


@query(f"""WITH t AS (SELECT p_partkey, p_name || ' ' || {_TITLES!r}[CAST(p_partkey % 8 AS INT) + 1] AS title FROM part)
SELECT * FROM t WHERE regexp_matches(lower(title), 'data analyst|data analytics|data scientist|data science|data engineer|business analyst|business intelligence|bi analyst|bi developer|machine learning|ml engineer|ai engineer|artificial intelligence|analytics engineer|research analyst')""")
def keyword_subset(t):
    named = F.concat_ws(" ", "p_name", F.element_at(F.lit(_TITLES), (F.col("p_partkey") % 8 + 1).cast("int")))
    return explore.having_keyword(t.part.select("p_partkey", named.alias("title")), "title")


@query("""WITH b AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42')) AS p FROM documents), q AS (SELECT greatest(1, floor(36 / count(DISTINCT lang))) AS q FROM documents)
SELECT doc_id, lang, CASE WHEN p <= q THEN 'quota' ELSE 'fill' END AS picked FROM b, q ORDER BY 3 DESC, md5(doc_id || ':42') LIMIT 36""")
def stratified_sample(t):
    return explore.stratified(t.documents.select("doc_id", "lang"), "lang", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42")).cast("binary")), 36)


@query()
def seeded_sample(t):
    return explore.sampled(t.documents.select("doc_id"), "doc_id", 100)


# ---------------------------------------------------------------- courses and sources


@query("SELECT row_number() OVER (ORDER BY university, code) AS serial, university, code, name, segment FROM (SELECT 'S' AS university, s_suppkey AS code, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT 'C', c_custkey, c_name, c_mktsegment FROM customer)")
def union_sources(t):
    s = t.supplier.select(F.lit("S").alias("university"), F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"))
    c = t.customer.select(F.lit("C").alias("university"), F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return serial.numbered(s.unionByName(c, allowMissingColumns=True), "university", "code")


@query("SELECT s_suppkey, s_name, n_name AS department FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def dept_left_join(t):
    dim = t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("department"))
    return t.supplier.join(F.broadcast(dim), F.col("s_nationkey") == F.col("k"), "left").select("s_suppkey", "s_name", "department")


@query("SELECT doc_id, CASE WHEN quality IS NOT NULL AND quality = 1 THEN 'good' WHEN regexp_matches(text, 'th') THEN 'th' ELSE '' END AS skills FROM documents LEFT JOIN labels USING (doc_id)")
def reuse_then_fallback(t):
    none = F.array().cast("array<string>")
    both = t.documents.join(t.labels, "doc_id", "left")
    reused = F.when(F.col("quality") == 1, F.array(F.lit("good"))).otherwise(none)
    found = F.when(F.col("text").rlike("th"), F.array(F.lit("th"))).otherwise(none)
    return both.select("doc_id", F.array_join(extract.first_source(reused, found), ",").alias("skills"))


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_matches(upper(trim(replace(p_brand, '#', ''))), '^[A-Z]+[0-4]')")
def undergrad_code_filter(t):
    return t.part.where(clean_courses.undergraduate_code(F.replace("p_brand", F.lit("#"), F.lit("")))).select("p_partkey", "p_brand")


def _spelling_sql(x: str) -> str:
    for a in ("optimisation/optimization", "organisation/organization", "behaviour/behavior", "labour/labor", "analyse/analyze", "analysing/analyzing", "modelling/modeling", "colour/color", "favour/favor", "centre/center", "theatre/theater", "programme/program"):
        x = f"replace({x}, '{a.split('/')[0]}', '{a.split('/')[1]}')"
    return x


_BRITISH = "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN ' Analysing colour and labour: an exercise.' WHEN 1 THEN ' Optimisation programme of the organisation, modelling behaviour' WHEN 2 THEN ' A favour at the theatre centre; promise to analyse' ELSE '' END"


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(" + _spelling_sql(f"trim(regexp_replace(text || {_BRITISH}, '\\s+', ' ', 'g'))") + ", '[\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F]', ' ', 'g'), '\\s+', ' ', 'g'))) AS clean_md5 FROM documents")
def text_clean_course(t):
    k = F.col("doc_id") % 4
    more = F.when(k == 0, " Analysing colour and labour: an exercise.").when(k == 1, " Optimisation programme of the organisation, modelling behaviour").when(k == 2, " A favour at the theatre centre; promise to analyse").otherwise("")
    return t.documents.select("doc_id", F.md5(clean_courses.cleaned(F.concat("text", more)).cast("binary")).alias("clean_md5"))


@query("SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '[.;:]\\s+|\\n+'), lambda x: trim(x)), lambda x: x <> '')) AS n_chunks, len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> '')) AS n_sentences FROM documents")
def chunk_split(t):
    return t.documents.select("doc_id", F.size(text.chunks("text")).alias("n_chunks"), F.size(text.sentences("text")).alias("n_sentences"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_md5 FROM pages")
def html_strip_tags(t):
    return t.pages.select("page_id", F.md5(text.strip_tags("html").cast("binary")).alias("text_md5"))


@query()
def html_to_text(t):
    return t.pages.select("page_id", fuzzy.html_text("html").alias("text"))


@query()
def html_records(t):
    return readers.page_records(t.pages)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_props(t):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# ---------------------------------------------------------------- extraction and mapping

_VOCABULARY = [*values.COURSE_HARD_SKILLS, *values.COURSE_SOFT_SKILLS, "the", "that", "with", "tion", "les", "und", "que", "for", "th", "of the"]


@query("""WITH c AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(lower(text), '[.;:]\\s+|\\n+'), lambda x: trim(x)), lambda x: x <> '')) AS chunk FROM documents),
v AS (SELECT DISTINCT unnest([""" + ", ".join(f"'{v}'" for v in _VOCABULARY) + """]) AS skill), w AS MATERIALIZED (SELECT doc_id, skill FROM documents, v WHERE contains(lower(text), skill)),
h AS (SELECT doc_id, skill, count(*) AS hits FROM w JOIN c USING (doc_id) WHERE regexp_matches(chunk, '(^|[^a-z0-9])' || regexp_escape(skill) || '([^a-z0-9]|$)') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, len(string_split(skill, ' ')) DESC, length(skill) DESC, skill) AS rank FROM h) SELECT doc_id, skill, hits, rank FROM r WHERE rank <= 5""")
def keyword_skills(t):
    """The course vocabulary, and words that the texts are full of."""
    return patterns.keyword_skills(t.documents, "doc_id", "text", t.spark.createDataFrame([(v,) for v in _VOCABULARY], "skill string"))


_RULES = [(("the", "that"), ("English",)), (("und", "der"), ("German",)), (("les", "une"), ("French",)), (("los", "que"), ("Spanish", "Romance")), (("que", "les"), ("Romance",))]


def _rule_sql(p: str) -> str:
    return f"regexp_matches(lower(text), '(^|[^a-z0-9_]){p}([^a-z0-9_]|$)')"


_RULE_LIST = "list_concat(" + ", ".join(f"CASE WHEN {' OR '.join(map(_rule_sql, ps))} THEN [{', '.join(repr(s) for s in ss)}] ELSE [] END" for ps, ss in _RULES) + ")"


@query(f"SELECT doc_id, array_to_string(list_distinct_keep, ',') AS skills FROM (SELECT doc_id, list_filter(x, lambda v, i: list_position(x, v) = i) AS list_distinct_keep FROM (SELECT doc_id, {_RULE_LIST} AS x FROM documents))")
def rule_skills(t):
    return t.documents.select("doc_id", F.array_join(extract.rule_hits("text", _RULES), ",").alias("skills"))


@query(f"""SELECT doc_id, array_to_string(list_slice(list_filter(x, lambda v, i: list_position(k, lower(v)) = i), 1, 4), ',') AS skills
FROM (SELECT doc_id, x, list_transform(x, lambda v: lower(v)) AS k FROM (SELECT doc_id, list_concat([upper(lang), lang, source], {_RULE_LIST}) AS x FROM documents))""")
def merge_topk(t):
    return t.documents.select("doc_id", F.array_join(extract.merged(F.array(F.upper("lang"), "lang", "source"), extract.rule_hits("text", _RULES), n=4), ",").alias("skills"))


_STOP_SQL = "'a', 'abilities', 'ability', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'course', 'courses', 'entry', 'find', 'for', 'from', 'full', 'i', 'in', 'into', 'is', 'job', 'jobs', 'level', 'looking', 'me', 'module', 'modules', 'more', 'most', 'of', 'on', 'or', 'over', 'part', 'pay', 'paying', 'please', 'relevant', 'role', 'roles', 'salary', 'show', 'skill', 'skills', 'that', 'the', 'than', 'time', 'to', 'under', 'use', 'used', 'uses', 'using', 'want', 'what', 'which', 'with'"


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND w NOT IN ({_STOP_SQL})) AS w FROM documents),
g AS (SELECT doc_id, w, unnest(generate_series(1, 3)) AS n FROM w), e AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS c FROM g WHERE len(w) >= n)
SELECT doc_id, count(DISTINCT c) AS n, md5(string_agg(DISTINCT c, '|' ORDER BY c)) AS c_md5 FROM e GROUP BY 1""")
def ngram_candidates(t):
    out = extract.candidates(t.documents, "doc_id", "text", most_chars=None)
    return out.where(F.size("candidates") > 0).select("doc_id", F.size("candidates").cast("long").alias("n"), F.md5(F.array_join("candidates", "|").cast("binary")).alias("c_md5"))


_KEY_SQL = "regexp_replace(trim(regexp_replace(lower(x), '\\s+', ' ', 'g')), '^[^a-z0-9+#/]+|[^a-z0-9+#/]+$', '', 'g')"


@query("""WITH p AS (SELECT DISTINCT lower(unnest([p_type, p_brand, split_part(p_name, ' ', 1)])) AS key FROM part),
a AS (SELECT * FROM (VALUES ('economy', 'Alpha'), ('standard', 'Alpha'), ('standard', 'Beta'), ('economy', 'Gamma'), ('promo', 'Gamma')) AS v(alias, skill))
SELECT key, max(skill) AS canonical_skill, count(*) AS n_skills FROM p JOIN a ON key = alias GROUP BY 1""")
def alias_collision(t):
    """An alias of several skills means the last of them by name."""
    f = mapping.Framework()
    for skill, aliases in {"Alpha": ["economy", "standard"], "Beta": ["standard"], "Gamma": ["economy", "promo"]}.items():
        f.add(skill, "hard", aliases)
    skills, aliases, excluded = f.tables(t.spark)
    phrases = t.part.select(F.explode(F.array("p_type", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("phrase"))
    mapped = mapping.map_phrases(phrases, skills, aliases, excluded).where("match_type = 'exact'")
    n = aliases.groupBy("alias").agg(F.count("*").alias("n_skills"))
    return mapped.join(n, F.col("key") == F.col("alias")).select("key", "canonical_skill", "n_skills")


@query("SELECT p_type AS skill, count(*) AS cnt FROM part GROUP BY 1 ORDER BY cnt DESC, skill LIMIT 4")
def frequent_vocabulary(t):
    return mapping.frequent_vocabulary(t.part.select(F.array("p_type").alias("skills")), n=4)


_CENTROIDS = """x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(generate_series(1, len(embedding))) AS i FROM embeddings),
m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY 1, 2), c AS (SELECT label, i, v / sqrt(sum(v * v) OVER (PARTITION BY label)) AS v FROM m)"""


@query(f"WITH {_CENTROIDS}, s AS (SELECT x.vec_id, c.label, round(sum(x.v * c.v), 6) AS score FROM x JOIN c USING (i) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS n FROM s) SELECT vec_id, CASE WHEN score >= 0.5 THEN label END AS label, round(score, 4) AS score FROM r WHERE n = 1")
def semantic_argmax(t):
    prototypes = embed.centroids(t.embeddings, "embedding", "label")
    return embed.arg_max(t.embeddings, prototypes, "embedding", "vec_id", "label", least=0.5).withColumn("score", F.round("score", 4))


def _votes(t: Tables) -> DataFrame:
    words = F.filter(F.split(text.search_key("text"), " "), lambda w: F.length(w) > 3)
    part = lambda name, x: t.documents.select("doc_id", F.lit(name).alias("extractor"), F.posexplode(x).alias("pos", "skill"))
    first = part("first", F.array_distinct(words))
    last = part("last", F.array_distinct(F.reverse(words)))
    long = part("long", F.array_distinct(F.filter(words, lambda w: F.length(w) > 6)))
    return first.unionAll(last).unionAll(long)


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 3) AS w FROM documents),
p AS (SELECT doc_id, w, list_reverse(w) AS r, list_filter(w, lambda v: length(v) > 6) AS l FROM w),
a AS (SELECT doc_id, 'a' AS e, w AS s FROM p UNION ALL SELECT doc_id, 'b', r FROM p UNION ALL SELECT doc_id, 'c', l FROM p),
f AS (SELECT doc_id, e, skill, min(i) AS i FROM (SELECT doc_id, e, unnest(s) AS skill, unnest(generate_series(1, len(s))) AS i FROM a) GROUP BY 1, 2, 3),
u AS (SELECT doc_id, e, skill, row_number() OVER (PARTITION BY doc_id, e ORDER BY i) - 1 AS pos FROM f), c AS (SELECT doc_id, skill, count(DISTINCT e) AS support, min(pos) AS place FROM u GROUP BY 1, 2 HAVING count(DISTINCT e) >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY support DESC, place, skill) AS rank FROM c) SELECT doc_id, skill, support, rank FROM k WHERE rank <= 10""")
def consensus_merge(t):
    return extract.consensus(_votes(t), "doc_id")


@query("""WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents), g AS (SELECT doc_id, w, unnest([1, 2]) AS n FROM d),
e AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase FROM g WHERE len(w) >= n),
c AS (SELECT phrase, count(*) AS freq, count(DISTINCT doc_id) AS docs FROM e GROUP BY 1) SELECT phrase, freq, docs, round(freq * (1 + ln(1 + len(string_split(phrase, ' ')))), 6) AS specificity FROM c WHERE freq >= 5 AND docs <= 0.12 * (SELECT count(*) FROM documents)""")
def seed_phrases(t):
    counts = rules.phrase_counts(t.documents, F.split(text.search_key("text"), " "), 1, 2)
    return rules.seeds(counts, t.documents)


@query("""WITH c AS (SELECT lang AS skill, source AS phrase, count(*) AS freq FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY freq DESC, phrase) AS i FROM c),
g AS (SELECT skill, sum(freq) AS support, string_agg(phrase, ',' ORDER BY i) FILTER (i <= 6) AS patterns, count(*) AS n FROM r GROUP BY 1) SELECT row_number() OVER (ORDER BY support DESC, skill) AS rule_id, skill, patterns, support FROM g WHERE n >= 2""")
def rule_build(t):
    grouped = t.documents.groupBy(F.col("lang").alias("skill"), F.col("source").alias("phrase")).agg(F.count("*").alias("freq"))
    return rules.build(grouped).withColumn("patterns", F.array_join("patterns", ","))


@query()
def mmr_phrases(t):
    return extract.ranked_ngrams(t.documents, "doc_id", "text", embed.HashingEmbedder(128), n=5, diversity=0.8, most_chars=None)


@query()
def phrase_clusters(t):
    seeds = t.part.groupBy(F.col("p_name").alias("phrase")).agg(F.count("*").alias("freq"))
    return clusters.phrase_clusters(embed.vectors(seeds, "phrase", embed.HashingEmbedder()), "phrase", "freq", "v")


# ---------------------------------------------------------------- scope

_PATTERNS = {"strong": ("(^|[^a-z0-9_])the([^a-z0-9_]|$)", "(^|[^a-z0-9_])und([^a-z0-9_]|$)"), "weak": ("(^|[^a-z0-9_])that([^a-z0-9_]|$)", "(^|[^a-z0-9_])with([^a-z0-9_]|$)"), "blocked": ("(^|[^a-z0-9_])clown([^a-z0-9_]|$)",), "against": ("(^|[^a-z0-9_])of([^a-z0-9_]|$)",)}


def _signal_sql(x: str = "lower(coalesce(text, ''))") -> str:
    return f"CASE WHEN regexp_matches({x}, '(^|[^a-z0-9_])clown([^a-z0-9_]|$)') THEN 0 ELSE 2 * (regexp_matches({x}, '(^|[^a-z0-9_])the([^a-z0-9_]|$)')::INT + regexp_matches({x}, '(^|[^a-z0-9_])und([^a-z0-9_]|$)')::INT) + regexp_matches({x}, '(^|[^a-z0-9_])that([^a-z0-9_]|$)')::INT + regexp_matches({x}, '(^|[^a-z0-9_])with([^a-z0-9_]|$)')::INT END"


_STEM_SQL = f"({_signal_sql()} >= 3 AND NOT (regexp_matches(lower(text), '(^|[^a-z0-9_])the([^a-z0-9_]|$)')::INT + regexp_matches(lower(text), '(^|[^a-z0-9_])und([^a-z0-9_]|$)')::INT <= 1 AND regexp_matches(lower(text), '(^|[^a-z0-9_])of([^a-z0-9_]|$)')))"


@query(f"SELECT doc_id, {_signal_sql()} AS signal, {_STEM_SQL} AS stem FROM documents")
def keyword_signal(t):
    signal = {k: _PATTERNS[k] for k in ("strong", "weak", "blocked")}
    return t.documents.select("doc_id", scope.keyword_signal("text", **signal).alias("signal"), scope.keyword_stem("text", 3, **_PATTERNS).alias("stem"))


_SIMS = f"WITH {_CENTROIDS}, s AS (SELECT x.vec_id, sum(x.v * a.v) AS one, sum(x.v * b.v) AS other FROM x JOIN c a ON a.i = x.i AND a.label = 0 JOIN c b ON b.i = x.i AND b.label = 1 GROUP BY 1)"


def _sides(t: Tables) -> DataFrame:
    prototypes = embed.centroids(t.embeddings, "embedding", "label")
    return scope.document_margin(t.embeddings, "embedding", prototypes, "label", 0, 1).select("vec_id", F.col("stem_similarity").alias("one"), F.col("non_stem_similarity").alias("other"), "margin")


_VOTES = "v AS (SELECT vec_id % 50 AS k, count(*) FILTER (one - other >= 0.04) AS support_count, count(*) FILTER (one - other <= -0.04) AS oppose_count, count(*) AS total_sentences, round(avg(one - other), 6) AS avg_margin, round(max(one), 6) AS max_stem_similarity FROM s GROUP BY 1)"


@query(f"{_SIMS}, {_VOTES} SELECT k, support_count, oppose_count, total_sentences, round(avg_margin, 4) AS avg_margin, round(max_stem_similarity, 4) AS max_stem_similarity, round(support_count / (support_count + oppose_count + 1e-9), 4) AS confidence FROM v")
def sentence_votes(t):
    out = scope.sentence_votes(_sides(t).withColumn("k", F.col("vec_id") % 50), "k", "one", "other")
    return out.select("k", "support_count", "oppose_count", "total_sentences", *[F.round(c, 4).alias(c) for c in ("avg_margin", "max_stem_similarity", "confidence")])


def _cascade(t: Tables) -> DataFrame:
    sides = _sides(t)
    votes = scope.sentence_votes(sides.withColumn("k", F.col("vec_id") % 50), "k", "one", "other").select("k", (F.col("support_count") - F.col("oppose_count")).alias("votes"))
    docs = t.documents.select("doc_id", "source", scope.keyword_stem("text", 3, **_PATTERNS).alias("word"))
    rows = sides.join(docs, F.col("vec_id") == F.col("doc_id")).withColumn("k", F.col("vec_id") % 50).join(votes, "k")
    base = scope.bucket("source", ["src0", "src1"], ["src2"])
    rows = rows.withColumn("base", base).withColumn("why", F.concat(F.lit("metadata_"), F.col("base")))
    bucket, reason = scope.cascade("base", "why", F.round("margin", 6), "votes", "word")
    return rows.select("doc_id", bucket.alias("scope_bucket"), reason.alias("scope_reason")).withColumn("path", scope.path("scope_bucket", "scope_reason"))


_CASCADE_SQL = f"""{_SIMS}, {_VOTES}, r AS (SELECT doc_id, round(one - other, 6) AS m, support_count - oppose_count AS votes, {_STEM_SQL} AS word, CASE WHEN source IN ('src0', 'src1') THEN 'clear_stem' WHEN source = 'src2' THEN 'clear_non_stem' ELSE 'unclear_or_mixed' END AS base FROM s JOIN documents ON vec_id = doc_id JOIN v ON v.k = vec_id % 50),
q AS (SELECT doc_id, base, CASE WHEN base = 'clear_stem' THEN 'metadata_clear_stem' WHEN m <= -0.02 THEN 'paragraph_semantic_non_stem_guard' WHEN m >= 0.06 THEN 'paragraph_semantic_stem_override' WHEN m >= 0 AND votes >= 1 THEN 'stem_semantic_sentence_override' WHEN word THEN 'stem_keyword_override' ELSE 'metadata_' || base END AS scope_reason FROM r),
o AS (SELECT doc_id, CASE WHEN scope_reason LIKE '%override' THEN 'clear_stem' ELSE base END AS scope_bucket, scope_reason, CASE scope_reason WHEN 'paragraph_semantic_stem_override' THEN 'paragraph_stem' WHEN 'paragraph_semantic_non_stem_guard' THEN 'paragraph_non_stem' WHEN 'stem_semantic_sentence_override' THEN 'sentence_stem' WHEN 'stem_keyword_override' THEN 'keyword_stem' WHEN 'metadata_clear_stem' THEN 'metadata_stem' ELSE 'keyword_remainder' END AS path FROM q)"""


@query(_CASCADE_SQL + " SELECT * FROM o")
def scope_cascade(t):
    return _cascade(t)


_FLOW = [
    ("All Modules", "Metadata clear STEM", ["metadata_stem"]),
    ("All Modules", "Enter semantic pipeline", ["paragraph_stem", "paragraph_non_stem", "sentence_stem", "keyword_stem", "keyword_remainder"]),
    ("Enter semantic pipeline", "Paragraph STEM override", ["paragraph_stem"]),
    ("Enter semantic pipeline", "Paragraph non-STEM guard", ["paragraph_non_stem"]),
    ("Enter semantic pipeline", "Enter sentence stage", ["sentence_stem", "keyword_stem", "keyword_remainder"]),
    ("Enter sentence stage", "Sentence STEM override", ["sentence_stem"]),
    ("Enter sentence stage", "Enter keyword fallback", ["keyword_stem", "keyword_remainder"]),
    ("Enter keyword fallback", "Keyword STEM override", ["keyword_stem"]),
    ("Enter keyword fallback", "Remain non-STEM or mixed", ["keyword_remainder"]),
    ("Metadata clear STEM", "Final STEM", ["metadata_stem"]),
    ("Paragraph STEM override", "Final STEM", ["paragraph_stem"]),
    ("Sentence STEM override", "Final STEM", ["sentence_stem"]),
    ("Keyword STEM override", "Final STEM", ["keyword_stem"]),
    ("Paragraph non-STEM guard", "Final non-STEM", ["paragraph_non_stem"]),
    ("Remain non-STEM or mixed", "Final non-STEM", ["keyword_remainder"]),
]


@query(_CASCADE_SQL + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS source, '{b}' AS target, count(*) AS value FROM o WHERE path IN ({', '.join(map(repr, p))})" for a, b, p in _FLOW) + ") WHERE value > 0")
def scope_flow_edges(t):
    return scope.flow_edges(_cascade(t))


@query(_CASCADE_SQL + """ SELECT count(*) AS total, count(*) FILTER (path = 'metadata_stem') AS metadata_stem, count(*) FILTER (path = 'excluded_non_stem') AS excluded_non_stem, count(*) FILTER (path = 'paragraph_stem') AS paragraph_stem, count(*) FILTER (path = 'paragraph_non_stem') AS paragraph_non_stem, count(*) FILTER (path = 'sentence_stem') AS sentence_stem, count(*) FILTER (path = 'keyword_stem') AS keyword_stem, count(*) FILTER (path = 'keyword_remainder') AS keyword_remainder,
count(*) FILTER (path NOT IN ('metadata_stem', 'excluded_non_stem')) AS semantic_entry, count(*) FILTER (path IN ('sentence_stem', 'keyword_stem', 'keyword_remainder')) AS sentence_entry, count(*) FILTER (path IN ('keyword_stem', 'keyword_remainder')) AS keyword_entry, count(*) FILTER (scope_bucket = 'clear_stem') AS final_stem, count(*) FILTER (scope_bucket <> 'clear_stem') AS final_non_stem FROM o""")
def scope_path_counts(t):
    return scope.path_counts(_cascade(t))


@query(f"""WITH b AS (SELECT doc_id, text, lang, CASE WHEN source IN ('src0', 'src1') THEN 'clear_stem' WHEN source = 'src2' THEN 'clear_non_stem' ELSE 'unclear_or_mixed' END AS base, CASE lang WHEN 'de' THEN 'Computing' WHEN 'fr' THEN 'Law School' ELSE 'Other' END AS dept FROM documents),
f AS (SELECT doc_id, text, CASE WHEN base = 'unclear_or_mixed' AND dept = 'Computing' THEN 'clear_stem' WHEN base = 'unclear_or_mixed' AND dept = 'Law School' THEN 'clear_non_stem' ELSE base END AS first, base FROM b)
SELECT doc_id, CASE WHEN first <> 'clear_stem' AND {_signal_sql()} >= 3 THEN 'quant_non_stem' ELSE first END AS scope_bucket FROM f""")
def scope_earlier(t):
    dept = F.when(F.col("lang") == "de", "Computing").when(F.col("lang") == "fr", "Law School").otherwise("Other")
    signal = {k: _PATTERNS[k] for k in ("strong", "weak", "blocked")}
    got, _ = scope.earlier_cascade(scope.bucket("source", ["src0", "src1"], ["src2"]), F.lit("metadata"), dept, "text", 3, **signal)
    return t.documents.select("doc_id", got.alias("scope_bucket"))


@query("SELECT DISTINCT source AS value, CASE WHEN source IN ('src0', 'src1') THEN 'clear_stem' ELSE 'unclear_or_mixed' END AS bucket FROM documents")
def scope_reference_lists(t):
    return scope.reference_lists(t.documents, "source", ["src0", "src1"], ["src2"])


@query("""WITH x AS (SELECT p_partkey, lower(trim(CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN 'Etc' WHEN 1 THEN ' N/A ' WHEN 2 THEN 'Others' WHEN 3 THEN left(p_name, 1) WHEN 4 THEN 'skilled ' || p_name WHEN 5 THEN repeat(p_type, 12) WHEN 6 THEN NULL ELSE p_name END)) AS s FROM part)
SELECT p_partkey, coalesce(length(s) >= 2 AND length(s) <= 60 AND s NOT IN ('etc', 'other', 'others', 'n/a', 'na', 'skill', 'skills', 'knowledge'), false) AS named FROM x""")
def skill_drop_patterns(t):
    k = F.col("p_partkey") % 8
    raw = F.when(k == 0, "Etc").when(k == 1, " N/A ").when(k == 2, "Others").when(k == 3, F.left("p_name", F.lit(1))).when(k == 4, F.concat(F.lit("skilled "), "p_name")).when(k == 5, F.repeat("p_type", F.lit(12))).when(k != 6, F.col("p_name"))
    return t.part.select("p_partkey", text.named_skill(raw).alias("named"))


# ---------------------------------------------------------------- search

_QUERY = "full time green metal the and that role above 3k"


def _jobs(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("uuid"),
        text.search_key("p_name").alias("title_norm"),
        text.tokens("p_name").alias("title_tokens"),
        text.tokens("p_type").alias("description_tokens"),
        text.tokens("p_brand").alias("category_tokens"),
        F.array_distinct(F.array(text.search_key("p_type"), text.search_key("p_brand"))).alias("skill_set"),
        F.when(F.col("p_size") % 2 == 0, "Full Time").otherwise("Part Time").alias("work_type"),
        (F.col("p_size") % 4).alias("minimum_years_experience"),
        (F.col("p_retailprice") * 2).alias("salary_minimum"),
        (F.col("p_retailprice") * 3).alias("salary_maximum"),
        (F.col("p_retailprice") * 2.5).alias("avg_salary"),
    )


def _found(t: Tables) -> tuple[search.Intent, DataFrame]:
    intent = search.interpret(f"full time {_TITLE} economy brand 3 above 3k", ["economy", "brand 3", "standard"])
    return intent, search.search_jobs(_jobs(t), intent)


_TITLE = "green"
_TOK = "list_filter(string_split({0}, ' '), lambda w: length(w) > 1 AND w NOT IN (" + _STOP_SQL + ") AND NOT regexp_matches(w, '^[0-9]+$'))"
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_SEARCH_SQL = f"""WITH j AS (SELECT p_partkey AS uuid, {_NORM.format('p_name')} AS title_norm, {_NORM.format('p_type')} AS ty, {_NORM.format('p_brand')} AS br, CASE WHEN p_size % 2 = 0 THEN 'Full Time' ELSE 'Part Time' END AS work_type, p_retailprice * 3 AS hi, p_retailprice * 2.5 AS avg_salary FROM part),
h AS (SELECT *, len(list_intersect({_TOK.format('title_norm')}, ['{_TITLE}'])) AS th, len(list_intersect({_TOK.format('ty')}, ['{_TITLE}'])) AS dh, len(list_intersect({_TOK.format('br')}, ['{_TITLE}'])) AS ch, (ty = 'economy')::INT + (br = 'brand 3')::INT AS sh FROM j),
f AS (SELECT uuid, th AS title_hits, dh AS desc_hits, ch AS category_hits, sh AS skill_hits, avg_salary, array_to_string(list_filter(['brand 3', 'economy'], lambda s: s = br OR s = ty), ',') AS matched_skills, th * 3.2 + dh * 0.45 + ch * 1.2 + sh * 3.0 + CASE WHEN contains(title_norm, '{_TITLE} economy brand 3') THEN 5.0 ELSE 0 END + CASE WHEN work_type = 'Full Time' THEN 1.5 ELSE -1.5 END + CASE WHEN hi >= 3000 THEN 1.0 ELSE -2.5 END AS s FROM h),
g AS (SELECT *, round(s, 3) AS search_score FROM f WHERE s > 0 AND title_hits + skill_hits + category_hits + (desc_hits >= 2)::INT > 0 AND (title_hits > 0 OR category_hits > 0 OR skill_hits >= 2)),
b AS (SELECT *, row_number() OVER (ORDER BY search_score DESC, skill_hits DESC, avg_salary DESC, uuid) AS rank FROM g)"""


@query(_SEARCH_SQL + " SELECT uuid, title_hits, desc_hits, category_hits, skill_hits, matched_skills, search_score FROM g")
def search_jobs(t):
    _, found = _found(t)
    return found.select("uuid", "title_hits", "desc_hits", "category_hits", "skill_hits", F.array_join("matched_skills", ",").alias("matched_skills"), "search_score")


_PROFILE_SQL = ", pf AS (SELECT skill, sum(greatest(search_score, 0.1) / sqrt(rank)) AS cnt FROM (SELECT search_score, rank, unnest(list_distinct(list_value(ty, br))) AS skill FROM b JOIN j USING (uuid) WHERE rank <= 25) GROUP BY 1)"


@query(_SEARCH_SQL + _PROFILE_SQL + " SELECT skill, round(cnt, 4) AS cnt FROM pf")
def search_profile(t):
    _, found = _found(t)
    return search.skill_profile(search.ranked(found, 25), "skill_set").withColumn("cnt", F.round("cnt", 4))


@query(_SEARCH_SQL + _PROFILE_SQL + f""", fw AS (SELECT *, cnt / sum(cnt) OVER () AS w, row_number() OVER (ORDER BY cnt DESC, skill) AS rk FROM pf), ft AS (SELECT sum(w * w) AS fn, least(count(*), 10) AS tn, sum(cnt) FILTER (rk <= 10) AS tc FROM fw),
mo AS (SELECT p_partkey AS module_id, p_name, list_distinct(list_value({_NORM.format('p_type')}, {_NORM.format('p_brand')})) AS sk FROM part), ms AS (SELECT module_id, p_name, unnest(sk) AS skill, 1.0::DOUBLE / len(sk) AS w, 1.0::DOUBLE / len(sk) AS mn FROM mo),
pr AS (SELECT module_id, any_value(p_name) AS p_name, count(*) AS o, sum(least(ms.w, fw.w)) AS s, sum(ms.w * fw.w) AS d, any_value(mn) AS mn, count(*) FILTER (rk <= 10) AS h, coalesce(sum(cnt) FILTER (rk <= 10), 0) AS hc, list_sort(list(skill)) AS sk FROM ms JOIN fw USING (skill) GROUP BY 1),
a AS (SELECT m.module_id, h / tn AS cov, s / (2 - s) AS wj, d / sqrt(mn * fn) AS cs, 1 - hc / tc AS gap, (list_contains(m.sk, 'economy')::INT + list_contains(m.sk, 'brand 3')::INT + 0) AS q0, {_TOK.format(_NORM.format('mo.p_name'))} AS tt, mo.sk AS ms FROM pr m, ft, mo WHERE mo.module_id = m.module_id),
z AS (SELECT *, greatest(0, least(1, cov * 0.4 + wj * 0.25 + cs * 0.2 + (1 - gap) * 0.15)) AS score, (contains(array_to_string(list_concat(tt, ms), ' '), 'economy')::INT + contains(array_to_string(list_concat(tt, ms), ' '), 'brand 3')::INT) / 2 AS qc, len(list_filter(tt, lambda u: u = '{_TITLE}' OR (length(u) >= 5 AND left(u, 6) = left('{_TITLE}', 6)))) > 0 AS hit FROM a),
y AS (SELECT module_id, round(round(score, 10), 4) AS alignment_score, qc * 0.5 + CASE WHEN hit THEN 0.35 + 0.15 ELSE 0 END AS rel, score, round(round(cov, 10), 4) AS coverage, round(round(wj, 10), 4) AS jaccard FROM z WHERE score > 0)
SELECT module_id, alignment_score, round(round(score * 0.7 + rel * 0.3, 10), 4) AS recommendation_score, round(rel, 4) AS query_relevance_score, coverage FROM y WHERE rel > 0 OR coverage >= 0.3 ORDER BY 3 DESC, 2 DESC, 5 DESC, jaccard DESC, module_id LIMIT 20""")
def search_modules(t):
    intent, found = _found(t)
    profile = search.skill_profile(search.ranked(found, 25), "skill_set")
    mods = t.part.select(F.col("p_partkey").alias("module_id"), F.lit("NUS").alias("source"), text.tokens("p_name").alias("title_tokens"), F.array_distinct(F.array(text.search_key("p_type"), text.search_key("p_brand"))).alias("skills"))
    return search.recommend(mods, profile, intent, n=20).select("module_id", "alignment_score", "recommendation_score", "query_relevance_score", "coverage")


@query(f"SELECT DISTINCT {_NORM.format('p_type')} AS skill FROM part WHERE contains(' economy promo brand 3 ', ' ' || {_NORM.format('p_type')} || ' ') AND {_NORM.format('p_type')} <> ''")
def query_skills(t):
    return search.query_skills(t.part, "economy promo brand 3", "p_type")


# ---------------------------------------------------------------- review tables and signals


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'eau') THEN 'french' WHEN contains(lower(text), 'sch') THEN 'german' WHEN contains(lower(text), 'ción') THEN 'spanish' ELSE 'other' END AS domain_bucket,
CASE WHEN length(t) > 420 THEN rtrim(left(t, 417)) || '...' ELSE t END AS description_snippet, coalesce(quality::VARCHAR, '') AS label_skills, '' AS review_notes, '' AS review_skills FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) LEFT JOIN labels USING (doc_id)""")
def benchmark_join(t):
    labels = t.labels.select("doc_id", F.array(F.col("quality").cast("string")).alias("skills"))
    out = benchmark.side_by_side(t.documents, "doc_id", {"label": labels}, description="text")
    buckets = {"french": ["eau"], "german": ["sch"], "spanish": ["ción"]}
    return out.select("doc_id", benchmark.domain("text", buckets).alias("domain_bucket"), "description_snippet", F.array_join("label_skills", ",").alias("label_skills"), "review_notes", "review_skills")


_MENTION = "CASE CAST((conv_id + turn) % 5 AS INT) WHEN 0 THEN ' Minimum 3 years; 2+ yrs of experience, MINIMUM 3 YEARS' WHEN 1 THEN ' 2 - 4 years of experience or over 10 yrs' WHEN 2 THEN ' Entry-level candidates welcome, no experience needed. No Experience Needed!' WHEN 3 THEN ' years of service' ELSE '' END"


@query(f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') || {_MENTION} AS t FROM conversations),
x AS (SELECT conv_id, turn, list_concat(regexp_extract_all(t, '(?:minimum|min\\.?|at least|more than|over)\\s+\\d+\\+?\\s*(?:years?|yrs?)', 0, 'i'), regexp_extract_all(t, '\\d+\\+?\\s*(?:years?|yrs?)\\s+of\\s+experience', 0, 'i'),
  regexp_extract_all(t, '\\d+\\s*[-/to]+\\s*\\d+\\s*(?:years?|yrs?)\\s+of\\s+experience', 0, 'i'), regexp_extract_all(t, 'entry-level candidates welcome', 0, 'i'), regexp_extract_all(t, 'no experience (?:needed|required)', 0, 'i')) AS x FROM t)
SELECT conv_id, turn, array_to_string(list_filter(x, lambda v, i: list_position(list_transform(x, lambda y: lower(y)), lower(v)) = i), '|') AS mentions FROM x""")
def experience_mentions(t):
    k = (F.col("conv_id") + F.col("turn")) % 5
    more = F.when(k == 0, " Minimum 3 years; 2+ yrs of experience, MINIMUM 3 YEARS").when(k == 1, " 2 - 4 years of experience or over 10 yrs").when(k == 2, " Entry-level candidates welcome, no experience needed. No Experience Needed!").when(k == 3, " years of service").otherwise("")
    return t.conversations.select("conv_id", "turn", F.array_join(text.experience_mentions(F.concat(F.coalesce("text", F.lit("")), more)), "|").alias("mentions"))


_FRESH = "CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'Fresh graduates may apply' WHEN 1 THEN 'ENTRY - LEVEL post' WHEN 2 THEN 'Training provided' WHEN 3 THEN 'refresh gradually, no experienced staff' WHEN 4 THEN NULL ELSE o_orderpriority END"


@query(f"""WITH r AS (SELECT o_orderkey, [o_orderstatus, CASE WHEN o_orderpriority = '5-LOW' THEN 'Fresh/Entry Level' ELSE 'Manager' END] AS levels, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 5 END AS years, lower({_FRESH}) AS t FROM orders),
s AS (SELECT o_orderkey, years, len(list_filter(levels, lambda v: contains(lower(v), 'fresh/entry level'))) > 0 AS l, coalesce(years <= 1, false) AS y, coalesce(regexp_matches(t, '\\bfresh grads?\\b|\\bfresh graduates?\\b|\\bentry\\s*-?\\s*level\\b|\\bno experience\\b|\\btraining (?:will be )?provided\\b|\\bwelcome fresh\\b'), false) AS x FROM r)
SELECT o_orderkey, l, y, x, (l OR y OR x) AND coalesce(years >= 3, false) AS conflict FROM s""")
def freshgrad_signals(t):
    k = F.col("o_orderkey") % 7
    body = F.when(k == 0, "Fresh graduates may apply").when(k == 1, "ENTRY - LEVEL post").when(k == 2, "Training provided").when(k == 3, "refresh gradually, no experienced staff").when(k != 4, F.col("o_orderpriority"))
    levels = F.array("o_orderstatus", F.when(F.col("o_orderpriority") == "5-LOW", "Fresh/Entry Level").otherwise("Manager"))
    l, y, x, c = clean_courses.fresh_graduate(levels, F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 5), body)
    return t.orders.select("o_orderkey", l.alias("l"), y.alias("y"), x.alias("x"), c.alias("conflict"))


@query("""SELECT p_partkey, CASE WHEN p_size IS NULL OR p_size % 6 = 0 THEN 'unknown' WHEN p_size <= 1 THEN '0-1' WHEN p_size <= 2 THEN '1-2' ELSE '2+' END AS bucket,
CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN CAST(p_size * 1000 AS BIGINT) WHEN 1 THEN CAST(p_size * 1000 + 500 AS BIGINT) WHEN 2 THEN CAST(p_size * 1000 + 250 AS BIGINT) WHEN 3 THEN CAST(p_size AS BIGINT) END AS pay FROM part""")
def numeric_parsing(t):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    said = F.when(k == 0, F.concat(F.lit("$"), n, F.lit("k"))).when(k == 1, F.concat(n, F.lit(".5K "))).when(k == 2, F.concat(F.lit(" $"), n, F.lit(",250"))).when(k == 3, n).when(k == 4, F.concat(n, F.lit(" a year")))
    years = F.when(F.col("p_size") % 6 != 0, F.col("p_size"))
    return t.part.select("p_partkey", numeric.experience_bucket(years).alias("bucket"), numeric.money(said).alias("pay"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), z AS (SELECT vec_id, list_sum(list_transform(v, lambda x: x * x)) AS s FROM v) SELECT vec_id, round(s, 4) AS squared, round(list_sum(list_transform(v, lambda x: (x / sqrt(s)) * (x / sqrt(s)))), 4) AS unit_squared FROM z JOIN v USING (vec_id)")
def vector_norms(t):
    return t.embeddings.select("vec_id", F.round(arrays.dot("embedding", "embedding"), 4).alias("squared"), F.round(arrays.dot(arrays.unit("embedding"), arrays.unit("embedding")), 4).alias("unit_squared"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type AS code, count(*) AS job_count, sum((value >= 50)::INT)::BIGINT AS good_job_count FROM events GROUP BY 1, 2")
def stream_family_counts(t):
    """The stream runs over the table once to its end; its closed windows are appended to a table."""
    events = t.spark.read.parquet(f"{t.dir}/events.parquet")
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet").parquet(t.dir if not t.dir.endswith("/") else t.dir[:-1])
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("good", (F.col("value") >= 50).cast("int"))
    counts = streaming.table_of(streaming.family_counts(rows, "event_type", "good", "ts"), shared.new_path(t.spark, "stream"), "window_start", "event_type")
    return counts.withColumnRenamed("event_type", "code").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
