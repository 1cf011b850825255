"""The catalogue's third part: the canonical framework and mapping by it, each query beside its SQL.

The framework is the curated one and what the test tables give: a brand is a curated skill whose aliases
are its economy and promo lines, a type is a rule for its grade, names of parts are evidence for grades and
labels of their own, small lines of every fifth brand are excluded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import values
from tessera.catalog import _KEY_SQL, _MATCH, _SKILLS, _align_sql, _shown, modules, order_skills, postings
from tessera.functions import text
from tessera.operators import embed, framework, mapping, memo, patterns, quantiles, scope
from tessera.plans import pipelines
from tessera.registry import Tables, query
from tessera.sources import shared
from tessera.streaming import profiles


def sources(t: Tables) -> framework.Sources:
    number = F.substring("p_brand", 7, 9).cast("int")
    line = F.concat_ws(" ", "p_brand", "p_type")
    grade = F.concat(F.initcap("p_type"), F.lit(" Grade"))
    kinds = F.element_at(F.lit(["hard", "soft", "domain", "tool"]), number % 4 + 1)
    base = t.part.groupBy(F.col("p_brand").alias("canonical_skill")).agg(F.max(kinds).alias("skill_type"), F.collect_set(F.when(F.col("p_type").isin("ECONOMY", "PROMO"), line)).alias("aliases"), (F.lit(1000) + F.max(number)).cast("long").alias("place"))
    types = t.part.select("p_type", grade.alias("grade")).distinct()
    rules = types.select(F.array("p_type", F.concat_ws(" ", F.lit("Brand#1"), "p_type")).alias("patterns"), F.array("grade").alias("skills"))
    evidence = t.part.groupBy(grade.alias("canonical_skill")).agg(F.collect_set("p_name").alias("phrases"))
    labels = t.part.select(F.initcap("p_name").alias("canonical_skill")).distinct()
    blocked = t.part.where((F.col("p_type") == "SMALL") & (number % 5 == 0)).select(line.alias("phrase")).distinct()
    return framework.curated(t.spark).and_(framework.Sources(base, rules, evidence, labels, blocked))


def built(t: Tables) -> framework.Framework:
    return framework.build(sources(t))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _array(xs) -> str:
    return "[" + ", ".join(map(_quoted, xs)) + "]"


_TYPED = "CASE " + " ".join(f"WHEN skill IN ({', '.join(map(_quoted, names))}) THEN '{kind}'" for kind, names in values.SKILL_TYPES) + " ELSE 'hard' END"
_INITCAP = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
_GRADE = "upper(left(p_type, 1)) || lower(substr(p_type, 2)) || ' Grade'"
_FRAMEWORK_SQL = f"""
fb AS (
  SELECT * FROM (VALUES {", ".join(f"({_quoted(s)}, '{kind}', {_array(a)})" for s, kind, a in values.BASE_SKILLS)}) v(skill, given, xs)
  UNION ALL SELECT p_brand, max((['hard', 'soft', 'domain', 'tool'])[CAST(substr(p_brand, 7) AS INTEGER) % 4 + 1]), coalesce(list(DISTINCT p_brand || ' ' || p_type) FILTER (p_type IN ('ECONOMY', 'PROMO')), []) FROM part GROUP BY 1),
fr AS (
  SELECT * FROM (VALUES {", ".join(f"({_quoted(s)}, {_array(p)})" for p, ss in values.MODULE_RULES for s in ss)}) v(skill, xs)
  UNION ALL SELECT DISTINCT {_GRADE}, [p_type, 'Brand#1 ' || p_type] FROM part),
fe AS (
  SELECT * FROM (VALUES {", ".join(f"({_quoted(s)}, {_array(p)})" for s, p in values.STRICT_EVIDENCE.items())}) v(skill, xs)
  UNION ALL SELECT {_GRADE}, list(DISTINCT p_name) FROM part GROUP BY 1),
fl AS (SELECT unnest({_array(values.MODULE_SKILLS)}) AS skill UNION ALL SELECT DISTINCT {_INITCAP.format("p_name")} FROM part),
fx AS (
  SELECT DISTINCT {_KEY_SQL} AS phrase FROM (SELECT unnest({_array((*values.BLOCKED_PHRASES, *values.EXCLUDED_PHRASES))}) AS x
  UNION ALL SELECT p_brand || ' ' || p_type FROM part WHERE p_type = 'SMALL' AND CAST(substr(p_brand, 7) AS INTEGER) % 5 = 0)),
fz AS (
  SELECT skill, kind, {_KEY_SQL} AS alias FROM (
    SELECT skill, 1 AS kind, unnest(list_append(xs, skill)) AS x FROM fb UNION ALL SELECT skill, 2, unnest(list_append(xs, skill)) FROM fr
    UNION ALL SELECT skill, 3, unnest(list_append(xs, skill)) FROM fe UNION ALL SELECT skill, 4, skill FROM fl)),
fk AS (SELECT skill, coalesce(any_value(given), any_value({_TYPED})) AS skill_type FROM (SELECT DISTINCT skill FROM fz) LEFT JOIN fb USING (skill) GROUP BY 1),
fa AS (SELECT alias, skill, array_to_string(list_transform(list_sort(list(DISTINCT kind)), lambda k: (['base', 'rules', 'evidence', 'labels'])[k]), ',') AS sources FROM fz WHERE alias <> '' GROUP BY 1, 2)"""


@query(f"WITH {_FRAMEWORK_SQL} SELECT alias, skill AS canonical_skill, skill_type, fa.sources, count(*) OVER (PARTITION BY skill) AS n_aliases FROM fa JOIN fk USING (skill)")
def framework_aliases(t):
    """Every alias of the merged framework with its skill's type and the kinds of sources that gave it."""
    f = built(t)
    out = f.aliases.join(f.skills.select("canonical_skill", "skill_type", "n_aliases"), "canonical_skill")
    return out.select("alias", "canonical_skill", "skill_type", F.array_join("sources", ",").alias("sources"), "n_aliases")


@query(f"WITH {_FRAMEWORK_SQL} SELECT alias, string_agg(skill, '|' ORDER BY skill) AS skills, max(skill) AS exact, min(skill) AS nearest, alias IN (SELECT phrase FROM fx) AS is_excluded FROM fa GROUP BY 1 HAVING count(*) > 1")
def framework_collisions(t):
    return built(t).collisions().select("alias", F.array_join("skills", "|").alias("skills"), "exact", "nearest", "is_excluded")


def _phrases(t: Tables) -> DataFrame:
    """Every part's line, type and words of its name, and a phrase without letters."""
    return t.part.select(F.explode(F.concat(F.array(F.concat_ws(" ", "p_brand", "p_type"), F.col("p_type"), F.concat(F.col("p_name"), F.lit(" ")), F.lit("!!")), F.split("p_name", " "))).alias("phrase"))


_PHRASES_SQL = "SELECT unnest([p_brand || ' ' || p_type, p_type, p_name || ' ', '!!'] || string_split(p_name, ' ')) AS x FROM part"


def _map_sql(phrases: str, excluded: bool = True) -> str:
    """CTEs up to ``mp``: one row for every key of the phrases x."""
    out = "x IN (SELECT phrase FROM fx)" if excluded else "false"
    return f"""{_FRAMEWORK_SQL},
fm AS (SELECT alias, max(skill) AS skill FROM fa GROUP BY 1),
px AS (SELECT DISTINCT {_KEY_SQL} AS x FROM ({phrases})),
mp AS (SELECT x AS key, CASE WHEN x = '' THEN 'empty' WHEN {out} THEN 'excluded' WHEN skill IS NOT NULL THEN 'exact' ELSE 'unmapped' END AS match_type, skill FROM px LEFT JOIN fm ON x = alias),
mq AS (
  SELECT key, match_type, CASE match_type WHEN 'exact' THEN skill WHEN 'unmapped' THEN key ELSE '' END AS canonical_skill,
         CASE WHEN match_type = 'exact' THEN skill_type ELSE '' END AS skill_type, CASE WHEN match_type IN ('excluded', 'exact') THEN 1.0 ELSE 0.0 END AS score
  FROM mp LEFT JOIN fk USING (skill))"""


@query("WITH " + _map_sql(_PHRASES_SQL) + " SELECT * FROM mq")
def alias_map_exact(t):
    return mapping.map_phrases(_phrases(t), *built(t).tables())


@query("WITH " + _map_sql(_PHRASES_SQL, False) + " SELECT * FROM mq")
def alias_map_batch(t):
    return mapping.map_phrases(_phrases(t), *built(t).tables(), exclusion="batch_compat")


@query("WITH " + _map_sql(_PHRASES_SQL) + f", old AS (SELECT DISTINCT {_KEY_SQL} AS key FROM (SELECT p_name AS x FROM part UNION ALL SELECT '!!')) SELECT mq.*, key IN (SELECT key FROM old) AS remembered FROM mq")
def incremental_mapping(t):
    """Two runs on one memo: names of parts first, then all phrases, of which only the others are mapped."""
    remembered = memo.Memo(t.spark, shared.new_path(t.spark, "memo"))
    f = built(t).kept(shared.new_path(t.spark, "framework"))
    memo.map_phrases(remembered, t.part.select(F.col("p_name").alias("phrase")).unionAll(t.spark.range(1).select(F.lit("!!").alias("phrase"))), f)
    run = memo.map_phrases(remembered, _phrases(t), f)
    new = run.added.select("key", F.lit(True).alias("new"))
    return run.mapped.join(new, "key", "left").select("key", "canonical_skill", "skill_type", "match_type", "score", F.col("new").isNull().alias("remembered"))


@query(f"""WITH {_SKILLS}, {_map_sql("SELECT skill AS x FROM sk")},
e AS (SELECT k, skill AS x, mq.* FROM sk JOIN mq ON mq.key = regexp_replace(trim(regexp_replace(lower(sk.skill), '\\s+', ' ', 'g')), '^[^a-z0-9+#/]+|[^a-z0-9+#/]+$', '', 'g'))
SELECT o_orderkey AS id, coalesce(string_agg(DISTINCT canonical_skill, ',' ORDER BY canonical_skill) FILTER (canonical_skill <> ''), '') AS canonical_skills, count(e.k) AS n_phrases, count(*) FILTER (match_type = 'exact') AS n_exact, count(*) FILTER (match_type = 'excluded') AS n_excluded
FROM orders LEFT JOIN e ON e.k = o_orderkey GROUP BY 1""")
def mapped_lists(t):
    """The canonical skills of every order's list, and how its phrases were mapped."""
    rows = t.orders.select(F.col("o_orderkey").alias("id")).join(order_skills(t), F.col("id") == F.col("k"), "left").drop("k")
    mapped = mapping.map_phrases(rows.select(F.explode("skills").alias("phrase")), *built(t).tables())
    out = mapping.map_lists(rows, mapped)
    details = F.coalesce(F.transform("canonical_skills_details", lambda d: d["match_type"]), F.array().cast("array<string>"))
    count = lambda kind: F.size(F.filter(details, lambda m: m == kind)).cast("long")
    return out.select("id", F.array_join("canonical_skills", ",").alias("canonical_skills"), F.size(details).cast("long").alias("n_phrases"), count("exact").alias("n_exact"), count("excluded").alias("n_excluded"))


_CANONICAL_SKILLS = f"""raw AS (SELECT DISTINCT l_orderkey AS k, p_brand || ' ' || p_type AS skill FROM lineitem JOIN part ON l_partkey = p_partkey),
{_map_sql("SELECT skill AS x FROM raw")},
sk AS (SELECT DISTINCT k, canonical_skill AS skill FROM raw JOIN mq ON mq.key = regexp_replace(trim(regexp_replace(lower(raw.skill), '\\s+', ' ', 'g')), '^[^a-z0-9+#/]+|[^a-z0-9+#/]+$', '', 'g') WHERE canonical_skill <> '')"""


@query(_align_sql().replace(_SKILLS, _CANONICAL_SKILLS) + f"SELECT {_MATCH} FROM top")
def aligned_by_framework(t):
    """The whole pipeline: occupations, mapping by the merged framework, alignment."""
    titles = t.nation.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), i.cast("string")))).alias("code"), F.col("n_name").alias("title"))
    jobs = postings(t).withColumnsRenamed({"job_id": "id", "code5": "ssoc_code"}).drop("title")
    out = pipelines.alignment(modules(t).withColumnRenamed("module_id", "id"), jobs, titles, built(t))
    return _shown(out.matches)


@query()
def semantic_map(t):
    return mapping.map_phrases(_phrases(t), *built(t).tables(), embedder=embed.HashingEmbedder(), threshold=0.3)


# ---------------------------------------------------------------- rules of any number


def _rule_table(t: Tables) -> DataFrame:
    """The 70 rules, and one for each benchmark item: its word pairs are patterns of a skill of its own."""
    fixed = t.spark.createDataFrame([(i, list(p), list(s)) for i, (p, s) in enumerate(values.MODULE_RULES)], "i long, patterns array<string>, skills array<string>")
    pairs = F.array_distinct(text.grams(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), 0), 2))
    learnt = t.benchmark.select((1000 + F.col("item_id")).alias("i"), pairs.alias("patterns"), F.array(F.concat(F.lit("Item "), F.col("item_id").cast("string"))).alias("skills"))
    return patterns.rule_table(fixed.unionAll(learnt), "i")


_RULE_SQL = f"""
pt AS (
  SELECT i, j, skill, unnest(xs) AS p FROM (VALUES {", ".join(f"({i}, {j}, {_quoted(s)}, {_array(ps)})" for i, (ps, ss) in enumerate(values.MODULE_RULES) for j, s in enumerate(ss))}) v(i, j, skill, xs)
  UNION ALL SELECT 1000 + item_id, 0, 'Item ' || item_id, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM benchmark)),
rd AS (SELECT doc_id, regexp_extract_all(t, '[a-z0-9_]+') AS w, list_slice(regexp_extract_all(t, '[^a-z0-9_]+'), CASE WHEN regexp_matches(t, '^[a-z0-9_]') THEN 1 ELSE 2 END, 1000000000) AS g FROM (SELECT doc_id, lower(text) AS t FROM documents)),
rw AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS w, unnest(list_slice(list_concat(g, ['', '']), 1, len(w))) AS g FROM rd),
rl AS (SELECT doc_id, w AS a, w || g || lead(w, 1) OVER o AS b, w || g || lead(w || g, 1) OVER o || lead(w, 2) OVER o AS c, w || g || lead(w || g, 1) OVER o || lead(w || g, 2) OVER o || lead(w, 3) OVER o AS d,
  w || g || lead(w || g, 1) OVER o || lead(w || g, 2) OVER o || lead(w || g, 3) OVER o || lead(w, 4) OVER o AS e FROM rw WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rh AS (SELECT doc_id, a AS p FROM rl UNION SELECT doc_id, b FROM rl UNION SELECT doc_id, c FROM rl UNION SELECT doc_id, d FROM rl UNION SELECT doc_id, e FROM rl),
rs AS (SELECT doc_id, skill, min(i * 10 + j) AS place FROM rh JOIN pt USING (p) GROUP BY 1, 2)"""


@query(f"WITH {_RULE_SQL} SELECT doc_id, coalesce(string_agg(skill, ',' ORDER BY place), '') AS skills FROM documents LEFT JOIN rs USING (doc_id) GROUP BY 1")
def module_rule_skills(t):
    """All rules over the whole texts: thousands of patterns, and every text is read once."""
    return patterns.rule_skills(t.documents, "doc_id", "text", _rule_table(t)).select("doc_id", F.array_join("skills", ",").alias("skills"))


@query(f"WITH {_RULE_SQL}, n AS (SELECT doc_id, unnest([a, b]) AS p FROM rl) SELECT doc_id, p AS phrase, count(*) AS hits FROM n WHERE p IN (SELECT p FROM pt WHERE len(string_split_regex(p, '[^a-z0-9_]+')) <= 2) GROUP BY 1, 2")
def phrase_places(t):
    """How often each pattern of one or two words stands in each text."""
    rules = _rule_table(t).where(F.size(F.split("pattern", "[^a-z0-9_]+")) <= 2)
    return patterns.find(t.documents, "doc_id", "text", rules, "pattern")


# ---------------------------------------------------------------- quantiles of groups of any size


@query("SELECT p_type AS g, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS q2, round(quantile_cont(l_extendedprice, 0.9), 4) AS q3 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def group_quantiles(t):
    """Quantiles of prices by type: six groups, none of which a task holds."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_type", "l_extendedprice")
    out = quantiles.group_quantiles(rows, "p_type", "l_extendedprice", (0.25, 0.5, 0.9))
    return out.select("g", "n", *[F.round(F.get("q", F.lit(i)), 4).alias(f"q{i + 1}") for i in range(3)])


# ---------------------------------------------------------------- profiles over a stream


@query("""WITH j AS (SELECT o_orderkey AS k, o_orderpriority AS code, CAST(o_totalprice >= 100000 AS INT) AS good FROM orders WHERE o_orderstatus <> 'P'),
s AS (SELECT DISTINCT l_orderkey AS k, p_type AS skill FROM lineitem JOIN part ON l_partkey = p_partkey), f AS (SELECT code, count(*) AS job_count, sum(good)::BIGINT AS good_job_count FROM j WHERE k IN (SELECT k FROM s) GROUP BY 1),
c AS (SELECT code, skill, count(*) AS cnt FROM j JOIN s USING (k) GROUP BY 1, 2)
SELECT code, job_count, good_job_count, skill, cnt, row_number() OVER (PARTITION BY code ORDER BY cnt DESC, skill) AS rk FROM f JOIN c USING (code)""")
def stream_profiles(t):
    """Every order comes three times, over three files: as it is, before that under another family and with
    other skills, and once more in an older version that comes last.  Orders of status P end without a
    family.  The profile is that of the newest versions."""
    kinds = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("p_type").alias("skills"))
    final = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    rows = t.orders.join(kinds, F.col("o_orderkey") == F.col("k")).select("k", "skills", final.alias("code"), (F.col("o_totalprice") >= 100000).cast("int").alias("good"))
    wrong = rows.select("k", F.array(F.lit("WRONG")).alias("skills"), F.lit("0-NONE").alias("code"), F.lit(1).alias("good"))
    path, shape = shared.new_path(t.spark, "versions"), "k bigint, skills array<string>, code string, good int, version bigint"
    for name, part, version in (("a", wrong, 1), ("b", rows, 3), ("c", wrong, 2)):
        part.select(F.col("k").cast("bigint").alias("k"), "skills", "code", "good", F.lit(version).cast("bigint").alias("version")).write.parquet(f"{path}/{name}")
    stream = t.spark.readStream.schema(shape).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", True).parquet(path)
    families, skills = profiles.kept_profile(profiles.changes(stream, "k", "version", "code", "good", "skills"), shared.new_path(t.spark, "profiles"))
    return families.select("code", "job_count", "good_job_count").join(skills.select("code", "skill", "cnt", "rk"), "code")


# ---------------------------------------------------------------- curated scope lists, prototypes, the earlier mapper


def _courses(t: Tables) -> DataFrame:
    """A customer is a course: its nation tells the university, and its key one of the curated names of that
    university's fields or a name of no list."""
    names = {(u, f): [*n, "Other", " "] for u, f, _, _, n in values.SCOPE_LISTS}
    pick = lambda u, f: F.element_at(F.lit(names[u, f]), (F.col("c_custkey") % len(names[u, f]) + 1).cast("int"))
    u = F.element_at(F.lit(["NUS", "NTU", "SUTD"]), F.col("c_nationkey") % 3 + 1)
    department = F.when(F.col("university") == "NUS", pick("NUS", "department")).when(F.col("university") == "NTU", pick("NTU", "department")).otherwise(pick("SUTD", "department"))
    faculty = F.when(F.col("university") == "NUS", pick("NUS", "faculty")).when(F.col("university") == "NTU", pick("NTU", "faculty"))
    return t.customer.withColumn("university", u).select("c_custkey", "university", department.alias("department"), faculty.alias("faculty"))


def _picked(field: str) -> str:
    found = {u: [*n, "Other", " "] for u, f, _, _, n in values.SCOPE_LISTS if f == field}
    return "CASE u " + " ".join(f"WHEN '{u}' THEN ({_array(n)})[c_custkey % {len(n)} + 1]" for u, n in found.items()) + " END"


_COURSES_SQL = f"co AS (SELECT c_custkey, u AS university, {_picked('department')} AS department, {_picked('faculty')} AS faculty FROM (SELECT c_custkey, (['NUS', 'NTU', 'SUTD'])[c_nationkey % 3 + 1] AS u FROM customer))"


def _listed(u: str, f: str) -> str:
    rest, named, names = next((r, n, xs) for a, b, r, n, xs in values.SCOPE_LISTS if (a, b) == (u, f))
    return f"CASE WHEN trim({f}) IN ({', '.join(map(_quoted, names)) or 'NULL'}) THEN '{named}' ELSE '{rest}' END"


@query(f"WITH {_COURSES_SQL} " + " UNION ALL ".join(f"SELECT DISTINCT '{u}' AS university, '{f}' AS field, trim({f}) AS value, {_listed(u, f)} AS bucket FROM co WHERE university = '{u}' AND trim({f}) <> ''" for u, f, *_ in values.SCOPE_LISTS))
def scope_university_lists(t):
    return scope.university_lists(_courses(t))


@query(f"WITH {_COURSES_SQL} SELECT c_custkey, CASE WHEN " + " OR ".join(f"(university = '{u}' AND trim({f}) <> '' AND {_listed(u, f)} = 'clear_stem')" for u, f, *_ in values.SCOPE_LISTS) + " THEN 'clear_stem' ELSE 'unclear_or_mixed' END AS bucket FROM co")
def scope_by_metadata(t):
    return _courses(t).select("c_custkey", scope.metadata_bucket("university", "department", "faculty").alias("bucket"))


@query()
def prototype_margins(t):
    """Texts against the prototype sentences, by the stand-in embedder."""
    return scope.prototype_margin(t.documents.select("doc_id", "text"), "text", embed.HashingEmbedder()).drop("text")


_RAW_SQL = "SELECT unnest([p_type || '!', p_name, p_brand]) AS x FROM part"


@query(f"""WITH j AS (SELECT {_KEY_SQL} AS skill FROM (SELECT unnest([p_type, split_part(p_name, ' ', 1)]) AS x FROM part WHERE p_size > 10) WHERE {_KEY_SQL} <> ''),
k AS (SELECT skill FROM j GROUP BY 1 ORDER BY count(*) DESC, skill LIMIT 8), r AS (SELECT DISTINCT {_KEY_SQL} AS raw_skill FROM ({_RAW_SQL}))
SELECT raw_skill, raw_skill AS mapped_skill, CASE WHEN raw_skill IN (SELECT skill FROM k) THEN 'exact' ELSE 'unmapped_no_model' END AS match_type, CASE WHEN raw_skill IN (SELECT skill FROM k) THEN 1.0 ELSE 0.0 END AS similarity FROM r WHERE raw_skill <> ''""")
def frequent_mapping(t):
    """The earlier mapper without a model: names and types of parts among the 8 most frequent skills."""
    jobs = t.part.where("p_size > 10").select(F.array("p_type", F.split_part("p_name", F.lit(" "), F.lit(1))).alias("skills"))
    raw = t.part.select(F.explode(F.array(F.concat("p_type", F.lit("!")), "p_name", "p_brand")).alias("phrase"))
    return mapping.map_to_frequent(raw, jobs, n=8)


@query()
def frequent_mapping_near(t):
    """The same with the stand-in embedder."""
    jobs = t.part.select(F.array("p_name").alias("skills"))
    raw = t.part.select(F.explode(F.array(F.concat("p_name", F.lit("s")), "p_type")).alias("phrase"))
    return mapping.map_to_frequent(raw, jobs, embedder=embed.HashingEmbedder(), threshold=0.62)
