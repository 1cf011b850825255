"""The catalogue's second part: sources, sinks, exports, scalar rules and search, each beside its SQL.

Sources and sinks write files made of the test tables into the shared folder and read them back.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.catalog import _NORM, _SEARCH_SQL, _TOK, _found, _jobs, postings
from tessera.functions import arrays, fuzzy, numeric, text
from tessera.operators import align, benchmark, clean_courses, embed, explore, extract, rules, scope, search
from tessera.registry import Tables, query
from tessera.sources import charts, listing, paged, readers, shared, writers


def pick(values: list, key: str):
    """The value that a key's remainder names; the SQL of it is ``[...][key % n + 1]``."""
    return F.element_at(F.lit(values), (F.col(key) % len(values) + 1).cast("int"))


def listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# ---------------------------------------------------------------- sources


@query("SELECT r_regionkey, r_name FROM region")
def single_document(t):
    """The table as one JSON document, read back."""
    path = shared.new_path(t.spark, "document")
    writers.document_file(t.region, path)
    return readers.json_document(t.spark, path, "r_regionkey int, r_name string")


def _bodies(rows: DataFrame, page, order: str, whole: str = "{0}") -> DataFrame:
    """(page, body): the rows of each page as a server would send them, made in Spark."""
    records = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*rows.columns).alias("r"))))
    out = rows.groupBy(page.alias("page")).agg(F.to_json(F.transform(records, lambda x: x["r"])).alias("records"))
    return out.select("page", F.format_string(whole.replace("{0}", "%s"), "records").alias("body"))


@query("SELECT c_nationkey AS code, min(c_custkey) AS first FROM customer GROUP BY 1")
def paged_records(t):
    """Pages of a hundred customers, the last of which says that none follows; the first of each nation stays."""
    rows = t.customer.select(F.col("c_nationkey").cast("int").alias("code"), F.col("c_custkey").alias("first"))
    pages = _bodies(rows, (F.floor(F.col("first") / 100) + 1).cast("bigint"), "first")
    last = pages.agg(F.max("page").alias("last"))
    pages = pages.crossJoin(F.broadcast(last)).select("page", F.concat(F.lit('{"results": '), "body", F.lit(', "next": '), (F.col("page") < F.col("last")).cast("string"), F.lit("}")).alias("body"))
    return paged.listed_records(pages, "code int, first bigint")


@query("SELECT p_brand AS code, min(p_partkey) AS first FROM part WHERE p_partkey < (SELECT min(k) * 10 FROM (SELECT range AS k FROM range(1000000)) WHERE k NOT IN (SELECT p_partkey // 10 FROM part WHERE p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_brand))) GROUP BY 1")
def pages_until_known(t):
    """Pages of ten parts; reading ends with the first page that has no new brand."""
    rows = t.part.select(F.col("p_brand").alias("code"), F.col("p_partkey").alias("first"))
    return paged.records_until_known(_bodies(rows, (F.floor(F.col("first") / 10) + 1).cast("bigint"), "first"), "code string, first bigint")


def _fetched(url: str) -> str:
    if url.endswith("7"):
        raise ValueError("not found")
    return url.upper()


@query("SELECT s_name AS url, CASE WHEN s_name NOT LIKE '%7' THEN upper(s_name) END AS body, CASE WHEN s_name LIKE '%7' THEN 'not found' END AS error FROM supplier")
def parallel_details(t):
    return readers.details(t.supplier.select(F.col("s_name").alias("url")), _fetched)


_LISTING_SQL = """SELECT s_nationkey AS page, lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS code, s_name AS title, 'Type ' || s_nationkey AS course_type,
CAST(s_suppkey % 4 AS VARCHAR) AS terms, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 13 AS INT) END AS credits FROM supplier"""


def _listing(t):
    """Lines of a listing, four a course: type, code and title, term, credits (some without)."""
    code = F.concat_ws(".", F.lpad((F.col("s_suppkey") % 100).cast("string"), 2, "0"), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"))
    lines = F.array(F.concat(F.lit("Type "), "s_nationkey"), F.concat_ws(" ", code, "s_name"), F.concat(F.lit("Term: "), F.col("s_suppkey") % 4), F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("Credits: "), F.col("s_suppkey") % 13)).otherwise("no credits"))
    rows = t.supplier.select(F.col("s_nationkey").alias("page"), "s_suppkey", F.posexplode(lines).alias("i", "line"))
    return rows.withColumn("no", F.col("s_suppkey") * 10 + F.col("i"))


@query(_LISTING_SQL)
def course_listing(t):
    """By windows."""
    return readers.course_blocks(_listing(t), "page", "no", "line")


@query(_LISTING_SQL)
def course_listing_walk(t):
    """By a table function that walks each document's lines."""
    return listing.course_records(_listing(t), "page", "no", "line")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def unseen_codes(t):
    return readers.unseen(t.customer.select("c_custkey"), t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'http://found/' || p_partkey ELSE 'http://base/' || regexp_replace(lower(p_brand), '[^0-9a-z]', '-', 'g') || '-' || regexp_replace(regexp_replace(lower(replace(p_name || ' & ' || p_type || '!', '&', ' and ')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS url FROM part""")
def course_urls(t):
    rows = t.part.withColumns({"title": F.concat("p_name", F.lit(" & "), "p_type", F.lit("!")), "found": F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("http://found/"), "p_partkey"))})
    return rows.select("p_partkey", readers.course_url("http://base/", "p_brand", "title", "found").alias("url"))


@query("""SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'post-' || n_nationkey ELSE 'u-' || n_nationkey END AS uuid, n_name AS title, n_nationkey % 4 AS minimum_years_experience, n_name || ',skill' AS skills, 'Full Time,Permanent' AS employment_types,
CASE WHEN n_nationkey % 2 = 0 THEN 'flexi' ELSE 'named' END AS flexible_work_arrangements, lpad(CAST(n_nationkey AS VARCHAR), 5, '1') AS ssoc_code, CAST(n_nationkey * 100 AS DOUBLE) AS salary_minimum, 'Monthly' AS salary_type, CASE WHEN n_nationkey % 2 = 0 THEN '2024-01-01' ELSE '2023-01-01' END AS posting_date, n_nationkey + 1 AS number_of_vacancies FROM nation""")
def postings_flat(t):
    """Nested postings, a file each in folders by region, read back and flattened."""
    k = F.col("n_nationkey")
    none = F.lit(None).cast("string")
    nested = t.nation.select(
        "n_regionkey",
        F.when(k % 3 != 0, F.concat(F.lit("u-"), k)).alias("uuid"),
        F.col("n_name").alias("title"),
        (k % 4).alias("minimumYearsExperience"),
        F.array(*[F.struct(s.alias("skill")) for s in (F.concat(F.lit(" "), "n_name"), F.lit("  "), F.lit("skill"))]).alias("skills"),
        F.array(*[F.struct(F.lit(s).alias("employmentType")) for s in ("Full Time", "Permanent")]).alias("employmentTypes"),
        F.array(F.struct(F.when(k % 2 == 0, "flexi").otherwise("").alias("flexibleWorkArrangement"), none.alias("arrangement"), F.lit("named").alias("name"))).alias("flexibleWorkArrangements"),
        F.lpad(k.cast("string"), 5, "1").alias("ssocCode"),
        F.struct((k * 100).cast("double").alias("minimum"), F.struct(F.lit("Monthly").alias("salaryType")).alias("type")).alias("salary"),
        F.struct(F.concat(F.lit("post-"), k).alias("jobPostId"), F.when(k % 2 == 0, "2024-01-01").alias("newPostingDate"), F.lit("2023-01-01").alias("originalPostingDate")).alias("metadata"),
        (k + 1).alias("numberOfVacancies"),
    )
    path = shared.new_path(t.spark, "postings")
    nested.write.partitionBy("n_regionkey").option("maxRecordsPerFile", 1).json(path)
    flat = readers.flatten_jobs(readers.job_files(t.spark, path, "part-*"))
    joined = [F.array_join(c, ",").alias(c) for c in ("skills", "employment_types", "flexible_work_arrangements")]
    return flat.select("uuid", "title", "minimum_years_experience", *joined, "ssoc_code", "salary_minimum", "salary_type", "posting_date", "number_of_vacancies")


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS line, s_suppkey, s_name FROM supplier)
SELECT line, CASE WHEN s_suppkey % 5 IN (0, 2) THEN 'error' ELSE 'row' END AS kind, CASE WHEN s_suppkey % 5 >= 3 THEN s_name END AS s_name FROM l WHERE s_suppkey % 5 <> 1""")
def json_lines_checked(t):
    """JSON lines, some of them arrays, blank or cut off; errors carry the number of their line."""
    k = F.col("s_suppkey") % 5
    line = F.when(k == 0, "[1, 2]").when(k == 1, " ").when(k == 2, F.concat(F.lit('{"s_name": "'), "s_name")).otherwise(F.to_json(F.struct("s_name", "s_acctbal")))
    path = shared.new_path(t.spark, "lines")
    t.supplier.select("s_suppkey", line.alias("value")).coalesce(1).sortWithinPartitions("s_suppkey").select("value").write.text(path)
    good, bad = readers.checked_json_lines(t.spark, path, "s_name string, s_acctbal double")
    return good.select("line", F.lit("row").alias("kind"), "s_name").unionAll(bad.select("line", F.lit("error"), F.lit(None).cast("string")))


@query("SELECT lpad(CAST(n_nationkey AS VARCHAR), 3 + n_nationkey % 4, '1') AS code, n_name || ' x' AS title FROM nation WHERE n_nationkey % 4 < 3")
def occupation_lookup(t):
    """A code table as CSV; codes of other lengths are left out, titles have their blanks collapsed."""
    path = shared.new_path(t.spark, "codes")
    code = F.lpad(F.col("n_nationkey").cast("string"), 3 + F.col("n_nationkey") % 4, F.lit("1"))
    t.nation.select(code.alias("code"), F.concat(F.lit("  "), "n_name", F.lit("   x")).alias("title")).write.option("header", True).csv(path)
    return readers.lookup(t.spark, path)


@query("""SELECT p_partkey, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN p_type || '|' || p_brand WHEN 1 THEN p_name WHEN 4 THEN '' ELSE '' END AS cell, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS n FROM part""")
def list_cells(t):
    k = F.col("p_partkey") % 5
    cell = F.when(k == 0, F.concat(F.lit("['"), "p_type", F.lit("', '"), "p_brand", F.lit("']"))).when(k == 1, F.concat(F.lit(" "), "p_name")).when(k == 2, "").when(k == 3, "[]")
    return t.part.select("p_partkey", F.array_join(arrays.list_cell(cell), "|").alias("cell"), F.size(arrays.as_list(F.when(k != 3, cell))).alias("n"))


_TITLES = ["Economics", "Doctoral seminar", "Master's thesis", "Graduate diploma in law", "Masterly graduates", "Ph.D colloquium"]
_ABOUT = ["Ten words are what a description needs to be kept here, at least", "Too short", "This one is cross-listed as a postgraduate course and so it goes, as it should", "Open to MA, PhD and to all that hold ten words or more of text", "A graduate of this course level knows ten words or more, surely"]
_SUTD_NAMES = {"ASD": "Architecture and Sustainable Design", "ESD": "Engineering Systems and Design", "SMT": "Science, Mathematics and Technology"}
_LONG = "len(regexp_split_to_array(trim(description), '\\s+')) >= 10"
_POST = "\\b(?:postgraduate|post-graduate|doctoral|doctorate|ph\\.?d|graduate diploma|graduate certificate|master(?:''|’)s project|master(?:''|’)s thesis|master of computing project)\\b"
_POST_TEXT = "(?:cross[- ]listed as a\\s+post(?:graduate|grad) course|as a\\s+graduate level course|open to\\s+ma,\\s*ph\\.?d)"


@query(f"""WITH nus AS (SELECT left(p_type, 2) || (p_partkey % 7) || '0' || p_partkey AS code, {listed(_TITLES)}[CAST(p_partkey % 6 AS INT) + 1] AS title, p_name AS department, p_brand AS faculty, {listed(_ABOUT)}[CAST(p_partkey % 5 AS INT) + 1] AS description, NULL AS course_type, 'NUS' AS university FROM part),
ntu AS (SELECT 'cz' || (s_suppkey % 6) || s_suppkey AS code, {listed(_TITLES)}[CAST(s_suppkey % 6 AS INT) + 1] AS title, n_name AS department, NULL AS faculty, {listed(_ABOUT)}[CAST(s_suppkey % 5 AS INT) + 1] AS description, NULL AS course_type, 'NTU' AS university FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 4) ON n_nationkey = s_nationkey),
sutd AS (SELECT '50.' || c_custkey AS code, c_name AS title, ['Architecture and Sustainable Design', 'Engineering Systems and Design', NULL, 'Science, Mathematics and Technology'][CAST(c_custkey % 4 AS INT) + 1] AS department, NULL AS faculty, {listed(_ABOUT)}[CAST(c_custkey % 5 AS INT) + 1] AS description, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Doctoral' ELSE 'Core' END AS course_type, 'SUTD' AS university FROM customer),
a AS (SELECT * FROM nus WHERE regexp_matches(upper(code), '^[A-Z]+[0-4]') AND faculty NOT IN ('Brand#1', 'Brand#2') UNION ALL SELECT * FROM ntu WHERE regexp_matches(upper(code), '^[A-Z]+[0-4]') UNION ALL SELECT * FROM sutd)
SELECT * FROM a WHERE {_LONG} AND NOT regexp_matches(lower(title), '{_POST}') AND NOT coalesce(regexp_matches(lower(course_type), '{_POST}'), false) AND NOT regexp_matches(lower(description), '{_POST_TEXT}')""")
def course_lists(t):
    """Three lists of courses in one schema: undergraduate codes and texts, ten words at least."""
    nus = t.part.select(F.concat(F.left("p_type", F.lit(2)), F.col("p_partkey") % 7, F.lit("0"), "p_partkey").alias("moduleCode"), pick(_TITLES, "p_partkey").alias("title"), F.col("p_name").alias("department"), F.col("p_brand").alias("faculty"), pick(_ABOUT, "p_partkey").alias("description"))
    ntu = t.supplier.select(F.concat(F.lit("cz"), F.col("s_suppkey") % 6, "s_suppkey").alias("code"), pick(_TITLES, "s_suppkey").alias("title"), pick(_ABOUT, "s_suppkey").alias("description"), F.col("s_nationkey").cast("string").alias("departmentMaintaining"))
    dims = t.nation.where("n_regionkey < 4").select(F.col("n_nationkey").cast("string").alias("short"), F.col("n_name").alias("department"))
    codes = F.element_at(F.array(F.array(F.lit(" asd"), F.lit("ESD")), F.array(F.lit("X"), F.lit("ESD")), F.array(F.lit("X")), F.array(F.lit("SMT"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    sutd = t.customer.select(F.concat(F.lit("50."), "c_custkey").alias("code"), F.col("c_name").alias("title"), F.when(F.col("c_mktsegment") == "BUILDING", "Doctoral").otherwise("Core").alias("course_type"), pick(_ABOUT, "c_custkey").alias("description"), codes.alias("affiliations"))
    return readers.courses(nus, ntu, sutd, dims, excluded_faculties=("Brand#1", "Brand#2"))


# ---------------------------------------------------------------- sinks


@query("SELECT c_custkey, c_name || ' é' AS c_name, c_acctbal FROM customer")
def json_lines_written(t):
    path = shared.new_path(t.spark, "sink")
    writers.json_lines(t.customer.select("c_custkey", F.concat("c_name", F.lit(" é")).alias("c_name"), "c_acctbal"), path)
    return t.spark.read.schema("c_custkey bigint, c_name string, c_acctbal double").json(path)


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def document_written(t):
    rows = t.nation.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]).alias("names"))
    path = shared.new_path(t.spark, "document")
    writers.document_file(rows, path)
    return readers.json_document(t.spark, path, "n_regionkey int, names array<string>").select("n_regionkey", F.array_join("names", ",").alias("names"))


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def table_written(t):
    path = shared.new_path(t.spark, "sink")
    writers.table(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), path, "o_orderstatus")
    return t.spark.read.schema("o_orderkey bigint, o_totalprice double, o_orderstatus string").parquet(path)


@query("SELECT p_partkey, p_brand || ' | ' || p_type AS skills FROM part")
def csv_written(t):
    path = shared.new_path(t.spark, "sink")
    writers.csv(t.part.select("p_partkey", F.array("p_brand", "p_type").alias("skills")), path)
    return t.spark.read.option("header", True).schema("p_partkey bigint, skills string").csv(path)


@query("""WITH c AS (SELECT p_type AS skill, p_name AS phrase, count(*) AS freq FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY freq DESC, phrase) AS i FROM c)
SELECT CAST(row_number() OVER (ORDER BY sum(freq) DESC, skill) AS INT) AS rule_id, skill, string_agg(phrase, ',' ORDER BY i) FILTER (i <= 6) AS patterns, CAST(sum(freq) AS BIGINT) AS support FROM r GROUP BY skill HAVING count(*) >= 2""")
def rule_table_written(t):
    grouped = t.part.groupBy(F.col("p_type").alias("skill"), F.col("p_name").alias("phrase")).agg(F.count("*").alias("freq"))
    path = shared.new_path(t.spark, "rules")
    rules.write(rules.build(grouped), path)
    return rules.read(t.spark, path).withColumn("patterns", F.array_join("patterns", ","))


@query("SELECT n_nationkey, n_name, 'lines' AS kept FROM nation UNION ALL SELECT n_nationkey, n_name, 'parquet' FROM nation")
def saved_tables(t):
    """A table saved as Parquet, and one of which only the JSON lines are left."""
    schema, rows = "n_nationkey int, n_name string", t.nation.select("n_nationkey", "n_name")
    one, other = shared.new_path(t.spark, "saved") + ".parquet", shared.new_path(t.spark, "saved")
    rows.write.parquet(one)
    rows.write.json(other + ".jsonl")
    both = [(readers.saved_table(t.spark, one, schema), "parquet"), (readers.saved_table(t.spark, other + ".parquet", schema), "lines")]
    parts = [df.withColumn("kept", F.lit(kind)) for df, kind in both]
    return parts[0].unionAll(parts[1])


@query("WITH c AS (SELECT o_orderstatus AS source, o_orderpriority AS target, count(*) AS value FROM orders GROUP BY 1, 2) SELECT *, CAST(coalesce(sum(value) OVER (PARTITION BY source ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS source_offset, CAST(coalesce(sum(value) OVER (PARTITION BY target ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS target_offset FROM c")
def flow_bands(t):
    return scope.flow_bands(t.orders.groupBy(F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("target")).agg(F.count("*").alias("value")))


@query()
def charts_drawn(t):
    """Bars of order priorities and the flow from status to priority, as SVG."""
    counts = explore.value_counts(t.orders, "o_orderpriority")
    edges = t.orders.groupBy(F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("target")).agg(F.count("*").alias("value"))
    return t.spark.createDataFrame([("bars", charts.bars(counts, "o_orderpriority", "cnt")), ("flows", charts.flows(edges))], "kind string, svg string")


# ---------------------------------------------------------------- exports and filters

_LOWERED = "array_to_string(list_filter([lower(lang), trim(lower(' Two  Words ')) , ''], lambda v: v <> ''), ',')"


@query("""SELECT source || '::' || doc_id AS id, source, CAST(doc_id AS VARCHAR) AS code, 'T ' || lang AS title, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_md5, upper(lang) || ',two words' AS skills, 3 AS num_skills
FROM documents WHERE length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 80""".replace("upper(lang)", "lower(lang)"))
def module_export(t):
    none = F.array().cast("array<string>")
    rows = t.documents.select(F.col("source").alias("university"), F.col("doc_id").cast("string").alias("code"), F.concat(F.lit(" T  "), "lang").alias("title"), F.lit("").alias("department"), F.col("text").alias("description"), F.array(F.upper("lang"), F.lit(" Two  Words "), F.lit(" ")).alias("skills"), none.alias("hard_skills"), none.alias("soft_skills"))
    out = clean_courses.module_rows(rows)
    return out.select("id", "source", "code", "title", F.md5(F.col("description").cast("binary")).alias("text_md5"), F.array_join("skills", ",").alias("skills"), "num_skills")


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, 'jobs' AS source, source AS title, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_md5, '11111' AS ssoc_code, lang AS skills, lang AS all_relevant_skills, true AS is_freshgrad, CAST(n_chars > 1000 AS INT) AS is_good_job
FROM documents WHERE length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 80""")
def job_export(t):
    rows = t.documents.select(F.col("doc_id").cast("string").alias("uuid"), F.col("source").alias("title"), F.col("text").alias("description"), F.lit("11111").alias("ssoc_code"), F.lit("111").alias("ssoc_3d"), F.lit("Permanent").alias("contract_type"), F.lit("Full Time").alias("work_type"), F.col("n_chars").cast("double").alias("avg_salary"), F.array("lang").alias("skills_clean"), (F.col("n_chars") > 1000).cast("int").alias("is_good_job"))
    out = clean_courses.job_rows(rows)
    return out.select("id", "source", "title", F.md5(F.col("description").cast("binary")).alias("text_md5"), "ssoc_code", *[F.array_join(c, ",").alias(c) for c in ("skills", "all_relevant_skills")], "is_freshgrad", "is_good_job")


@query("SELECT source, lang AS code, md5(text) AS text_md5 FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND len(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) >= 10 AND trim(text) <> '' GROUP BY source, lang, text")
def portable_modules(t):
    rows = t.documents.select("source", F.col("lang").alias("code"), F.col("source").alias("title"), F.col("text").alias("description"))
    return clean_courses.portable_modules(rows).select("source", "code", F.md5(F.col("description").cast("binary")).alias("text_md5"))


@query("SELECT o_orderkey AS uuid, CASE WHEN o_orderstatus = 'F' THEN 'clean' ELSE o_orderpriority END AS skills FROM orders WHERE o_orderstatus <> 'P'")
def portable_jobs(t):
    rows = t.orders.select(F.col("o_orderkey").alias("uuid"), F.lit("t").alias("title"), F.lit("d").alias("description"), F.when(F.col("o_orderstatus") != "P", "11111").alias("ssoc_code"), F.array("o_orderpriority").alias("skills"), F.when(F.col("o_orderstatus") == "F", F.array(F.lit("clean"))).alias("skills_clean"))
    return clean_courses.portable_jobs(rows).select("uuid", F.array_join("skills", ",").alias("skills"))


@query("SELECT o_orderkey FROM orders WHERE coalesce(CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END, true)")
def fresh_rows(t):
    flag = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return clean_courses.fresh_only(t.orders.select("o_orderkey", flag.alias("is_freshgrad"))).select("o_orderkey")


_LIKE = ["Economics ", "lecturer skills", "SQL", "x", "term paper", "terms", "", "weekly progress report", "Law", "linear algebra", "english culture", "Prerequisites", "credits"]


@query(f"""WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 14 = 13 THEN repeat(p_name, 9) ELSE {listed(_LIKE)}[CAST(p_partkey % 13 AS INT) + 1] END AS s FROM part), l AS (SELECT p_partkey, trim(lower(s)) AS s FROM s)
SELECT p_partkey, length(s) BETWEEN 2 AND 80 AND s NOT IN ('economics', 'mathematics', 'history', 'humanities', 'literature', 'sociology', 'psychology', 'biology', 'chemistry', 'physics', 'science', 'law', 'philosophy', 'english', 'culture')
AND NOT regexp_matches(s, 'course|module|student|assessment|assignment|lecturer|classroom|prerequisite|seminar|credits|term |weekly progress') AS skill FROM l""")
def skill_like_phrases(t):
    return t.part.select("p_partkey", extract.skill_like(F.when(F.col("p_partkey") % 14 == 13, F.repeat("p_name", F.lit(9))).otherwise(pick(_LIKE, "p_partkey"))).alias("skill"))


_SEEDS = ["data mining", "design of data", "year 1", "of the", "sql", "web", "c++", "students of art", "four words are many", "using tools", "credit risk", "machine learning", "ab", "the market", "cad tools"]


@query(f"""WITH s AS (SELECT p_partkey, {listed(_SEEDS)}[CAST(p_partkey % 15 AS INT) + 1] AS s FROM part), w AS (SELECT *, string_split(s, ' ') AS w FROM s)
SELECT p_partkey, len(w) BETWEEN 1 AND 3 AND length(s) BETWEEN 3 AND 80 AND NOT regexp_matches(s, '[0-9]') AND NOT regexp_matches(s, 'module|course|student|assessment|assignment|semester|lecture|tutorial|prerequisite|credit')
AND len(list_filter(w, lambda v: v NOT IN ('of', 'the', 'are', 'and', 'using'))) > 0 AND w[1] NOT IN ('design', 'using', 'analysis', 'engineering', 'research', 'work') AND NOT (len(w) = 1 AND length(w[1]) <= 3 AND w[1] NOT IN ('sql', 'cad', 'r', 'c++', 'c#')) AS valid FROM w""")
def seed_validity(t):
    return t.part.select("p_partkey", rules.valid_phrase(pick(_SEEDS, "p_partkey")).alias("valid"))


_PHRASES = ["data analysis", "machine learning", "Linear Algebra", "analysis", "research projects", "graph theory", "machine learning", "course design", "c++ programming"]
_BODIES = ["We teach machine learning, linear algebra and graph theory.", "DATA ANALYSIS and research projects; course design.", "reanalysis of data analysis.", "machine learnings", "c++ programming for all"]
_ANCHOR = "analysis|analytics|algebra|calculus|probability|statistics|regression|optimization|programming|python|database|sql|machine learning|data mining|visualization|visualisation|regulation|governance|banking|finance|investment|design|engineering|semiconductor|photovoltaic|solar|research|writing|presentation|collaboration|performance"


@query(f"""WITH b AS (SELECT p_partkey, lower({listed(_BODIES)}[CAST(p_partkey % 5 AS INT) + 1]) AS t FROM part), p AS (SELECT p_partkey, t, unnest({listed(_PHRASES)}) AS p, unnest(generate_series(1, {len(_PHRASES)})) AS i FROM b),
k AS (SELECT p_partkey, p, min(i) AS i FROM p WHERE len(string_split(p, ' ')) >= 2 AND lower(p) NOT IN ('research projects') AND NOT contains(lower(p), 'course') AND regexp_matches(lower(p), '(^|[^a-z0-9_])({_ANCHOR})([^a-z0-9_]|$)') AND contains(' ' || regexp_replace(t, '[.,;]', ' ', 'g') || ' ', ' ' || lower(p) || ' ') GROUP BY 1, 2)
SELECT b.p_partkey, coalesce((SELECT string_agg(p, ',' ORDER BY i) FROM k WHERE k.p_partkey = b.p_partkey), '') AS phrases FROM b""")
def practical_phrases(t):
    rows = t.part.select("p_partkey", pick(_BODIES, "p_partkey").alias("body"))
    return rows.select("p_partkey", F.array_join(extract.practical_phrases(F.lit(_PHRASES), "body"), ",").alias("phrases"))


# ---------------------------------------------------------------- joins


@query("""WITH s AS (SELECT p_brand AS code, p_type AS title, min([p_name, 'saved']) AS skills FROM part WHERE p_size > 10 GROUP BY 1, 2)
SELECT p_partkey, array_to_string(skills, ',') AS skills FROM part LEFT JOIN s ON code = p_brand AND title = p_type""")
def reused_skills(t):
    """Saved skills on five keys; a source without the columns and one without a match are passed over."""
    rows = t.part.select("p_partkey", F.col("p_brand").alias("code"), F.col("p_type").alias("title"), F.lit(None).cast("string").alias("department"), F.lit("d").alias("description"), F.lit("NUS").alias("university"))
    keys = [c for c in rows.columns if c != "p_partkey"]
    saved = t.part.where("p_size > 10").select(F.col("p_brand").alias("code"), F.col("p_type").alias("title"), F.lit(None).cast("string").alias("department"), F.lit("d").alias("description"), F.lit("NUS").alias("university"), F.array("p_name", F.lit("saved")).alias("skills_embedding"))
    other = saved.withColumn("university", F.lit("NTU"))
    got = clean_courses.reuse_skills(rows, [saved.drop("title"), other, saved], keys=keys)
    return got.select("p_partkey", F.array_join("skills_embedding", ",").alias("skills"))


@query("""SELECT s_suppkey AS id, coalesce(CASE WHEN n_nationkey % 4 <> 0 THEN 'D' || n_nationkey END, 'own') AS department, coalesce(CASE WHEN n_nationkey % 3 <> 0 THEN n_name END, 'faculty ' || s_nationkey) AS faculty FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 4) ON s_nationkey = n_nationkey""")
def metadata_fallback(t):
    meta = t.nation.where("n_regionkey < 4").select(F.col("n_nationkey").cast("string").alias("nation"), F.when(F.col("n_nationkey") % 4 == 0, "  ").otherwise(F.concat(F.lit("D"), "n_nationkey")).alias("department"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("faculty"))
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("nation"), F.lit("own").alias("department"), F.concat(F.lit("faculty "), "s_nationkey").alias("faculty"))
    return scope.with_metadata(rows, meta, "nation", "department", "faculty").drop("nation")


@query("""SELECT doc_id, CASE WHEN regexp_matches(t, 'law|arbitration|regulation|tax|policy|governance') THEN 'law_policy' WHEN regexp_matches(t, 'python|machine learning|algorithm|software|database|analytics|data') THEN 'computing_data'
  WHEN regexp_matches(t, 'finance|accounting|banking|marketing|investment|business') THEN 'business_finance' WHEN regexp_matches(t, 'engineering|design|prototype|architecture|systems|materials') THEN 'engineering_design'
  WHEN regexp_matches(t, 'health|medical|clinical|anatomy|biology|disease|pharma|nursing') THEN 'health_biomed' WHEN regexp_matches(t, 'literature|history|culture|philosophy|language|society|politics|religion') THEN 'humanities_social' ELSE 'other' END AS domain_bucket,
  coalesce('q' || quality, '') AS quality_skills, coalesce('t' || toxic, '') AS toxic_skills, lang AS lang_skills, lang || '1 ' || source || ' (0.5) | ' || lang || '2 ' || source || ' (1.0) | ' || lang || '3 ' || source || ' (1.5)' AS matches, '' AS review_notes
FROM (SELECT d.*, lower(text || ' ' || ['Tax policy', 'Pharma data', 'Bank systems', 'Cultures and nursing', 'none'][CAST(doc_id % 5 AS INT) + 1]) AS t FROM documents d) LEFT JOIN labels USING (doc_id)""")
def gold_set(t):
    """Three extractors' skills and a summary of matches beside each other, with blank review columns."""
    quality, toxic = (t.labels.where(F.col(c).isNotNull()).select("doc_id", F.array(F.concat(F.lit(c[0]), c)).alias("skills")) for c in ("quality", "toxic"))
    docs = t.documents.withColumn("body", F.concat_ws(" ", "text", pick(["Tax policy", "Pharma data", "Bank systems", "Cultures and nursing", "none"], "doc_id")))
    out = benchmark.side_by_side(docs, "doc_id", {"quality": quality, "toxic": toxic, "lang": t.documents.select("doc_id", F.array("lang").alias("skills"))}, description="text")
    matches = t.documents.select("doc_id", "source", "lang", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rank")).select("doc_id", "rank", F.concat("lang", "rank").alias("code"), F.col("source").alias("title"), (F.col("rank") / 2).alias("score"))
    out = out.join(benchmark.match_summary(matches, "doc_id"), "doc_id", "left")
    return out.select("doc_id", benchmark.domain("body").alias("domain_bucket"), *[F.array_join(c, ",").alias(c) for c in ("quality_skills", "toxic_skills", "lang_skills")], "matches", "review_notes")


# ---------------------------------------------------------------- scalar rules

_RAW = ["- C++ ,", "theory OF the state", " (Data)  analysis!", "Arts & Ideas: 2nd ed.", "É/tude#", "  ", "web-design / UX"]


@query(f"""WITH s AS (SELECT p_partkey, {listed(_RAW)}[CAST(p_partkey % 7 AS INT) + 1] || ' ' || p_name AS s FROM part), d AS (SELECT *, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS d FROM s)
SELECT p_partkey, regexp_replace(regexp_replace(d, '^[^A-Za-z0-9]+', ''), '[^A-Za-z0-9+#/]+$', '') AS label,
array_to_string(list_transform(string_split(d, ' '), lambda w, i: CASE WHEN i > 1 AND lower(w) IN ('and', 'or', 'of', 'for', 'to', 'in', 'on', 'with', 'the', 'a', 'an') THEN lower(w) ELSE upper(left(w, 1)) || lower(substr(w, 2)) END), ' ') AS titled,
trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS title_key, regexp_replace(regexp_replace(replace(lower(s), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM d""")
def text_labels(t):
    raw = F.concat_ws(" ", pick(_RAW, "p_partkey"), "p_name")
    return t.part.select("p_partkey", text.skill_label(raw).alias("label"), text.titled(raw).alias("titled"), text.title_key(raw).alias("title_key"), text.slug(raw).alias("slug"))


@query("""SELECT p_partkey, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace('<p class="x">' || p_name || '&nbsp;&amp; ' || p_type || '<br/>&lt;b&gt; caf&eacute;&#39;s</p>', '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&eacute;', 'é'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM part""")
def tagless_text(t):
    html = F.concat(F.lit('<p class="x">'), "p_name", F.lit("&nbsp;&amp; "), "p_type", F.lit("<br/>&lt;b&gt; caf&eacute;&#39;s</p>"))
    return t.part.select("p_partkey", fuzzy.tagless_text(html).alias("t"))


@query("SELECT p_partkey, p_name || ' ' || p_type || ' & co ' || p_brand AS t FROM part")
def page_text(t):
    """Pages parsed: scripts, styles and comments say nothing, entities are decoded."""
    html = F.concat(F.lit("<html><head><style>p {x: y}</style></head><body><!-- no --><h1>"), "p_name", F.lit("</h1>\n<p>"), "p_type", F.lit(" &amp;&nbsp; co<br></p><script>var a = '<p>b</p>';</script>"), "p_brand", F.lit("</body></html>"))
    return t.part.select("p_partkey", fuzzy.html_text(html).alias("t"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'LD ' || p_name ELSE p_name || ' page' END AS title, 'H ' || p_name AS heading, CASE WHEN p_size % 2 = 0 THEN 'told by data' ELSE p_type || ' one two' END AS description, p_brand AS credits, p_type AS terms FROM part""")
def page_fields(t):
    """Course pages to records: linked data before the page's own words, paragraphs once each up to the
    prerequisites, tables of two cells; credits and tags are no description."""
    data = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('<script type="application/ld+json">{"@type": "Course", "name": "LD '), "p_name", F.lit('", "description": "told by data"}</script>'))).otherwise('<script type="application/ld+json">{"@type": "Place", "name": "x"}</script><script type="application/ld+json">{broken</script>')
    html = F.concat(F.lit("<title>"), "p_name", F.lit(" page</title>"), data, F.lit("<h1>H "), "p_name", F.lit("</h1><p>"), "p_type", F.lit("</p><p>one two</p><p>one  two</p><p>Number of credits: 4</p><p>Tags: a</p><table><tr><td>Credits</td><td>"), "p_brand", F.lit("</td></tr><tr><td>7</td><td>x</td></tr><tr><td>a</td><td>b</td><td>c</td></tr><tr><th>Terms</th><td>"), "p_type", F.lit("</td></tr></table><h2>Prerequisites</h2><p>none</p>"))
    rows = readers.page_records(t.part.select("p_partkey", html.alias("html")), "p_partkey")
    return rows.select("p_partkey", "title", "heading", "description", F.col("details")["Credits"].alias("credits"), F.col("details")["Terms"].alias("terms"))


@query("""WITH v AS (SELECT event_id, TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'n/a' WHEN event_id % 4 = 1 THEN value || '' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS a, CASE WHEN event_id % 3 > 0 THEN value * 2 END AS b FROM events)
SELECT event_id, a, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END, 6) AS mean FROM v""")
def numbers_and_means(t):
    raw = F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(F.col("value").cast("string"))
    rows = t.events.select("event_id", numeric.number(raw).alias("a"), F.when(F.col("event_id") % 3 > 0, F.col("value") * 2).alias("b"))
    return rows.select("event_id", "a", F.round(numeric.mean_of("a", "b"), 6).alias("mean"))


_SKILLS = ["Leadership", "leadership ", "SQL", "Attention to Detail", "Teamwork", "Java", "sql", "analytical skills", "Customer Service Excellence"]


@query(f"""WITH s AS (SELECT o_orderkey, o_orderstatus, list_slice({listed(_SKILLS)}, CAST(o_orderkey % 5 AS INT) + 1, CAST(o_orderkey % 5 + o_orderkey % 4 + 2 AS INT)) AS s, [lower(o_orderstatus), 'Z', CASE WHEN o_orderstatus = 'P' THEN NULL ELSE ' esd ' END, 'SMT'] AS c FROM orders),
x AS (SELECT *, list_filter(s, lambda v: regexp_matches(lower(v), 'communication|interpersonal|teamwork|team player|leadership|problem solving|adaptability|time management|stakeholder|presentation|critical thinking|self-motivated|work independently|collaboration|customer service|attention to detail') OR lower(v) IN ('communications', 'analytical skills')) AS soft FROM s),
y AS (SELECT *, list_filter(s, lambda v: NOT list_contains(soft, v)) AS hard FROM x)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(s)), ',') AS sorted, array_to_string(list_transform(list_filter(soft, lambda v, i: list_position(list_transform(soft, lambda u: lower(trim(u))), lower(trim(v))) = i), lambda v: trim(v)), ',') AS soft,
array_to_string(list_transform(list_filter(hard, lambda v, i: list_position(list_transform(hard, lambda u: lower(trim(u))), lower(trim(v))) = i), lambda v: trim(v)), ',') AS hard,
array_to_string(list_filter(s, lambda v: v IN ('SQL', 'Java')), ',') AS known, CASE WHEN o_orderstatus = 'P' THEN 'Science, Mathematics and Technology' ELSE 'Engineering Systems and Design' END AS pillar FROM y""")
def list_rules(t):
    k = F.col("o_orderkey")
    s = F.slice(F.lit(_SKILLS), (k % 5 + 1).cast("int"), (k % 4 + 2).cast("int"))
    codes = F.array(F.lower("o_orderstatus"), F.lit("Z"), F.when(F.col("o_orderstatus") != "P", " esd "), F.lit("SMT"))
    soft, hard = arrays.split_hints(s)
    known, _ = arrays.split_members(s, ["SQL", "Java"])
    return t.orders.select("o_orderkey", F.array_join(arrays.sorted_set(s), ",").alias("sorted"), F.array_join(soft, ",").alias("soft"), F.array_join(hard, ",").alias("hard"), F.array_join(known, ",").alias("known"), arrays.mapped_first(codes, {"ESD": "Engineering Systems and Design", "SMT": "Science, Mathematics and Technology"}).alias("pillar"))


@query("""SELECT p_partkey, array_to_string(list_filter([lower(p_type), 'zzz', CASE WHEN p_size > 25 THEN 'key' END, 'two words'], lambda v: v IS NOT NULL AND v <> 'zzz'), ',') AS kept FROM part""")
def kept_skills(t):
    made = lambda s, key: F.struct(s.alias("skill"), key.alias("isKeySkill"))
    skills = F.array(made(F.lower("p_type"), F.lit(None).cast("boolean")), made(F.lit("zzz"), F.lit(False)), made(F.lit("key"), F.col("p_size") > 25), made(F.lit("two words"), F.lit(False)))
    return t.part.select("p_partkey", F.array_join(arrays.kept_skills(skills, F.concat_ws(" ", "p_name", "p_type")), ",").alias("kept"))


@query()
def string_similarity(t):
    pairs = t.part.select(F.col("p_name").alias("a")).distinct().crossJoin(F.broadcast(t.region.select(F.lower("r_name").alias("b"))))
    return pairs.select("a", "b", F.round(fuzzy.similarity("a", "b"), 6).alias("ratio"))


# ---------------------------------------------------------------- aggregates


@query("SELECT o_orderpriority, cnt FROM (SELECT o_orderpriority, count(*) AS cnt FROM orders WHERE trim(o_orderpriority) <> '' GROUP BY 1) ORDER BY cnt DESC, o_orderpriority LIMIT 1")
def dominant_value(t):
    return explore.dominant(t.orders, "o_orderpriority")


@query("SELECT count(*) < 2000 AS sampled, (SELECT count(*) FROM nation) < 2000 AS small FROM orders")
def sampled_tables(t):
    return t.spark.range(1).select(F.lit(explore.looks_sampled(t.orders)).alias("sampled"), F.lit(explore.looks_sampled(t.nation)).alias("small"))


@query("""WITH p AS (SELECT o_orderkey, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || left(o_orderpriority, 1) AS code, n_name AS title, CAST(o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.7) FROM orders WHERE o_orderstatus = 'F') AS INT) AS good
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)),
s AS (SELECT DISTINCT l_orderkey AS k, p_brand || ' ' || p_type AS skill FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT code, title, job_count, good_job_count, cnt AS top_count FROM (SELECT code, max(title) AS title, count(*) AS job_count, sum(good) AS good_job_count FROM p GROUP BY 1) JOIN (SELECT code, max(c) AS cnt FROM (SELECT code, skill, count(*) AS c FROM p JOIN s ON k = o_orderkey GROUP BY 1, 2) GROUP BY 1) USING (code)""")
def profile_from_digits(t):
    """The earlier profile: families from the digits of untidy codes, each job's skills once."""
    rows = postings(t).withColumn("skills", F.concat("skills", "skills")).withColumn("untidy", F.concat(F.lit("SSOC-"), "code5", F.lit(".0")))
    families, theirs = align.family_profiles(rows, numeric.occupation_code("untidy", 3), distinct=True)
    return families.join(theirs.groupBy("code").agg(F.max("cnt").alias("top_count")), "code").select("code", "title", "job_count", "good_job_count", "top_count")


# ---------------------------------------------------------------- scope and rules with the fixed values

_TOPICS = ["Python programming and linear algebra", "history of programming", "literary analysis of algorithms", "Quantitative empirical work", "software for ritual art", "data analysis", "language r and SQL", "nothing of note", "Historical regression: probability, statistics"]
_STRONG_SQL = r"""['\bmathematics?\b', '\bmath\b', '\bscience\b', '\bscientific\b', '\bengineering\b', '\btechnology\b', '\bcoding\b', '\bcode\b', '\bprogramming\b', '\bcomputer\b', '\bcomputation(al)?\b', '\balgorithm(s|ic)?\b', '\bdata structures?\b', '\bsoftware\b', '\bpython\b', '\br programming\b|\bprogramming in r\b|\blanguage r\b', '\bsql\b', '\bstatistics?\b', '\bstatistical\b', '\beconometric(s)?\b', '\bregression\b', '\bprobability\b', '\bstochastic\b', '\btime series\b', '\boptimization\b|\boptimisation\b', '\boperations research\b', '\blinear algebra\b', '\bcalculus\b', '\bnumerical (method|methods)\b', '\bmachine learning\b', '\bdeep learning\b', '\bneural network(s)?\b', '\bdata mining\b', '\bforecast(ing)?\b', '\bsimulation\b', '\bphysics?\b', '\bchemistry\b', '\bmolecular biology\b', '\bcell biology\b', '\bgenetics?\b', '\bbiotechnology\b', '\bbiomedical\b', '\bbioinformatics\b', '\banatomy\b', '\bphysiology\b', '\bbiochemistry\b', '\bmicrobiology\b', '\bimmunology\b']"""


@query(rf"""WITH t AS (SELECT doc_id, lower(text || ' ' || {listed(_TOPICS)}[CAST(doc_id % 9 AS INT) + 1]) AS t FROM documents),
p AS (SELECT unnest({_STRONG_SQL}) AS p), s AS (SELECT doc_id, count(*) FILTER (regexp_matches(t, p)) AS n FROM t, p GROUP BY 1),
w AS (SELECT doc_id, n, regexp_matches(t, '\bquantitative\b')::INT + regexp_matches(t, '\banalytics?\b')::INT + regexp_matches(t, '\bmathematical model(l)?ing\b')::INT + regexp_matches(t, '\bempirical\b')::INT + regexp_matches(t, '\bdata analysis\b')::INT AS weak,
  regexp_matches(t, '\b(literary|film|critical|textual|historical|philosophical) analysis\b') AS blocked, regexp_matches(t, '\bsociolog(y|ical)\b|\banthropolog(y|ical)\b|\bcultural\b|\bethnograph(y|ic)\b|\bhistorical\b|\bhistory\b|\bphilosoph(y|ical)\b|\bliterature\b|\bart(s|istic)?\b|\bmortuary\b|\bfunerar(y|ies)\b|\britual(s)?\b') AS against FROM t JOIN s USING (doc_id))
SELECT doc_id, CAST(CASE WHEN blocked THEN 0 ELSE 2 * n + weak END AS INT) AS signal, CASE WHEN blocked THEN 0 ELSE 2 * n + weak END >= 2 AND NOT (n <= 1 AND against) AS stem FROM w""")
def stem_signal(t):
    body = F.concat_ws(" ", "text", pick(_TOPICS, "doc_id"))
    return t.documents.select("doc_id", scope.keyword_signal(body).alias("signal"), scope.keyword_stem(body).alias("stem"))


_DEPARTMENTS = ["School of Computing", "Law", "Data & Society", "Registry", "Centre for Future-ready Graduates"]


@query(rf"""WITH t AS (SELECT doc_id, lower(text || ' ' || {listed(_TOPICS)}[CAST(doc_id % 9 AS INT) + 1]) AS t, lower({listed(_DEPARTMENTS)}[CAST(doc_id % 5 AS INT) + 1]) AS d, CASE source WHEN 'src0' THEN 'clear_stem' WHEN 'src1' THEN 'clear_non_stem' ELSE 'unclear_or_mixed' END AS base FROM documents),
p AS (SELECT unnest(['\bstatistic(s|al)?\b', '\beconometric(s)?\b', '\bregression\b', '\bprobability\b', '\bstochastic\b', '\btime series\b', '\boptimization|optimisation\b', '\boperations research\b', '\blinear algebra\b', '\bcalculus\b', '\bnumerical (method|methods)\b', '\bmachine learning\b', '\bdeep learning\b', '\bneural network(s)?\b', '\bdata mining\b', '\bforecast(ing)?\b', '\bsimulation\b', '\balgorithm(s|ic)?\b', '\bpython\b', '\br programming\b|\bprogramming in r\b|\blanguage r\b', '\bsql\b', '\bprogramming\b']) AS p),
q AS (SELECT doc_id, CASE WHEN regexp_matches(any_value(t), '\b(literary|film|critical|textual|historical|philosophical) analysis\b') THEN 0 ELSE 2 * count(*) FILTER (regexp_matches(t, p)) + any_value(regexp_matches(t, '\bquantitative\b')::INT + regexp_matches(t, '\banalytics?\b')::INT + regexp_matches(t, '\bmathematical model(l)?ing\b')::INT + regexp_matches(t, '\bcomputational\b')::INT + regexp_matches(t, '\bempirical\b')::INT + regexp_matches(t, '\bdata analysis\b')::INT) END AS signal FROM t, p GROUP BY 1),
f AS (SELECT *, CASE WHEN base = 'unclear_or_mixed' AND regexp_matches(d, '\bcomputing\b|\bdata\b') THEN 'clear_stem' WHEN base = 'unclear_or_mixed' AND regexp_matches(d, '\blaw\b') THEN 'clear_non_stem' ELSE base END AS first FROM t JOIN q USING (doc_id))
SELECT doc_id, CASE WHEN d LIKE 'centre for future%' THEN 'clear_non_stem' WHEN first <> 'clear_stem' AND signal >= 3 THEN 'quant_non_stem' ELSE first END AS scope_bucket,
CASE WHEN d LIKE 'centre for future%' THEN 'excluded_future_ready_graduates_module' WHEN first <> 'clear_stem' AND signal >= 3 THEN CASE WHEN first = 'clear_non_stem' THEN 'quant_semantic_override_non_stem' ELSE 'quant_semantic_override_unclear' END
  WHEN first <> base THEN CASE WHEN first = 'clear_stem' THEN 'department_text_heuristic_stem' ELSE 'department_text_heuristic_non_stem' END ELSE 'metadata' END AS scope_reason FROM f""")
def scope_earlier_values(t):
    rows = t.documents.withColumns({"body": F.concat_ws(" ", "text", pick(_TOPICS, "doc_id")), "dept": pick(_DEPARTMENTS, "doc_id"), "base": scope.bucket("source", ["src0"], ["src1"])})
    bucket, reason = scope.earlier_cascade("base", F.lit("metadata"), "dept", "body")
    return rows.select("doc_id", bucket.alias("scope_bucket"), reason.alias("scope_reason"))


# ---------------------------------------------------------------- search


@query(f"""SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(list_filter([{_NORM.format("p_type || '!'")}, {_NORM.format("upper(p_brand)")}, ''], lambda v: v <> ''))), ',') AS skills, {_NORM.format("p_name || ', the'")} AS title_norm, array_to_string({_TOK.format(_NORM.format("p_name || ', the'"))}, ',') AS title_tokens, true AS available, (SELECT count(*) FROM part) < 2000 OR (SELECT count(*) FROM supplier) < 2000 AS is_sampled FROM part""")
def canonical_loader(t):
    modules, jobs = shared.new_path(t.spark, "modules"), shared.new_path(t.spark, "jobs")
    t.part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(", the")).alias("title"), F.array(F.concat("p_type", F.lit("!")), F.upper("p_brand"), F.lit(""), "p_type").alias("canonical_skills")).write.parquet(modules)
    t.supplier.select(F.col("s_suppkey").alias("post_id"), F.array("s_name").alias("canonical_skills")).write.parquet(jobs)
    rows, _, status = search.load_canonical(t.spark, modules, jobs)
    return rows.select("id", F.array_join("skills", ",").alias("skills"), "title_norm", F.array_join("title_tokens", ",").alias("title_tokens"), F.lit(status["available"]).alias("available"), F.lit(status["is_sampled"]).alias("is_sampled"))


@query(f"SELECT DISTINCT skill FROM (SELECT {_NORM.format('p_type')} AS skill FROM part UNION SELECT {_NORM.format('p_brand')} FROM part UNION SELECT unnest(string_split(p_name, ' ')) FROM part UNION SELECT lower(s_name) FROM supplier) WHERE skill <> ''")
def search_vocabulary(t):
    modules = t.part.select(F.split("p_name", " ").alias("skills"))
    canonical = t.supplier.select(F.array(F.lower("s_name"), F.lit("")).alias("skills"))
    return search.vocabulary((_jobs(t), "skill_set"), (modules, "skills"), (canonical, "skills"))


@query(_SEARCH_SQL + " SELECT 'canon ' || p_size AS skill, round(sum(greatest(search_score, 0.1) / sqrt(rank)), 4) AS cnt FROM b JOIN part ON uuid = p_partkey WHERE rank <= 25 AND p_size > 15 GROUP BY 1")
def canonical_job_profile(t):
    """Jobs found, by their canonical rows; those without one do not count."""
    _, found = _found(t)
    canonical = t.part.where("p_size > 15").select(F.col("p_partkey").alias("post_id"), F.array(F.concat(F.lit("canon "), "p_size")).alias("skills"))
    return search.canonical_profile(search.ranked(found, 25), canonical).withColumn("cnt", F.round("cnt", 4))


@query(_SEARCH_SQL + """, w AS (SELECT work_type, count(*) AS c FROM b JOIN j USING (uuid) WHERE rank <= 5 GROUP BY 1)
SELECT (SELECT count(*) FROM b) AS matched_job_count, count(*) AS returned_job_count, CAST(floor(coalesce(sum(avg_salary), 0) / greatest(1, count(*))) AS BIGINT) AS average_salary, coalesce((SELECT work_type FROM w ORDER BY c DESC, work_type LIMIT 1), 'mixed') AS dominant_work_type FROM b WHERE rank <= 5""")
def search_statistics(t):
    _, found = _found(t)
    best = search.ranked(found, 25)
    stats = search.statistics(found, best)
    names = ["matched_job_count", "returned_job_count", "average_salary", "dominant_work_type"]
    return t.spark.createDataFrame([tuple(stats[n] for n in names)], "matched_job_count bigint, returned_job_count bigint, average_salary bigint, dominant_work_type string")


@query()
def search_response(t):
    """The whole response for one query, as JSON."""
    jobs = _jobs(t)
    modules = t.part.select(F.col("p_partkey").alias("module_id"), F.lit("NUS").alias("source"), text.search_key("p_name").alias("title_norm"), text.tokens("p_name").alias("title_tokens"), F.array_distinct(F.array(text.search_key("p_type"), text.search_key("p_brand"))).alias("skills"))
    got = search.answer(jobs, modules, "full time green economy brand 3 above 3k", ["economy", "brand 3"])
    return t.spark.createDataFrame([(search.response(got),)], "response string")


_QUERIES = ["Part-time data analyst above 3k at NUS", "fresh graduate SQL jobs paying over $4,500", "full time research role, max 6.5k, from Nanyang Technological University Singapore only", "economy brand 3", "junior designer below 2000 sutd", "pay 3000 marketing"]


@query(f"""WITH q AS (SELECT unnest({listed(_QUERIES)}) AS q), n AS (SELECT q, lower(q) AS l, trim(regexp_replace(regexp_replace(lower(q), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM q),
c AS (SELECT *, regexp_replace(regexp_replace(l, '(?:\\b(?:salary|pay)\\s+)?(?:above|over|at least|min(?:imum)?|more than|below|under|up to|less than|max(?:imum)?)\\s*\\$?\\s*[0-9][0-9,]*(?:\\.[0-9]+)?\\s*k?\\b|\\b(?:salary|pay)\\s+\\$?\\s*[0-9][0-9,]*(?:\\.[0-9]+)?\\s*k?\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g') AS c1 FROM n),
e AS (SELECT *, trim(regexp_replace(regexp_replace(c1, '\\b(?:full time|part time|national university of singapore|nus|nanyang technological university singapore|nanyang technological university|ntu|singapore university of technology and design|sutd|only|from)\\b', ' ', 'g'), ' +', ' ', 'g')) AS core FROM c),
a AS (SELECT *, regexp_extract(l, '(?:above|over|at least|min(?:imum)?|more than)\\s*\\$?\\s*([0-9][0-9,]*(?:\\.[0-9]+)?\\s*k?)\\b', 1) AS lo, regexp_extract(l, '(?:below|under|up to|less than|max(?:imum)?)\\s*\\$?\\s*([0-9][0-9,]*(?:\\.[0-9]+)?\\s*k?)\\b', 1) AS hi FROM e)
SELECT q, core, CASE WHEN contains(n, 'part time') THEN 'Part Time' WHEN contains(n, 'full time') THEN 'Full Time' END AS work_type,
CASE WHEN contains(' ' || n || ' ', ' nus ') OR contains(' ' || n || ' ', ' national university of singapore ') THEN 'NUS' WHEN contains(' ' || n || ' ', ' ntu ') OR contains(' ' || n || ' ', ' nanyang technological university ') THEN 'NTU' WHEN contains(' ' || n || ' ', ' sutd ') OR contains(' ' || n || ' ', ' singapore university of technology and design ') THEN 'SUTD' END AS school,
CAST(CASE WHEN lo <> '' THEN CAST(replace(replace(lo, ',', ''), 'k', '') AS DOUBLE) * CASE WHEN lo LIKE '%k' THEN 1000 ELSE 1 END END AS BIGINT) AS salary_min, CAST(CASE WHEN hi <> '' THEN CAST(replace(replace(hi, ',', ''), 'k', '') AS DOUBLE) * CASE WHEN hi LIKE '%k' THEN 1000 ELSE 1 END END AS BIGINT) AS salary_max,
CASE WHEN regexp_matches(n, 'entry level|fresh grad|fresh grads|fresh graduate|fresh graduates|junior|no experience') THEN 1 END AS experience_max,
array_to_string(list_filter(['brand 3', 'data analyst', 'economy', 'marketing', 'sql'], lambda s: s <> 'marketing' AND contains(' ' || core || ' ', ' ' || s || ' ')), ',') AS skills FROM a""")
def query_intents(t):
    got = [search.interpret(q, ["SQL", "marketing", "data analyst", "economy", "brand 3"]) for q in _QUERIES]
    rows = [(i.raw, i.core, i.work_type, i.school, i.salary_min, i.salary_max, i.experience_max, ",".join(i.skills)) for i in got]
    return t.spark.createDataFrame(rows, "q string, core string, work_type string, school string, salary_min bigint, salary_max bigint, experience_max int, skills string")


# ---------------------------------------------------------------- extraction by similarity (no SQL: the tests hold it against plain Python)


def _vocabulary(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_type").alias("skill")).union(t.part.select("p_brand")).distinct()


def _described(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat("p_name", F.lit(". "), "p_type", F.lit(" parts; "), "p_brand").alias("body"), F.array("p_name", F.concat_ws(" ", F.lower("p_type"), F.lit("design")), "p_brand").alias("phrases"))


@query()
def chunk_skills(t):
    return extract.chunk_similarity(_described(t), "p_partkey", "body", _vocabulary(t), embed.HashingEmbedder())


@query()
def normalised_skills(t):
    return extract.normalised_skills(_described(t), "p_partkey", "body", "phrases", _vocabulary(t), embed.HashingEmbedder(), least=0.4, evidence={"PROMO": ["promo design"], "STANDARD": ["never said"]})


@query()
def direct_skills(t):
    return extract.direct_skills(_described(t), "p_partkey", "body", _vocabulary(t), embed.HashingEmbedder())


@query()
def gated_skills(t):
    return extract.gated_skills(_described(t), "p_partkey", "body", "phrases", _vocabulary(t), embed.HashingEmbedder(), least_map=0.4, least_text=0.2)


@query()
def ranked_phrases(t):
    """The phrases of whole texts most like the text, by likeness alone."""
    return extract.ranked_ngrams(t.documents, "doc_id", "text", embed.HashingEmbedder(128), n=30, most_chars=None)


@query()
def grouped_phrases(t):
    phrases = t.part.groupBy(F.lower(F.concat_ws(" ", "p_type", F.element_at(F.split("p_name", " "), 1))).alias("phrase")).agg(F.count("*").alias("freq"))
    return rules.grouped_by_skill(phrases, _vocabulary(t).select(F.lower("skill").alias("skill")), embed.HashingEmbedder())
