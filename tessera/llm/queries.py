"""The queries ``opN_<name>``: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate as _decontaminate
from tessera.llm import licenses as _licenses
from tessera.llm import line_dedup as _line_dedup
from tessera.llm import lm_score as _lm
from tessera.llm import minhash as _minhash
from tessera.llm import mixing as _mixing
from tessera.llm import piece_encoding as _pieces
from tessera.llm import spelling as _spelling
from tessera.llm import token_counts as _tokens
from tessera.llm import topk as _topk
from tessera.llm import toxicity as _toxicity
from tessera.llm import vector_codes as _codes
from tessera.llm import warc as _warc

#: The vocabulary of op3, one of the public tokenizers' files.
TOKENIZER = "byte_bpe_50k.json"
#: The model of op12, another of them.
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "removed_lines", "removed_words", "n_links", "owner", "text")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return _tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), token_limit=512)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts have no paths of their own: a source is a tree, a language a directory in it."""
    return _licenses.scan(_table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warc.round_trip(_table(spark, sf_dir, "pages"), min_bytes=0)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lm.lm_scores(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(_table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes.vector_codes(_table(spark, sf_dir, "embeddings"), n_parts=16, n_entries=64, rounds=2, scale=256)


def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = _pieces.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelling.spelling_variants(_table(spark, sf_dir, "documents"), one_in=199, least_length=6, least_count=5, times=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_decontamination, op3_token_counts, op4_toxicity, op5_licenses, op6_warc, op7_lm_score, op8_mixing, op9_exact_topk, op10_minhash, op11_vector_codes, op12_piece_encoding, op13_spelling)}


def _codes_sql() -> str:
    """Two rounds of assignment and floored means, then the last assignment."""
    steps = ["b0 AS MATERIALIZED (SELECT part, place AS entry, x FROM p WHERE place < 64)"]
    for k in range(3):
        steps.append(
            f"a{k} AS MATERIALIZED (SELECT p.place, p.part, any_value(p.x) AS x, min(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))) * 64 + b.entry) AS best"
            f" FROM p JOIN b{k} b ON b.part = p.part GROUP BY 1, 2)"
        )
        if k < 2:
            steps.append(
                f"m{k} AS (SELECT part, best % 64 AS entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS c FROM a{k}, range(1, 65) AS t(i) WHERE i <= len(x) GROUP BY 1, 2, 3),\n"
                f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(any_value(n.x), any_value(b.x)) AS x"
                f" FROM b{k} b LEFT JOIN (SELECT part, entry, list(c ORDER BY i) AS x FROM m{k} GROUP BY 1, 2) n ON n.part = b.part AND n.entry = b.entry GROUP BY 1, 2)"
            )
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
         row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS place
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT place, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x FROM v, range(16) AS t(part)),
{",\n".join(steps)},
c AS (SELECT place, string_agg(printf('%02x', CAST(best % 64 AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM c JOIN v USING (place)
"""


def _license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    told = [("false", *t) for t in _licenses.ALL_TEMPLATES] + [("true", *t) for t in _licenses.FULL_TEXTS]
    rows = ", ".join(f"({i}, {whole}, {quoted(name)}, {quoted(text)})" for i, (whole, name, text) in enumerate(told))
    trigger, end, wrapped, term = _licenses.TRIGGER, _licenses.SENTENCE_END, _licenses.WRAPPED_END, _licenses.TERM
    cosine = """
     SELECT m.uid, m.pos, template, license, g.n, round(sum(w * tw) / (norm * t_norm), 6) AS cosine
     FROM {0} m JOIN (SELECT uid, pos, sqrt(sum(w * w)) AS norm, sum(tf) AS n FROM {0} GROUP BY 1, 2) g ON g.uid = m.uid AND g.pos = m.pos
     JOIN tw ON tw.term = m.term AND {1} GROUP BY m.uid, m.pos, template, license, g.n, norm, t_norm"""
    return f"""
WITH t AS (SELECT * FROM (VALUES {rows}) AS v(template, is_whole, license, notice)),
tt AS (SELECT template, is_whole, license, term, CAST(count(*) AS DOUBLE) AS tf
       FROM (SELECT template, is_whole, license, unnest(regexp_extract_all(lower(notice), '{term}')) AS term FROM t) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS uid, doc_id, text, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path FROM documents),
l AS (SELECT uid, text, regexp_split_to_array(text, '{end}') AS s, list_filter(regexp_split_to_array(text, '{wrapped}'), lambda x: contains(x, chr(10))) AS r FROM d WHERE regexp_matches(text, '{trigger}')),
s AS (SELECT uid, len(s) AS n_plain, unnest(list_concat(s, r)) AS sentence, unnest(generate_series(0, len(s) + len(r) - 1)) AS pos FROM l),
w AS (SELECT uid, pos, wrapped, term, CAST(count(*) AS DOUBLE) AS tf
      FROM (SELECT uid, pos, pos >= n_plain AS wrapped, unnest(regexp_extract_all(lower(sentence), '{term}')) AS term FROM s WHERE regexp_matches(sentence, '{trigger}')) GROUP BY ALL),
a AS (SELECT uid, unnest(regexp_extract_all(lower(text), '{term}')) AS term FROM l),
x AS (SELECT uid FROM a GROUP BY 1 HAVING count(*) FILTER (term IN (SELECT term FROM tt WHERE is_whole)) >= {_licenses.VOCABULARY_SHARE} * count(*)),
y AS (SELECT uid, 0 AS pos, term, CAST(count(*) AS DOUBLE) AS tf FROM a WHERE uid IN (SELECT uid FROM x) GROUP BY ALL),
n AS (SELECT count(*) + {len(told)} AS n FROM (SELECT DISTINCT uid, pos FROM w)),
i AS (SELECT v.term, ln((1.0 + n) / (1.0 + t_df + coalesce(df, 0))) + 1 AS idf
      FROM (SELECT term, count(*) AS t_df FROM tt GROUP BY 1) v
      LEFT JOIN (SELECT term, count(*) AS df FROM w GROUP BY 1) f ON v.term = f.term, n),
tw AS (SELECT template, is_whole, license, tt.term, tf * idf AS tw, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS t_norm FROM tt JOIN i USING (term)),
m AS (SELECT uid, pos, w.term, tf, tf * coalesce(idf, ln((1.0 + n) / 2.0) + 1) AS w FROM w LEFT JOIN i USING (term), n),
my AS (SELECT uid, pos, y.term, tf, tf * coalesce(idf, ln((1.0 + n) / 2.0) + 1) AS w FROM y LEFT JOIN i USING (term), n),
c AS ({cosine.format("m", "NOT is_whole")}),
b AS (SELECT c.*, (SELECT any_value(wrapped) FROM w WHERE w.uid = c.uid AND w.pos = c.pos) AS wrapped, row_number() OVER (PARTITION BY uid, pos ORDER BY cosine DESC, template) AS r FROM c WHERE cosine >= {_licenses.LEAST_COSINE}),
o AS (SELECT *, greatest(coalesce(sum(n) FILTER (NOT wrapped) OVER (PARTITION BY uid), 0), coalesce(sum(n) FILTER (wrapped) OVER (PARTITION BY uid), 0)) AS told, row_number() OVER (PARTITION BY uid ORDER BY cosine DESC, pos) AS q FROM b WHERE r = 1),
e AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY cosine DESC, template) AS r FROM ({cosine.format("my", "is_whole")}) WHERE cosine >= {_licenses.LEAST_WHOLE}),
k AS (SELECT d.doc_id, d.path, regexp_replace(d.path, '/?[^/]*$', '') AS dir, coalesce(e.license, o.license) AS license, coalesce(e.cosine, o.cosine) AS score,
             e.license IS NOT NULL OR coalesce(told >= {_licenses.FILE_SHARE} * len(regexp_extract_all(lower(text), '{term}')), false) AS is_file
      FROM d LEFT JOIN o ON o.uid = d.uid AND o.q = 1 LEFT JOIN e ON e.uid = d.uid AND e.r = 1),
u AS (SELECT dir, license, score, row_number() OVER (PARTITION BY dir ORDER BY score DESC, path, license) AS r FROM k WHERE is_file),
h AS (SELECT x.dir, u.license, u.score, row_number() OVER (PARTITION BY x.dir ORDER BY length(u.dir) DESC) AS r
      FROM (SELECT DISTINCT dir FROM k) x JOIN u ON u.r = 1 AND (u.dir = x.dir OR u.dir = '' OR starts_with(x.dir, u.dir || '/')))
SELECT doc_id, path, coalesce(k.license, h.license) AS license,
       CASE WHEN is_file THEN 'file' WHEN k.license IS NOT NULL THEN 'header' WHEN h.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS found,
       coalesce(k.score, h.score) AS score
FROM k LEFT JOIN h ON h.dir = k.dir AND h.r = 1
"""


ORACLE: dict[str, str] = {
    # deletes every stretch of lines of 20 words that an earlier document has.  Patience alignment leaves a
    # few lines more where a line recurs more often than in the earlier document: in none of the documents
    # at scale 0.01, in 3 of 10,000 at scale 0.1
    "op1_line_dedup": """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS raw FROM documents),
x AS (SELECT doc_id, unnest(raw) AS line, unnest(generate_series(1, len(raw))) AS pos FROM d),
w AS (SELECT doc_id, pos, trim(line, ' ') AS line, length(trim(line, ' ')) - length(replace(trim(line, ' '), ' ', '')) + 1 AS n FROM x WHERE trim(line, ' ') <> ''),
l AS (SELECT *, row_number() OVER o AS r, sum(n) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
t AS (SELECT doc_id, list(line ORDER BY r) AS lines FROM l GROUP BY 1),
s AS (SELECT DISTINCT a.doc_id, a.r AS s, b.r AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.r >= a.r AND b.c - a.c + a.n >= 20 AND (b.c - b.n - a.c + a.n < 20 OR b.c - a.c < 20)),
h AS (SELECT doc_id, s, e, md5(array_to_string(lines[s:e], chr(10))) AS h FROM s JOIN t USING (doc_id)),
f AS (SELECT h, min(doc_id) AS owner FROM h GROUP BY 1),
k AS (SELECT doc_id, s, e, owner FROM h JOIN f USING (h) WHERE owner < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(s, e)) AS r FROM k),
z AS (SELECT l.doc_id, l.pos, l.n FROM l JOIN g USING (doc_id, r)),
c AS (SELECT doc_id, count(*) AS removed_lines, sum(n) AS removed_words FROM z GROUP BY 1),
n AS (SELECT doc_id, count(DISTINCT owner) AS n_links, min(owner) AS owner FROM k GROUP BY 1),
y AS (SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.pos) AS text FROM x LEFT JOIN z USING (doc_id, pos) WHERE z.pos IS NULL AND x.doc_id IN (SELECT doc_id FROM c) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(raw), 0) AS INT) AS n_lines, CAST(coalesce(removed_lines, 0) AS INT) AS removed_lines, CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words, coalesce(n_links, 0) AS n_links, owner,
       CASE WHEN removed_lines IS NULL THEN d.text ELSE coalesce(y.text, '') END AS text
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN y USING (doc_id)
""",
    "op10_minhash": """
WITH RECURSIVE d AS (SELECT text, min(doc_id) AS id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY 1),
w AS (SELECT id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM d),
g AS (SELECT id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS gram FROM (SELECT id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w)),
m AS (SELECT id, gram, row_number() OVER (PARTITION BY id, gram) AS nth FROM g),
s AS (SELECT id, count(*) AS size FROM m GROUP BY 1),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS low FROM m a JOIN m b ON a.gram = b.gram AND a.nth = b.nth AND a.id < b.id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE low / (x.size + y.size - low) >= 0.8),
p AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, b AS near FROM p UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.near),
c AS (SELECT node, min(near) AS least FROM r GROUP BY 1)
SELECT t.doc_id, CASE WHEN t.text IS NULL THEN t.doc_id ELSE least(d.id, coalesce(c.least, d.id)) END AS class_id, coalesce(n_copies, 1) AS n_copies
FROM documents t LEFT JOIN d ON d.text = t.text LEFT JOIN c ON c.node = d.id
""",
    "op5_licenses": _license_sql(),
    "op11_vector_codes": _codes_sql(),
    "op13_spelling": """
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
h AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_concat([4294967295], list_transform(range(strlen(s)), lambda i: CAST('0x' || substr(hex(s), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
           lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) AS h
  FROM (SELECT run, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM d), t),
r AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM r WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
x AS MATERIALIZED (SELECT word, p, substr(word, 1, p) || substr(word, p + 2) AS less FROM (SELECT word, unnest(range(length(word))) AS p FROM w)),
e AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.less = b.less AND a.p = b.p AND a.word <> b.word
  UNION SELECT x.word, w.word FROM x JOIN w ON w.word = x.less
  UNION SELECT w.word, x.word FROM x JOIN w ON w.word = x.less),
g AS (SELECT e.a AS word, count(*) AS n_near, max(w.n) AS most FROM e JOIN w ON w.word = e.b GROUP BY 1),
b AS (SELECT g.word, min(w.word) AS near FROM g JOIN e ON e.a = g.word JOIN w ON w.word = e.b AND w.n = g.most GROUP BY 1),
f AS MATERIALIZED (
  SELECT w.word, CASE WHEN most >= 5 * w.n THEN b.near END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN most END AS form_n
  FROM w LEFT JOIN g USING (word) LEFT JOIN b USING (word)),
z AS (SELECT word, word AS at FROM w UNION ALL SELECT z.word, f.form FROM z JOIN f ON f.word = z.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, z.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM f JOIN z USING (word) JOIN f l ON l.word = z.at WHERE l.form IS NULL
""",
    "op8_mixing": """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, place % 3 + 1 AS w, source_size * 3 AS cap FROM r),
f AS (
  SELECT cap, w, row_number() OVER (ORDER BY cap / w, place) AS i,
         (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bys
  FROM w),
l AS (SELECT lft, bys FROM f WHERE lft / bys <= cap / w ORDER BY i LIMIT 1),
t AS (SELECT source, source_size, place, least(CAST(cap AS DOUBLE), CAST(lft * w AS DOUBLE) / CAST(bys AS DOUBLE)) AS target FROM w, l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, (ARRAY[0.5, 0.0, -0.5])[CAST(place % 3 + 1 AS INTEGER)]::DOUBLE AS a,
         CAST(round(t.target) AS BIGINT) AS due,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, greatest(0, least(size, due - start)) AS p0,
         greatest(0, least(size, due - start - source_size)) AS p1, greatest(0, least(size, due - start - 2 * source_size)) AS p2 FROM p),
x AS (SELECT *, (start + p0 / 2) / target AS x0, (start + source_size + p1 / 2) / target AS x1, (start + 2 * source_size + p2 / 2) / target AS x2 FROM q)
SELECT doc_id, size, source_size, target, CAST(p0 + p1 + p2 AS BIGINT) AS taken,
       CASE WHEN p0 > 0 THEN CASE WHEN a = 0 THEN x0 ELSE (sqrt((1 - a) * (1 - a) + 4 * a * x0) - (1 - a)) / (2 * a) END END AS position,
       CASE WHEN p1 > 0 THEN CASE WHEN a = 0 THEN x1 ELSE (sqrt((1 - a) * (1 - a) + 4 * a * x1) - (1 - a)) / (2 * a) END END AS position_2,
       CASE WHEN p2 > 0 THEN CASE WHEN a = 0 THEN x2 ELSE (sqrt((1 - a) * (1 - a) + 4 * a * x2) - (1 - a)) / (2 * a) END END AS position_3
FROM x
""",
    "op6_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, count(*) AS c, max(page_id) AS m FROM p WHERE n >= 0 GROUP BY h),
b AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, 5 * k + 1, 5) AS BIGINT) >> s) & 31) + 1, 1), '' ORDER BY k, s DESC) AS d
  FROM g, range(8) AS t(k), (VALUES (0), (5), (10), (15)) AS u(s) GROUP BY h)
SELECT p.page_id, p.n AS payload_bytes, b.d AS payload_digest,
       CASE WHEN p.page_id IS NOT DISTINCT FROM g.m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM g.m THEN g.m END AS refers_to
FROM p JOIN g USING (h) JOIN b USING (h)
""",
    "op9_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""
}
