"""Rules from a corpus: seed phrases, their grouping, and rule tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import values
from tessera.functions import text
from tessera.functions.grams import counted
from tessera.functions.numeric import specificity
from tessera.operators.embed import Embedder, nearest


def valid_phrase(
    x: Column | str,
    stop: Sequence[str] = values.STOP_WORDS,
    actions: Sequence[str] = values.ACTION_WORDS,
    talk: Sequence[str] = values.SEED_TALK,
    short: Sequence[str] = values.SHORT_SKILLS,
    least_words: int = 1,
    most_words: int = 3,
) -> Column:
    """Whether a phrase may seed a rule: words and length in bounds, no digits, no course talk, not all
    stop words, not all or first an action word, no single short word but the listed ones."""
    p = text.col(x)
    words = F.split(F.trim(p), "\\s+")
    first = F.get(words, F.lit(0))
    one_short = (F.size(words) == 1) & (F.length(first) <= 3) & ~first.isin(*short)
    fine = F.size(words).between(least_words, most_words) & F.length(p).between(3, 80) & ~p.rlike("[0-9]") & ~p.rlike("|".join(talk))
    return F.coalesce(fine & F.exists(words, lambda w: ~w.isin(*stop)) & ~first.isin(*actions) & ~one_short, F.lit(False))


def phrase_counts(rows: DataFrame, words: Column | str, low: int = 1, high: int = 3) -> DataFrame:
    """(phrase, freq, docs) of all n-grams of the words of ``rows``, each row a document.

    Texts are read once.  A task counts blocks of documents and spells a phrase out once for each of them;
    what is shuffled is a row for each phrase of a task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from counted(batch.column(0), low, high)

    found = rows.select(text.col(words).alias("w")).mapInArrow(run, "phrase string, freq bigint, docs bigint")
    return found.groupBy("phrase").agg(F.sum("freq").alias("freq"), F.sum("docs").alias("docs"))


def seeds(counts: DataFrame, rows: int | DataFrame, least: int = 5, most_share: float = 0.12) -> DataFrame:
    """Phrases frequent enough and not everywhere, by specificity."""
    total = rows if isinstance(rows, DataFrame) else None
    out = counts.crossJoin(total.agg(F.count("*").alias("_t"))) if total is not None else counts.withColumn("_t", F.lit(rows))
    out = out.where((F.col("freq") >= least) & (F.col("docs") <= F.col("_t") * most_share)).drop("_t")
    return out.withColumn("specificity", F.round(specificity("freq", "phrase"), 6))


def build(grouped: DataFrame, least_patterns: int = 2, most_patterns: int = 6, most_rules: int = 120) -> DataFrame:
    """(rule_id, skill, patterns, support) from (skill, phrase, freq): a rule's patterns are its most
    frequent phrases; rules are ranked by support."""
    order = Window.partitionBy("skill").orderBy(F.desc("freq"), "phrase")
    rules = grouped.withColumn("i", F.row_number().over(order)).groupBy("skill").agg(F.sum("freq").alias("support"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("i") <= most_patterns, F.struct("i", "phrase")))), lambda s: s["phrase"]).alias("patterns"))
    best = rules.where(F.col("n") >= least_patterns).orderBy(F.desc("support"), "skill").limit(most_rules)  # the window then sees these alone
    return best.withColumn("rule_id", F.row_number().over(Window.orderBy(F.desc("support"), "skill"))).select("rule_id", "skill", "patterns", "support")


def grouped_by_skill(phrases: DataFrame, framework: DataFrame, embedder: Embedder, least: float = 0.44) -> DataFrame:
    """(skill, phrase, freq, near): seed phrases (phrase, freq) under the framework's skill that each is
    nearest to, if near enough; what ``build`` makes rules of."""
    found = nearest(phrases.select("phrase").distinct(), framework.select(F.col("skill").alias("v"), "skill"), embedder, "phrase", "v", "skill")
    return phrases.select("phrase", "freq").join(found.where(F.col("near") >= least), "phrase").select("skill", "phrase", "freq", "near")


def write(rules: DataFrame, path: str) -> None:
    """A rule table as Parquet: rules are data, and nothing is generated as code."""
    rules.select("rule_id", "skill", "patterns", "support").write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rule_id int, skill string, patterns array<string>, support bigint").parquet(path)


def as_list(rules: DataFrame) -> list[tuple[list[str], list[str]]]:
    """A built rule table, which is of bounded size, as ``extract.rule_hits`` takes it."""
    return [(list(r["patterns"]), [r["skill"]]) for r in rules.orderBy("rule_id").collect()]
