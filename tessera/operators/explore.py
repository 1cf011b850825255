"""Aggregates for looking at cleaned data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import values


def value_counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("cnt"))


def exploded_counts(rows: DataFrame, values: str, name: str = "value") -> DataFrame:
    return rows.select(F.explode(values).alias(name)).groupBy(name).agg(F.count("*").alias("cnt"))


def rare_pairs(rows: DataFrame, a: str, b: str, limit: int = 10) -> DataFrame:
    return value_counts(rows, a, b).withColumn("rare", F.col("cnt") < limit)


def describe(rows: DataFrame, value: str) -> DataFrame:
    q = lambda p: F.percentile(value, F.lit(p))
    return rows.agg(F.count(value).alias("cnt"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev(value), 4).alias("std"), F.min(value).alias("min"), F.round(q(0.25), 4).alias("q1"), F.round(q(0.5), 4).alias("median"), F.round(q(0.75), 4).alias("q3"), F.max(value).alias("max"))


def group_stats(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("cnt"), F.round(F.avg(value), 4).alias("mean"), F.round(F.median(value), 4).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"))


def distinct_values(rows: DataFrame, by: str, values: str) -> DataFrame:
    """Postings and distinct array values of each key."""
    each = rows.select(by, F.explode(values).alias("v")).groupBy(by).agg(F.countDistinct("v").alias("unique_skills"))
    return rows.groupBy(by).agg(F.count("*").alias("postings")).join(each, by, "left").withColumn("unique_skills", F.coalesce("unique_skills", F.lit(0)))


def top_within_top(rows: DataFrame, by: str, item: str, groups: int = 10, items: int = 10) -> DataFrame:
    """The most frequent groups, and in each its most frequent items, with both ranks."""
    counts = rows.groupBy(by, item).agg(F.count("*").alias("cnt"))
    size = counts.groupBy(by).agg(F.sum("cnt").alias("total"))
    best = size.orderBy(F.desc("total"), by).limit(groups).withColumn("group_rank", F.row_number().over(Window.orderBy(F.desc("total"), by)))
    inner = counts.join(F.broadcast(best), by)
    return inner.withColumn("item_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("cnt"), item))).where(F.col("item_rank") <= items)


def having_keyword(rows: DataFrame, title: str, keywords: Sequence[str] = values.DATA_TITLES) -> DataFrame:
    return rows.where(F.lower(title).rlike("|".join(keywords)))


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A fixed sample: the n smallest hashes of key and seed."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def dominant(rows: DataFrame, column: str) -> DataFrame:
    """(column, cnt) of the most frequent value that is not null or blank, of equals the least."""
    known = rows.where(F.col(column).isNotNull() & (F.trim(F.col(column).cast("string")) != ""))
    return value_counts(known, column).orderBy(F.desc("cnt"), column).limit(1)


def stratified(rows: DataFrame, bucket: str, order: Column | str, n: int) -> DataFrame:
    """n rows: an equal quota of each bucket by ``order``, filled up from the rest by ``order``."""
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(order))
    quota = rows.agg(F.greatest(F.lit(1), F.floor(F.lit(n) / F.countDistinct(bucket))).alias("_quota"))
    marked = rows.withColumn("_place", place).crossJoin(F.broadcast(quota)).withColumn("picked", F.when(F.col("_place") <= F.col("_quota"), "quota").otherwise("fill"))
    return marked.orderBy(F.desc("picked"), order).limit(n).drop("_place", "_quota")


def looks_sampled(rows: DataFrame, least: int = values.FULL_JOBS) -> bool:
    """Whether a table is too short to be a full export; counts no further than it must."""
    return rows.limit(least).count() < least
