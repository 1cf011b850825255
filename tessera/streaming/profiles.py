"""Family profiles kept up over a stream of postings that come late, twice and corrected.

State holds the last version of every posting, as the greatest one that came; each batch appends the postings
it changed, and the profile counts the last version of each, whatever the order of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.align import family_profiles


def changes(stream: DataFrame, key: str, version: str, code: str, good: str, skills: str) -> DataFrame:
    """(key, last): the last version (version, code, good, skills) of every posting, from a stream of
    versions.  A null version counts as 0, a null ``good`` too; of one version that says different things the
    greatest counts, so that order does not."""
    listed = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(skills), F.array().cast("array<string>")), lambda s: s.isNotNull())))
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    made = F.struct(number(version).alias("version"), F.coalesce(F.col(code), F.lit("")).alias("code"), number(good).alias("good"), listed.alias("skills"))
    return stream.select(F.col(key).alias("key"), made.alias("last")).groupBy("key").agg(F.max("last").alias("last"))


def kept_profile(stream_of_changes: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(families, skills) as ``align.family_profiles`` has them (titles aside), after the stream has run to the
    end of its input.

    Every batch appends the postings it changed to the table under ``path``; a batch that is run again
    replaces itself.  Postings without a code or skills count nowhere.
    """
    spark, schema = stream_of_changes.sparkSession, stream_of_changes.schema

    def append(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")

    run = stream_of_changes.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(append).start()
    run.awaitTermination()
    last = spark.read.schema(schema).parquet(f"{path}/changes/batch=*").groupBy("key").agg(F.max("last").alias("last")).select("last.*")
    families, skills = family_profiles(last.withColumn("title", F.lit("")), good="good")
    return families.drop("title"), skills
