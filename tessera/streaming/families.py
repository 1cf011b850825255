"""Family statistics kept up over a stream of postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def family_counts(stream: DataFrame, code: str, good: str, time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Jobs and good jobs of each family by tumbling window; rows later than ``late`` are left out.
    State holds one row for each family and open window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), code).agg(F.count("*").alias("job_count"), F.sum(good).cast("long").alias("good_job_count")).select(F.col("window.start").alias("window_start"), code, "job_count", "good_job_count")


def table_of(counts: DataFrame, path: str, *keys: str) -> DataFrame:
    """Runs a stream of counts to the end of its input and returns the table it kept under ``path``.

    Every batch appends the groups it changed, with the batch's number; the table is the last version of
    each group.  Nothing passes through the driver, and a restarted run goes on from its checkpoint.
    """
    spark, schema = counts.sparkSession, counts.schema

    def append(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")

    run = counts.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(append).start()
    run.awaitTermination()
    changes = spark.read.schema(schema.add("_batch", "long")).parquet(f"{path}/changes/batch=*")
    last = F.max_by(F.struct(*[c for c in schema.names if c not in (*keys, "_batch")]), "_batch").alias("_v")
    return changes.groupBy(*keys).agg(last).select(*keys, "_v.*")
