"""Shared working folder: tables that cut lineage live where every executor can read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import shared
from tessera.sources.shared import new_path, scratch  # noqa: F401  (one register of paths for the whole library)

#: Short rows (links, labels) of a file.
FILE_ROWS = 1 << 16


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def exists(spark: SparkSession, path: str, pattern: str) -> bool:
    """Whether a file in ``path`` fits ``pattern``."""
    where, files = shared.files(spark, f"{path}/{pattern}")
    found = files.globStatus(where)
    return found is not None and len(found) > 0


def written(df: DataFrame, name: str, keep: bool = False, rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: later steps survive lost executors
    and see one fixed version of it.  ``keep`` lets it outlive the scratch it is written in.  ``rows``,
    a bound of its rows where these are short, keeps it from falling into more files than they need."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    if keep:
        shared.lasting(path)
    return spark.read.schema(df.schema).parquet(path)
