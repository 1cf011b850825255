"""Sinks: JSON lines, one document, Parquet, and CSV with joined lists."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def document(rows: DataFrame, most: int = 10_000) -> str:
    """A small result as one JSON array; larger ones are refused."""
    got = rows.toJSON().take(most + 1)
    if len(got) > most:
        raise ValueError(f"more than {most} rows; write JSON lines instead")
    return json.dumps([json.loads(x) for x in got], ensure_ascii=False)


def document_file(rows: DataFrame, path: str) -> None:
    """Rows of any number as one JSON array in one file: rows become JSON in their own tasks, and the task
    that writes the file passes them on as they come."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            lines = [x for x in batch.column(0).to_pylist() if x is not None]
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([before + lines[0], *("," + x for x in lines[1:])], pa.string())], ["value"])
                before = ","
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"], pa.string())], ["value"])

    told = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    told = told.unionAll(rows.sparkSession.range(1).select(F.lit(None).cast("string")))  # so that a task runs if there are no rows
    told.repartition(1).mapInArrow(wrapped, "value string").write.mode("overwrite").text(path)


def table(rows: DataFrame, path: str, *partitions: str) -> None:
    rows.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def csv(rows: DataFrame, path: str, separator: str = " | ") -> None:
    """Arrays as joined text, with a header."""
    flat = [F.array_join(F.col(f.name).cast("array<string>"), separator).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in rows.schema]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)
