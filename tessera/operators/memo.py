"""Mapping phrases once: a table of what earlier runs have mapped.

The table lies in one folder for each version, that is whatever decides a mapping: the framework's tables,
the embedder, the threshold and the way of exclusion.  A run maps only the phrases that its version does
not know and adds them as one batch, which becomes visible by one rename, so a run that fails adds
nothing.  Runs at the same time may add a phrase twice; readers see it once.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import phrase_key
from tessera.operators import mapping
from tessera.operators.embed import Embedder
from tessera.operators.framework import Framework

SCHEMA = "key string, canonical_skill string, skill_type string, match_type string, score double"


@dataclass
class Run:
    """mapped: one row for each distinct key asked for.  added: those of them that this run has mapped.
    version: the folder's part of the table."""

    mapped: DataFrame
    added: DataFrame
    version: str


def version(framework: Framework, embedder: Embedder | None = None, threshold: float = 0.72, exclusion: str = "documented") -> str:
    """An embedder is known by its class and its plain attributes (width, model name, ...)."""
    told = "" if embedder is None else f"{type(embedder).__module__}.{type(embedder).__qualname__}{sorted((k, v) for k, v in vars(embedder).items() if isinstance(v, (str, int, float, tuple)))}"
    return hashlib.sha256(repr((framework.version, told, threshold if embedder else None, exclusion)).encode()).hexdigest()[:32]


class Memo:
    """The table in ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _files(self, path: str):
        where = self._hadoop(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, path: str) -> list[str]:
        where, files = self._files(path)
        return sorted(s.getPath().getName() for s in files.listStatus(where) if s.isDirectory()) if files.exists(where) else []

    def versions(self) -> list[str]:
        return [n.removeprefix("version-") for n in self._listed(self.path) if n.startswith("version-")]

    def batches(self, version: str) -> list[str]:
        folder = f"{self.path}/version-{version}"
        return [f"{folder}/{n}" for n in self._listed(folder) if n.startswith("batch-")]

    def known(self, version: str) -> DataFrame:
        """What is mapped so far."""
        found = self.batches(version)
        return self.spark.read.schema(SCHEMA).parquet(*found) if found else self.spark.createDataFrame([], SCHEMA)

    def add(self, version: str, rows: DataFrame) -> DataFrame:
        """Writes one batch and makes it visible; the batch as it was written."""
        name = uuid.uuid4().hex
        waiting, place = f"{self.path}/waiting-{name}", f"{self.path}/version-{version}/batch-{name}"
        rows.write.parquet(waiting)
        where, files = self._files(waiting)
        files.mkdirs(self._hadoop(f"{self.path}/version-{version}"))
        if not files.rename(where, self._hadoop(place)):
            raise OSError(f"{waiting} could not be renamed to {place}")
        return self.spark.read.schema(SCHEMA).parquet(place)

    def compact(self, version: str) -> None:
        """All batches as one, each phrase once; the old ones go when the new one is visible."""
        old = self.batches(version)
        if len(old) > 1:
            self.add(version, self.known(version).dropDuplicates(["key"]))
            for path in old:
                where, files = self._files(path)
                files.delete(where, True)

    def forget(self, keep: str | None = None) -> None:
        """Removes all versions but one."""
        for name in self.versions():
            if name != keep:
                where, files = self._files(f"{self.path}/version-{name}")
                files.delete(where, True)


def map_phrases(memo: Memo, phrases: DataFrame, framework: Framework, phrase: str = "phrase", exclusion: str = "documented", embedder: Embedder | None = None, threshold: float = 0.72) -> Run:
    """``mapping.map_phrases`` of the phrases that the memo does not know, and the memo's rows for the rest.

    Pending phrases are found by an anti-join on their keys; where there are none, nothing is mapped,
    embedded or written.
    """
    v = version(framework, embedder, threshold, exclusion)
    keys = phrases.select(phrase_key(phrase).alias("key")).distinct()
    known = memo.known(v)
    pending = keys.join(known.select("key"), "key", "left_anti")
    if memo.batches(v) and pending.isEmpty():
        added = memo.spark.createDataFrame([], SCHEMA)
    else:
        added = memo.add(v, mapping.map_phrases(pending, *framework.tables(), phrase="key", exclusion=exclusion, embedder=embedder, threshold=threshold))
    asked = known.join(keys, "key", "left_semi").dropDuplicates(["key"])
    return Run(asked.unionByName(added), added, v)
