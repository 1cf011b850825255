"""Paged servers as a Spark source, and the rules by which their pages end.

``page_source`` makes a Python data source of a function that fetches one page.  Its tasks fetch pages
side by side and hand on each as it comes; as a stream it goes on from its checkpoint and fetches only
pages that are new.  What the pages hold is told from their rows: no list of records is ever built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: A page's body, or None where the server has no such page.
Fetch = Callable[[int], str | None]


class _Pages(InputPartition):
    def __init__(self, first: int, step: int, end: int | None = None):
        self.first, self.step, self.end = first, step, end


class _Reader(DataSourceReader):
    """Each lane reads every so manyth page until the first that is not there; so at most one page beyond
    the last is asked for by each."""

    def __init__(self, fetch: Fetch, first: int, lanes: int):
        self.fetch, self.first, self.lanes = fetch, first, lanes

    def partitions(self) -> list[InputPartition]:
        return [_Pages(self.first + k, self.lanes) for k in range(self.lanes)]

    def read(self, partition: _Pages) -> Iterator[tuple[int, str]]:
        for page in count(partition.first, partition.step):
            body = self.fetch(page)
            if body is None:
                return
            yield page, body


class _Stream(DataSourceStreamReader):
    """Offsets are numbers of pages.  The last page is sought by doubling and halving, so a trigger asks
    for a few pages to plan with, however many there are."""

    def __init__(self, fetch: Fetch, first: int, lanes: int):
        self.fetch, self.first, self.lanes, self.last = fetch, first, lanes, first - 1

    def initialOffset(self) -> dict:
        return {"page": self.first - 1}

    def latestOffset(self) -> dict:
        there, step = self.last, 1
        while there < self.first or self.fetch(there + step) is not None:
            if there < self.first and self.fetch(self.first) is None:
                return {"page": self.first - 1}
            there = self.first if there < self.first else there + step
            step *= 2
        absent = there + step
        while absent - there > 1:
            middle = (there + absent) // 2
            there, absent = (middle, absent) if self.fetch(middle) is not None else (there, middle)
        self.last = there
        return {"page": there}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = max(self.last, end["page"])
        n = end["page"] - start["page"]
        return [_Pages(start["page"] + 1 + k, self.lanes, end["page"] + 1) for k in range(min(n, self.lanes))]

    def read(self, partition: _Pages) -> Iterator[tuple[int, str]]:
        for page in range(partition.first, partition.end, partition.step):
            body = self.fetch(page)
            if body is not None:
                yield page, body


def page_source(fetch: Fetch, name: str = "pages") -> type[DataSource]:
    """A source to register with ``spark.dataSource.register``: rows (page, body).  Options: ``first``, the
    first page's number (1), and ``lanes``, how many tasks fetch (8)."""

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "page bigint, body string"

        def _told(self) -> tuple[Fetch, int, int]:
            return fetch, int(self.options.get("first", 1)), int(self.options.get("lanes", 8))

        def reader(self, schema) -> DataSourceReader:
            return _Reader(*self._told())

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(*self._told())

    return Pages


def fetched(spark: SparkSession, fetch: Fetch, lanes: int = 8, first: int = 1, name: str = "pages") -> DataFrame:
    """(page, body) of all pages."""
    spark.dataSource.register(page_source(fetch, name))
    return spark.read.format(name).option("lanes", lanes).option("first", first).load()


def appended(spark: SparkSession, fetch: Fetch, path: str, lanes: int = 8, name: str = "pages") -> DataFrame:
    """The table of pages kept under ``path``, after the pages that it lacks are fetched.  A run that ends
    early goes on from its checkpoint; a page that was there is not fetched again."""
    spark.dataSource.register(page_source(fetch, name))
    stream = spark.readStream.format(name).option("lanes", lanes).load()
    stream.writeStream.format("parquet").option("path", f"{path}/pages").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("page bigint, body string").parquet(f"{path}/pages")


def listed_records(pages: DataFrame, record: str, key: str = "code") -> DataFrame:
    """Records of pages (page, body) of a server that says ``{"results": [...], "next": ...}``: those of the
    pages up to the first that has no results or no next, or that the following page is missing of; the
    first record of each key, a null key too.  ``record``: the records' fields as SQL."""
    said = pages.select("page", F.from_json("body", f"results array<struct<{record}>>, next string").alias("b"))
    goes_on = (F.coalesce(F.size("b.results"), F.lit(0)) > 0) & ~F.coalesce(F.lower("b.next"), F.lit("")).isin("", "false", "null", "0")
    said = said.select("page", "b.results", goes_on.alias("goes_on"))
    last = said.where("not goes_on").agg(F.min("page").alias("last"))
    follows = said.select((F.col("page") - 1).alias("page"))
    gap = said.select("page").join(follows, "page", "left_anti").agg(F.min("page").alias("gap"))
    read = said.crossJoin(F.broadcast(last.crossJoin(gap))).where(F.col("page") <= F.least("last", "gap"))
    each = read.select("page", F.posexplode("results").alias("pos", "r"))
    return each.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.min_by("r", F.struct("page", "pos")).alias("r")).select("r.*")


def records_until_known(pages: DataFrame, record: str, key: str = "code") -> DataFrame:
    """Records of pages (page, body) that are JSON arrays, read until a page adds no new key; the first
    record of each key."""
    each = pages.select("page", F.from_json("body", f"array<struct<{record}>>").alias("b"))
    first = each.select("page", F.posexplode("b").alias("pos", "r")).groupBy(F.col(f"r.{key}").alias("_k")).agg(F.min_by(F.struct("page", "pos", "r"), F.struct("page", "pos")).alias("f"))
    first = first.select("f.page", "f.r")
    idle = each.select("page").distinct().join(first.select("page").distinct(), "page", "left_anti").agg(F.min("page").alias("stop"))
    return first.crossJoin(F.broadcast(idle)).where(F.col("stop").isNull() | (F.col("page") < F.col("stop"))).select("r.*")
