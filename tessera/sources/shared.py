"""Tables kept in the folder that all executors share, where a plan needs rows once fixed or read twice.

Every application has one folder in it, which goes when the program ends, even if its session was stopped
before: by ``clean``, or else by the driver's JVM as it shuts down.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, tuple[SparkSession, str]] = {}
_made: list[tuple[SparkSession, str]] = []
_lasting: set[str] = set()


def folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; on one machine, where it is unset, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def files(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    where, system = files(spark, path)
    system.delete(where, True)


def own_folder(spark: SparkSession) -> str:
    """The application's own folder, marked to go with the driver's JVM."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        path = f"{folder(spark)}/tessera-{uuid.uuid4().hex}"
        where, system = files(spark, path)
        system.mkdirs(where)
        system.deleteOnExit(where)
        _folders[app] = spark, path
    return _folders[app][1]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def lasting(path: str) -> None:
    """Lets a path outlive the scratch it was made in."""
    _lasting.add(path)


def kept(rows: DataFrame, name: str = "kept") -> DataFrame:
    """``rows`` written as Parquet and read back."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` over four tasks for every core, before costly work on each of them: a table
    of few bytes is one task otherwise, however many rows it has."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Paths made inside are removed at the end, but for lasting ones: whatever is still to be read then
    must be computed from those alone."""
    before = len(_made)
    yield
    mine = _made[before:]
    del _made[before:]
    for spark, path in mine:
        if path in _lasting:
            _lasting.discard(path)
            _made.append((spark, path))
        else:
            remove(spark, path)


def clean(spark: SparkSession) -> None:
    """Removes the application's folder with all tables in it; to be called before the session stops,
    where the program goes on after that."""
    found = _folders.pop(spark.sparkContext.applicationId, None)
    if found:
        remove(spark, found[1])
        _made[:] = [(s, p) for s, p in _made if not p.startswith(found[1])]


@atexit.register
def _clean_all() -> None:
    for spark, path in list(_folders.values()):
        try:
            remove(spark, path)
        except Exception:  # the session has ended: the JVM removes the folder as it ends
            continue
