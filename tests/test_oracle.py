"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from tessera import catalog, catalog_rows, catalog_skills, registry  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, (int, float, bool)) or hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def rows(names, got):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in got), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    mine = rows(df.columns, df.collect())
    relation = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in relation.description]
    theirs = rows(names, relation.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-6 * max(1, abs(y)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(name, spark, sf):
    assert registry.QUERIES[name](spark, sf).count() > 0
