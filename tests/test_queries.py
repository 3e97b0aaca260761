"""Registered queries of the library against their SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from millrace.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(x) for x in r) for r in df.select(*names).collect()), key=repr)
    cursor = duck.execute(catalog.SQL[name])
    theirs_names = [d[0] for d in cursor.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(n) for n in names]
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
