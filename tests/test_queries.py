"""Every query that has SQL gives DuckDB's rows, at the smallest scale; schemas are stable."""

import duckdb
import pytest

from millrace import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    r = con.execute(registry.ORACLES[name])
    names = [d[0] for d in r.description]
    at = [names.index(c) for c in sorted(df.columns)]
    want = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
    assert sorted(names) == sorted(df.columns)
    assert got == want
    assert got
