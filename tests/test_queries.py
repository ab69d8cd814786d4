"""Every query with SQL gives the rows of that SQL, at the smallest size."""

import math

import duckdb
import pytest

from quillspark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, dict):
        return sorted((norm(k), norm(x)) for k, x in v.items())
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    sql = duck.sql(registry.ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(sql.columns)
    got = sorted(str([norm(r[c]) for c in names]) for r in df.collect())
    want = sorted(str([norm(r[sql.columns.index(c)]) for c in names]) for r in sql.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)
