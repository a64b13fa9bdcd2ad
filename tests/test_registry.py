"""Every registered query with SQL against DuckDB on small tables, and the contract of the entry module."""

import math

import duckdb
import pytest

from tessera.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 5)
    return str(v) if not isinstance(v, int) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SMALL)
    names = sorted(got.columns)
    found = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=str)
    rel = duck.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == names
    place = [cols.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in place) for r in rel.fetchall()), key=str)
    assert found == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SMALL).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
