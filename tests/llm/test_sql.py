"""The SQL of the numbered queries, by DuckDB over the same tables."""

import duckdb
import pytest

from tessera.llm.queries import oracle_sql, queries
from tests.llm.test_queries import same


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    where = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    got = queries()[name](spark, where)
    rel = con.execute(oracle_sql()[name])
    place = [[d[0] for d in rel.description].index(c) for c in got.columns]
    same([tuple(r) for r in got.collect()], [tuple(r[i] for i in place) for r in rel.fetchall()])
