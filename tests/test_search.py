"""A search computes each similarity once and keeps its conditions."""

from pyspark.sql import functions as F

from tessera.operators import retrieval as R


def test_conditions_of_a_search_do_not_repeat_the_vectors(spark):
    rows = [(k, [float(k % 5), 1.0] if k % 3 else ([1.0] if k % 2 else None)) for k in range(40)]
    items = spark.createDataFrame(rows, "id int, v array<double>")
    query = F.array(F.lit(1.0), F.lit(0.0))
    for least in (None, 0.9):
        found = R.search(items, query, "v", "id", 12, least)
        want = sorted((-(v[0] / (v[0] ** 2 + 1) ** 0.5), k) for k, v in rows if v and len(v) == 2 and (least is None or v[0] / (v[0] ** 2 + 1) ** 0.5 >= least))[:12]
        assert [r.id for r in found.orderBy(F.desc("similarity"), "id").collect()] == [k for _, k in want]
        assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("sqrt") == 2
