"""Work on many rows of a small file is dealt to all cores, and texts are folded once."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vocabulary as V
from tessera.plans import registry

SMOKE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rule_labels", "cv_entries"])
def test_rows_of_one_file_are_dealt_to_all_cores(spark, name):
    assert registry.queries()[name](spark, SMOKE).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("made", [X.completeness, X.workplace_type, lambda t: X.seniority(F.lit(None).cast("string"), t), lambda t: X.employment_type(t, t), lambda t: V.label(V.ROLE_FAMILIES, t, t), X.normalize_url])
def test_a_text_is_folded_once_for_all_steps_and_rules(spark, made):
    plan = spark.createDataFrame([("A  b",)], "t string").select(made(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?U)\\s+") <= 2


def test_folded_texts_keep_their_labels(spark):
    rows = spark.createDataFrame([(0, None), (1, " "), (2, "Senior   Backend<br> (Remote)"), (3, "https:")], "i int, t string").orderBy("i")
    t = F.col("t")
    got = rows.select(X.strip_html(t), X.completeness(t), X.workplace_type(t), X.seniority(t, t), V.label(V.ROLE_FAMILIES, t, t), V.joined(t, t), X.normalize_url(t)).collect()
    assert [tuple(r)[:6] for r in got[:3]] == [(None, 0.2, None, None, None, ""), (None, 0.2, None, None, None, ""), ("Senior Backend (Remote)", 0.35, "remote", "senior", "software_engineering", "senior backend<br> (remote) senior backend<br> (remote)")]
    assert got[0][6] == "" and got[3][6].startswith("https://")
