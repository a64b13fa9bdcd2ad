"""Workflow operators at their edges: no rows, nulls, ties, order of keys."""

import hashlib
import json

from pyspark.sql import functions as F

from tessera.operators import workflow as W
from tessera.sources import postings as P


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_workflow_of_nobody_and_of_ties(spark):
    people = spark.createDataFrame([(1,), (2,)], "id long")
    entries = spark.createDataFrame([(1, "tag", "b", 1), (1, "tag", "a", 2), (1, "tag", "b", 3), (1, "stage", "new", 1), (1, "stage", "hired", 5), (1, "note", None, None), (None, "tag", "x", 1)], "id long, kind string, value string, at int")
    got = {r.id: (r.tags, r.notes, r.last_note, r.stage) for r in W.workflow(people, entries, "id", "kind", "value", ["at"]).collect()}
    assert got == {1: (["a", "b"], 1, None, "hired"), 2: ([], 0, None, None)}
    assert W.workflow(people, entries.limit(0), "id", "kind", "value", ["at"]).filter("notes = 0").count() == 2


def test_confidence_terms_and_containment(spark):
    numbers = lambda *x: F.array(*map(F.lit, x)).cast("array<double>")
    assert one(spark, W.mean_confidence(numbers(0.5), numbers(0.0, 1.0, None))) == 0.75
    assert one(spark, W.mean_confidence(numbers(), numbers(0.0))) is None
    words = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, W.display_terms(words("Data_Science", "engineer", None, " data science", "", "a", "b", "c", "d"))) == ["data science", "a", "b", "c"]
    assert one(spark, W.either_contains(words(None, "New York City"), words("york"))) is True
    assert one(spark, W.either_contains(words(), words("x"))) is False
    assert one(spark, W.sensitivity(F.lit(None).cast("string"), F.lit("candidate"))) == "medium"


def test_checks_and_lookup(spark):
    got = one(spark, W.checked({"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": F.lit(False)}))
    assert (got.score, got.missing) == (33, ["b", "c"])
    rows = spark.createDataFrame([(1, "A", "a"), (2, "x", "b"), (3, None, "z")], "k int, u string, v string")
    known = spark.createDataFrame([("a", 10), ("b", 20), ("A", 30)], "url string, s int")
    got = {tuple(r) for r in W.ranked_lookup(rows, "k", [F.col("u"), F.col("v")], known, "url", "s").collect()}
    assert got == {(1, 1, 30), (2, 2, 20)}


def test_payload_hash_ignores_the_order_of_keys(spark):
    df = spark.sql("select named_struct('b', map('y', 1, 'x', 2), 'a', array(named_struct('d', null, 'c', 'é')), 'z', cast(null as int)) as p")
    want = json.dumps({"b": {"y": 1, "x": 2}, "a": [{"d": None, "c": "é"}], "z": None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    kind = df.schema["p"].dataType
    got = df.select(P.payload_json(F.col("p"), kind).alias("j"), P.payload_hash(F.col("p"), kind).alias("h")).first()
    assert got.j == want
    assert got.h == hashlib.sha256(want.encode()).hexdigest()
