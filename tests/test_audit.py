"""Logs of changes against plain Python."""

import json
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tessera.operators import audit as U
from tessera.plans import audit as Q

LOG = "k int, field string, before string, after string, at int, placed int, `last` string"


def made(n=400):
    rng = random.Random(5)
    value = lambda: rng.choice([None, "", "a", "b", "ü"])
    # A third of all changes are of one key, and times tie.
    return [(rng.choice([0, 1, 2, 3, 0, 0]), rng.choice(["headline", "summary"]), value(), value(), rng.randrange(30), i, "x") for i in range(n)]


def test_values_at_a_time(spark):
    rows = made() + [(9, "headline", None, "late", 29, 1000, "x"), (8, "headline", "x", None, 1, 1001, "x")]
    log = spark.createDataFrame(rows, LOG)
    for mark in (0, 12, 100):
        got = {(r.k, r.field): r.value for r in U.values_at(log, ["k", "field"], ["at", "placed"], F.col("at") < mark).collect()}
        want = {}
        for r in sorted(rows, key=lambda r: (r[4], r[5])):
            if r[4] < mark:
                want[r[0], r[1]] = r[3]
            else:
                want.setdefault((r[0], r[1]), r[2])
        assert got == want
    assert U.values_at(log.limit(0), ["k"], ["at"], F.lit(True)).collect() == []


def test_reverting(spark):
    rows = made()
    log = spark.createDataFrame(rows, LOG)
    chosen = F.col("placed") % 5 == 0
    current = spark.createDataFrame([(k, f, f"now{k}", "kept") for k in (0, 1, 2, 3, 7) for f in ("headline", "summary")], "k int, field string, value string, reverts string")
    out = U.reverted(current.drop("reverts"), log, ["k", "field"], "value", ["at", "placed"], chosen, ["headline"])
    want = {(k, f): (f"now{k}", 0) for k in (0, 1, 2, 3, 7) for f in ("headline", "summary")}
    for r in sorted(rows, key=lambda r: (r[4], r[5])):
        if r[5] % 5 == 0 and r[1] == "headline":
            want[r[0], r[1]] = (r[2], want[r[0], r[1]][1] + 1)
    assert {(r.k, r.field): (r.value, r.reverts) for r in out.collect()} == want
    marked = U.log_after_revert(log, chosen, F.lit("t")).collect()
    assert {(r.evaluation_status, r.evaluation_score, r.reverted_at) for r in marked if r.placed % 5 == 0} == {("reverted", 0.25, "t")}
    assert {(r.evaluation_status, r.reverted_at) for r in marked if r.placed % 5} == {(None, None)}


def test_finalising(spark):
    rows = [("a", " a\n"), ("kitten", "sitting"), (None, None), (None, "x"), ("say \"hi\"\t", 'say "ho"'), ("", None), ("ü" * 300, "ü" * 200 + "x"), ("same", "same")]
    frame = spark.createDataFrame(rows, "a string, b string")
    both = [F.coalesce(U.quoted(F.col(c)), F.lit("null")) for c in "ab"]
    got = frame.select(U.finalised(F.col("a"), F.col("b")).alias("r"), U.edit_distance(*both).alias("d")).collect()
    for (a, b), r in zip(rows, got):
        x, y = (json.dumps(v and v.strip(), ensure_ascii=False) for v in (a, b))
        distance = 0 if x == y else int(round(max(len(x), len(y), 1) * (1 - SequenceMatcher(a=x, b=y).ratio())))
        assert (r.r.evaluation_status, r.r.evaluation_score, r.r.saved_snapshot, r.d) == (("accepted", 1.0) if x == y else ("modified", 0.65)) + (y, distance)


def test_lifecycle_and_masks(spark):
    table = spark.createDataFrame([(1, "new", "c1", 1, "err"), (2, "new", "c2", 4, None)], "id int, status string, checksum string, version int, changed string")
    change = spark.createDataFrame([(1, "ready", None, 2, None), (5, "ready", "c", 1, "e")], table.schema)
    got = [tuple(r) for r in U.lifecycle(table, change, ["id"], ["status", "changed"], ["checksum", "version"]).orderBy("id").collect()]
    assert got == [(1, "ready", "c1", 2, None), (2, "new", "c2", 4, None)]
    patches = spark.createDataFrame([(1, {"version": "7", "status": None}), (2, {"id": "3"}), (3, {"status": "x"}), (4, None), (6, {})], "id int, patch map<string,string>")
    out = [tuple(r) for r in U.masked_update(table, patches, ["id"], "patch", ["status", "version"]).orderBy("id").collect()]
    assert out == [(1, None, "c1", 7, "err"), (2, "new", "c2", 4, None)]
    refused = {r.id: (r.reason, r.unknown) for r in U.refused_patches(table, patches, ["id"], "patch", ["status", "version"]).collect()}
    assert refused[2] == ("unknown_fields", "id") and refused[3][0] == "no_row" and refused[4][0] == refused[6][0] == "no_fields" and 1 not in refused


def test_stale_sources_and_their_chunks(spark):
    stored = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three"), ("e", "five")], "ref string, body string").withColumn("checksum", F.sha2("body", 256))
    rendered = spark.createDataFrame([("a", "one"), ("b", "TWO"), ("d", "four"), ("e", "  "), ("f", None)], "ref string, body string")
    marks = U.stale_marks(stored, rendered, ["ref"], "body")
    assert {r.ref: r.status for r in marks.collect()} == {"a": "ready", "b": "stale", "c": "stale", "d": "pending", "e": "stale"}
    chunks = spark.createDataFrame([("a", 0, "ready"), ("b", 0, "ready"), ("b", 1, "failed"), ("a", 1, "failed")], "ref string, n int, status string")
    assert {(r.ref, r.n): r.status for r in U.marked_children(chunks, marks, ["ref"]).collect()} == {("a", 0): "ready", ("b", 0): "stale", ("b", 1): "stale", ("a", 1): "failed"}


def test_stale_chunks_are_those_of_stale_sources(spark):
    d = "/root/testdata/sf0.001"
    status = {r.user_id: r.status for r in Q.stale_sources(spark, d).collect()}
    chunks = Q.stale_chunks(spark, d).collect()
    assert {r.user_id for r in chunks} == {k for k, s in status.items() if s != "pending"} and all(r.status == status[r.user_id] for r in chunks)
    assert {"stale", "ready"} <= set(status.values())


def test_log_grows_by_what_changed(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id int, x string, y int")
    new = spark.createDataFrame([(1, "a", 2), (2, "b", None), (3, None, 5)], "id int, x string, y int")
    assert sorted(tuple(r) for r in U.changed_fields(old, new, ["id"], ["x", "y"]).collect()) == [(1, "y", "1", "2"), (3, "y", None, "5")]
