"""Queries that must take in whole tables, and forms that must not be left out."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.operators import analytics as A
from tessera.operators import documents as D
from tessera.plans import registry
from tessera.streaming import events as S

SMALL = "/root/testdata/sf0.001"


def test_incremental_parse_reaches_every_day(spark):
    got = {r.user_id: r for r in registry.queries()["incremental_parse_all"](spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/events.parquet").select("user_id", "event_type", F.to_date("ts").alias("day"), "ts", "value").collect()
    sections = {}
    for r in rows:
        sections.setdefault((r.user_id, r.event_type, r.day), []).append(r.value > 30)
    want = {}
    for (user, _, day), high in sections.items():
        n, reused = want.get(user, (0, 0))
        want[user] = (n + 1, reused + (str(day) < "2024-01-16" and all(high)))
    assert {u: (r.sections, r.reused) for u, r in got.items()} == want
    assert max(str(k[2]) for k in sections) > "2024-01-02" and len({r.reused for r in got.values()}) > 1


def test_diversified_places_every_row(spark):
    rows = [(k, k * 7 % 5 if k % 11 else None, None if k % 13 == 0 else float(k * 31 % 17)) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, source int, score double")
    best, rest, seen = [], [], set()
    for r in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0])):
        (rest if r[1] in seen else best).append(r[0])
        seen.add(r[1])
    got = {r.id: r.place for r in A.diversified_places(df, "source", [-F.col("score"), F.col("id")], 8).collect()}
    assert got == {k: place for place, k in enumerate(best + rest, 1)}
    assert A.diversified_places(df.limit(0), "source", [F.col("id")]).count() == 0
    suppliers = spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").count()
    assert suppliers > 50 and registry.queries()["diversified_all"](spark, "/root/testdata/sf0.01").count() == suppliers


def test_best_version_is_found_behind_other_documents(spark):
    rng = random.Random(2)
    bases = [rng.getrandbits(64) for _ in range(6)]
    rows = [(k, f"s{k % 3}" if k != 77 else "alone", rng.choice(bases) ^ (1 << rng.randrange(64) if k % 4 else 0)) for k in range(200)]
    df = spark.createDataFrame([(k, s, f"{v:016x}") for k, s, v in rows], "id long, person string, simhash string")
    got = {r.id: (r.previous, r.similarity) for r in D.best_versions(df, "id", "person").collect()}
    want = {k: min((((v ^ w).bit_count(), j) for j, t, w in rows if t == s and j != k), default=None) for k, s, v in rows}
    assert got == {k: (b[1], 1 - b[0] / 64) if b else (None, None) for k, b in want.items()}
    hashes = sorted({(s, v - (1 << 64) if v >> 63 else v) for _, s, v in rows})
    distinct = spark.createDataFrame([(s, h, i, True) for i, (s, h) in enumerate(hashes)], "person string, h long, id long, own boolean")
    near = {(r.person, r.h): (r.distance, r.nearest) for r in D.nearest_hashes(distinct, "person", "id", 7).collect()}
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = {(s, h): min(((bits(h, g), j) for j, (t, g) in enumerate(hashes) if t == s and g != h), default=None) for s, h in hashes}
    assert near == {k: b for k, b in want.items() if b}


def test_rate_limits_of_one_hot_user_stay_in_batches(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(1 if k % 5 else k % 3, k, start + dt.timedelta(seconds=k // 2)) for k in range(4000)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")
    state, want = {}, {}
    for user, k, ts in rows:
        t = (ts - start).total_seconds()
        end, n = state.get(user, (-1.0, 0))
        if end <= t:
            state[user], want[k] = (t + 60, 1), 0
        elif n >= 3:
            want[k] = max(1, int(end - t))
        else:
            state[user], want[k] = (end, n + 1), 0
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        limited = S.rate_limited_batch(df, 3, 60)
        assert {r.event_id: r.wait for r in limited.collect()} == want
        assert "collect_list" not in limited._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
