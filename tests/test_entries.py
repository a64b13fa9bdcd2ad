"""Entries of sections by scenarios; the queries compare all orders and documents with their SQL."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import entries as E
from tessera.plans import registry


def cut(spark, *texts):
    rows = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "id int, text string, entries string")
    return [r[0] for r in rows.orderBy("id").select(E.entries(F.split("text", "\n"))).collect()]


def test_years_roles_pipes_and_blank_lines(spark):
    a, b, c, d = cut(
        spark,
        "2019 - 2021 Engineer\nbuilt things\n\nmore things\n2017 to present Analyst\nreports",
        "Engineer\nAcme\n\nAnalyst\n2018\nYazılım Mühendisi\n2015",
        "2019\nnotes\nLead | Berlin\nno year yet\nOther | Bonn",
        "2019\n• worked as manager\nmail lead@x.org\n+49 30 1234567 manager\nKuzey Evi, İstanbul\n2018\nİstanbul\nHigh School of Arts\n",
    )
    assert a == [["2019 - 2021 Engineer", "built things", "more things"], ["2017 to present Analyst", "reports"]]
    assert b == [["Engineer", "Acme"], ["Analyst", "2018"], ["Yazılım Mühendisi", "2015"]]
    assert c == [["2019", "notes"], ["Lead | Berlin", "no year yet", "Other | Bonn"]]
    assert d == [["2019", "• worked as manager", "mail lead@x.org", "+49 30 1234567 manager"], ["Kuzey Evi, İstanbul", "2018", "İstanbul"], ["High School of Arts"]]


def test_a_company_continues_a_single_line_with_a_year_and_a_role(spark):
    a, b = cut(spark, "2019 Engineer\n2021 Acme Foods\n2017 Analyst\npresent Acme GmbH\n2015 Analyst\n2016 Lead Analyst", "2019 Engineer\nnotes\n2021 Acme Foods")
    assert a == [["2019 Engineer", "2021 Acme Foods"], ["2017 Analyst", "present Acme GmbH"], ["2015 Analyst"], ["2016 Lead Analyst"]]
    assert b == [["2019 Engineer", "notes"], ["2021 Acme Foods"]]


def test_nothing_to_cut(spark):
    assert cut(spark, "", "\n \n", "one") == [[], [], [["one"]]]
    assert cut(spark, None)[0] in ([], None)


def test_a_long_section(spark):
    got = cut(spark, "2019 Engineer\nnotes\n" * 20_000)[0]
    assert len(got) == 20_000 and got[-1] == ["2019 Engineer", "notes"]


SHARED = ["2019 Engineer", "2021 Acme Foods", "notes", "", "  ", None, "Lead | Berlin", "• worked as manager", "2017 to present Analyst", "Kuzey Evi, İstanbul", "x" * 90]


def test_rows_that_share_lines_have_the_entries_of_each_alone(spark):
    made = [(k, [SHARED[(k * (i + 3) + i * i) % len(SHARED)] for i in range(k % 12)]) for k in range(700)] + [(700, None), (701, [None]), (702, ["", " "]), (703, ["2019 Engineer\n", "notes"] * 300)]
    frame = spark.createDataFrame(made, "k long, l array<string>").repartition(3, "k")
    want = {r[0]: r[1] for r in frame.select("k", E.entries(F.col("l"))).collect()}
    got = {r[0]: r[1] for r in E.entry_rows(frame, "k", "l").collect()}
    assert got == {k: v or [] for k, v in want.items()} and len(got) == 704 and len(got[703]) == 300
    assert E.entry_rows(frame.filter("false"), "k", "l").collect() == []


def test_lines_that_rows_share_are_marked_once(monkeypatch):
    rows = [SHARED[k % 5 :] for k in range(9000)] + [None, []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.string()))], ["k", "l"])
    (whole,) = E._packed([batch])
    assert len(whole["words"][0]) == len(SHARED) and len(whole["keys"][0]) == len(rows)
    monkeypatch.setattr(E, "LINES", 40)
    monkeypatch.setattr(E, "BYTES", 600)
    parts = list(E._packed([batch.slice(5, 200), batch.slice(8990)]))
    back = []
    for p in parts:
        words, places = p["words"][0].as_py(), iter(np.frombuffer(p["places"][0].as_py(), np.int32))
        counts = np.frombuffer(p["counts"][0].as_py(), np.int32)
        assert counts.sum() <= 40 and sum(len(words[k] or "") for k in np.frombuffer(p["places"][0].as_py(), np.int32)) <= 600
        back += [(k, [words[next(places)] for _ in range(n)]) for k, n in zip(p["keys"][0].as_py(), counts, strict=True)]
    assert back == [(k, rows[k] or []) for k in [*range(5, 205), *range(8990, 9002)]]
    monkeypatch.setattr(E, "BYTES", 1)
    assert len(list(E._packed([batch.slice(0, 7)]))) == 7


@pytest.mark.parametrize("name", ["cv_entries", "document_entries"])
def test_queries_mark_lines_of_many_rows_together(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "ArrowEvalPython" not in plan
