"""Apply plans by scenarios; the queries compare all customers and orders with their SQL."""

from pyspark.sql import functions as F

from tessera.operators import apply_plan as P


def test_values(spark):
    rows = [(0, None, None), (1, " ", "New "), (2, "Old", "\told\n"), (3, "Old", "New"), (4, "Old", " "), (5, "Straße", "STRASSE")]
    made = spark.createDataFrame(rows, "id int, now string, new string")
    got = {r.id: r.p for r in made.select("id", P.value_plan(F.col("now"), F.col("new")).alias("p")).collect()}
    assert [got[i].action for i in range(6)] == [P.NOOP, P.FILL_MISSING, P.NOOP, P.REVIEW_REQUIRED, P.NOOP, P.NOOP]
    assert [got[i].chosen for i in range(6)] == [False, True, False, False, False, False] and got[1].suggested == "New"


def test_lists(spark):
    rows = [(0, None, None), (1, ["Python", None, " "], ["python", "Go", " go ", None, "Rust"]), (2, None, ["a", "A"]), (3, ["a", "a "], ["A"]), (4, ["a"], [])]
    made = spark.createDataFrame(rows, "id int, now array<string>, new array<string>")
    got = {r.id: r.p for r in made.select("id", P.list_plan(F.col("now"), F.col("new")).alias("p")).collect()}
    assert [got[i].to_add for i in range(5)] == [[], ["Go", "Rust"], ["a"], [], []]
    assert [got[i].action for i in range(5)] == [P.NOOP, P.ADD_UNIQUE, P.ADD_UNIQUE, P.NOOP, P.NOOP]
    assert got[1].current == ["Python"] and got[1].suggested == ["python", "Go", "Rust"] and got[3].current == ["a"]


def test_entries_keep_rows_and_clashing_columns(spark):
    fields = "owner int, title string, company string, began int, id int, entry_key string"
    drafts = spark.createDataFrame([(1, "Lead", None, None, 90, "x"), (1, " lead", "", None, 91, "y"), (1, "Lead", "", 2019, 92, "z"), (2, "Lead", None, None, 93, None), (None, "Lead", None, None, 94, None)], fields)
    existing = spark.createDataFrame([(1, "LEAD ", "", None, 5, "x"), (1, "lead", None, None, 7, "x"), (None, "lead", None, None, 8, "x")], fields)
    got = {r.id: r for r in P.entry_plans(drafts, existing, ["owner"], ["title", "company"], ["began"], "id", ["id"]).collect()}
    assert {i: (r.matched_existing_id, r.action) for i, r in got.items()} == {90: (7, P.NOOP), 91: (7, P.NOOP), 92: (None, P.ADD_UNIQUE), 93: (None, P.ADD_UNIQUE), 94: (8, P.NOOP)}
    assert got[90].entry_key == "x" and P.entry_plans(drafts.limit(0), existing, ["owner"], ["title"], [], "id", ["id"]).count() == 0
    assert P.entry_plans(drafts, existing.limit(0), ["owner"], ["title"], [], "id", ["id"]).filter("chosen").count() == 5
