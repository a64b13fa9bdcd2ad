"""Apply plans: a customer is a profile, with a draft made from its own columns; its finished orders are entries, its open ones the draft's."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import apply_plan as P
from tessera.plans.base import query, table

#: Profile and draft of each customer; understood by Spark and DuckDB alike.
FIELDS = {
    "headline_now": "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE c_name END",
    "headline_new": "CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN upper(c_name) || ' ' WHEN 2 THEN ' ' ELSE 'Senior ' || c_mktsegment END",
    "summary_now": "CASE c_custkey % 3 WHEN 0 THEN 'Hauptstraße ' || c_mktsegment ELSE NULL END",
    "summary_new": "CASE c_custkey % 4 WHEN 0 THEN ' HAUPTSTRASSE ' || lower(c_mktsegment) WHEN 1 THEN c_name ELSE '' END",
    "skills_now": "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Python, SQL ,' || c_mktsegment || ',Straße' END",
    "skills_new": "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' python,sql' WHEN 2 THEN 'STRASSE,' || lower(c_mktsegment) || ',,Rust, rust ' ELSE 'Go,' || c_name END",
}
ENTRY = ("o_custkey", "o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE 'Acme' END AS company", "year(o_orderdate) AS began", "CASE WHEN o_orderkey % 4 > 0 THEN month(o_orderdate) % 2 END AS ended")
DRAFTS, EXISTING = (*ENTRY, "' ' || lower(o_orderpriority) AS title"), (*ENTRY, "o_orderpriority AS title")

KEY = lambda x: f"lower(replace(coalesce(trim({x}), ''), 'ß', 'ss'))"
CLEAN = lambda x: f"nullif(trim({x}), '')"
ENTRY_SQL = f"""d AS (SELECT {', '.join(DRAFTS)} FROM orders WHERE o_orderstatus = 'O'), e AS (SELECT {', '.join(EXISTING)} FROM orders WHERE o_orderstatus = 'F'),
  x AS (SELECT o_custkey, {KEY("title")} AS t, {KEY("company")} AS c, coalesce(began, -1) AS b, coalesce(ended, -1) AS n, max(o_orderkey) AS found FROM e GROUP BY ALL),
  p AS (SELECT d.*, found, CASE WHEN found IS NULL THEN '{P.ADD_UNIQUE}' ELSE '{P.NOOP}' END AS action, found IS NULL AS chosen FROM d
        LEFT JOIN x ON x.o_custkey = d.o_custkey AND t = {KEY("d.title")} AND c = {KEY("d.company")} AND b = coalesce(d.began, -1) AND n = coalesce(d.ended, -1))"""


def _value_sql(name: str) -> str:
    now, new = CLEAN(f"{name}_now"), CLEAN(f"{name}_new")
    return f"CASE WHEN {new} IS NULL THEN '{P.NOOP}' WHEN {now} IS NULL THEN '{P.FILL_MISSING}' WHEN {KEY(now)} = {KEY(new)} THEN '{P.NOOP}' ELSE '{P.REVIEW_REQUIRED}' END AS {name}_action, {new} AS {name}_value"


def _items_sql(x: str) -> str:
    some = f"list_filter(list_transform(coalesce(string_split({x}, ','), []), lambda y: {CLEAN('y')}), lambda y: y IS NOT NULL)"
    return f"list_filter({some}, lambda y, i: list_position(list_transform({some}, lambda z: {KEY('z')}), {KEY('y')}) = i)"


def _entries(spark, d):
    orders = table(spark, d, "orders")
    drafts, existing = (orders.filter(F.col("o_orderstatus") == s).selectExpr(*e) for s, e in (("O", DRAFTS), ("F", EXISTING)))
    return P.entry_plans(drafts, existing, ["o_custkey"], ["title", "company"], ["began", "ended"], "o_orderkey", ["o_orderkey"])


@query("apply_entry_plans", f"WITH {ENTRY_SQL} SELECT o_custkey, o_orderkey, found AS matched_existing_id, action, chosen FROM p")
def apply_entry_plans(spark, d):
    """Whether each entry of the drafts is new to its profile, and which entry it equals."""
    return _entries(spark, d).select("o_custkey", "o_orderkey", "matched_existing_id", "action", "chosen")


@query(
    "apply_plans",
    f"""WITH {ENTRY_SQL}, f AS (SELECT c_custkey, {", ".join(f"{e} AS {n}" for n, e in FIELDS.items())} FROM customer),
      l AS (SELECT c_custkey, {_value_sql("headline")}, {_value_sql("summary")}, {_items_sql("skills_now")} AS now, {_items_sql("skills_new")} AS new FROM f),
      a AS (SELECT *, list_filter(new, lambda y: NOT list_contains(list_transform(now, lambda z: {KEY("z")}), {KEY("y")})) AS added FROM l),
      n AS (SELECT o_custkey, count(*) FILTER (WHERE chosen) AS n FROM p GROUP BY 1)
    SELECT c_custkey, headline_action, headline_value, summary_action, summary_value, CASE WHEN len(added) > 0 THEN '{P.ADD_UNIQUE}' ELSE '{P.NOOP}' END AS skills_action, array_to_string(added, '|') AS skills_added,
      coalesce(n, 0) AS entries_added, (headline_action = '{P.FILL_MISSING}')::BIGINT + (summary_action = '{P.FILL_MISSING}')::BIGINT + (len(added) > 0)::BIGINT + coalesce(n, 0) AS chosen
    FROM a LEFT JOIN n ON o_custkey = c_custkey""",
)
def apply_plans(spark, d):
    """What each draft would change in its profile, and how many of the changes are chosen."""
    fields = table(spark, d, "customer").select("c_custkey", *[F.expr(e).alias(n) for n, e in FIELDS.items()])
    plans = fields.select(
        "c_custkey",
        P.value_plan(F.col("headline_now"), F.col("headline_new")).alias("headline"),
        P.value_plan(F.col("summary_now"), F.col("summary_new")).alias("summary"),
        P.list_plan(F.split("skills_now", ","), F.split("skills_new", ",")).alias("skills"),
    )
    counts = _entries(spark, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if("chosen").alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    chosen = sum((F.col(f"{c}.chosen").cast("long") for c in ("headline", "summary", "skills")), n)
    return plans.join(counts, "c_custkey", "left").select(
        "c_custkey", *[F.col(f"{c}.{v}").alias(f"{c}_{w}") for c in ("headline", "summary") for v, w in (("action", "action"), ("suggested", "value"))],
        F.col("skills.action").alias("skills_action"), F.array_join("skills.to_add", "|").alias("skills_added"), n.alias("entries_added"), chosen.alias("chosen"),
    )
