"""Queries over canonical postings, their links, and labels by rule tables.

Parts stand in for source records (three to a posting), regions for their sources.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.text import COMPLETENESS_STEPS
from tessera.operators import canonical as C
from tessera.operators.entity import CONFIDENCE
from tessera.plans.base import query, spread, table
from tessera.plans.texts import rule_sql

TYPES = ("greenhouse", "workday", "company_careers", "other", "lever")
NOW = "2030-01-01"

STEPS = "CASE " + " ".join(f"WHEN length(description) >= {n} THEN {v}" for n, v in COMPLETENESS_STEPS) + " ELSE 0.2 END"
CHANGES = "CASE type " + " ".join(f"WHEN '{name}' THEN {value}" for value, names in V.TRUSTED_SOURCES for name in names) + " ELSE -0.03 END"
KEYED_SQL = f"""WITH s AS (SELECT r_regionkey AS sid, {list(TYPES)}[r_regionkey + 1] AS type, lower(r_name) AS name, 0.5 + 0.1 * r_regionkey AS trust FROM region WHERE r_regionkey <> 3),
    p AS (SELECT p_partkey AS id, p_partkey // 3 AS g, p_partkey // 3 % 5 AS c, p_name, p_size FROM part WHERE p_partkey % 13 <> 0),
    r AS (SELECT id, CASE WHEN c = 1 THEN g % 5 ELSE id % 5 END AS sid, CASE WHEN c = 1 THEN 'e' || g ELSE 'x' || id END AS external, 'acme ' || g % 7 AS company, CASE WHEN c < 4 THEN 'data engineer ' || g ELSE 'sales ' || id END AS title,
      CASE c WHEN 0 THEN 'https://x.example/j/' || g WHEN 2 THEN 'https://y.example/' || g WHEN 3 THEN 'https://z.example/' || id END AS link,
      nullif(trim(repeat(p_name || ' ', p_size)), '') AS description, TIMESTAMP '2024-01-01' + to_days(p_size) AS seen, CASE WHEN c <> 3 THEN TIMESTAMP '2023-12-01' + to_days((id % 20)::INTEGER) END AS posted FROM p),
    k AS (SELECT *, company || '|' || title || '|berlin, germany|' || coalesce(link, type || ':' || name || ':' || external) AS key, round(greatest(0.2, least(1.0, trust + {CHANGES})), 4) AS quality FROM r JOIN s USING (sid)),
    o AS (SELECT *, (quality, {STEPS.replace("description", "coalesce(description, '')")}, link IS NOT NULL, seen, coalesce(posted, TIMESTAMP '1970-01-01'), -id) AS o FROM k),
    j AS (SELECT key, arg_max(id, o) AS primary_record, arg_max(title || ' ' || coalesce(description, ''), o) AS text, count(*) AS members, max(seen) AS last_seen_at, max(posted) AS posted_at,
      round(least(1.0, max(quality) + least(0.02, 0.01 * (count(DISTINCT type) - 1)) + CASE WHEN count(*) > 1 AND count(DISTINCT link) = 1 THEN 0.01 ELSE 0 END), 4)::DOUBLE AS trust,
      CASE WHEN count(*) = 1 THEN 'single_source_record' WHEN count(DISTINCT link) = 1 THEN 'exact_apply_url_and_title' ELSE 'normalized_company_title_location' END AS merge_reason FROM o GROUP BY key),
    c AS (SELECT *, least(0.995, CASE merge_reason {" ".join(f"WHEN '{r}' THEN {v}" for r, v in CONFIDENCE.items())} END + CASE WHEN members >= 3 THEN 0.01 ELSE 0 END)::DOUBLE AS confidence FROM j)"""


def _keyed(spark, d):
    sources = table(spark, d, "region").select(
        F.col("r_regionkey").alias("source_id"), F.element_at(F.array(*map(F.lit, TYPES)), F.col("r_regionkey") + 1).alias("source_type"), F.lower("r_name").alias("source_name"), (0.5 + 0.1 * F.col("r_regionkey")).alias("trust"),
        F.lit("DE").alias("country_scope"), (F.col("r_regionkey") != 3).alias("is_active"),
    )
    g, c = F.expr("p_partkey div 3"), F.expr("p_partkey div 3 % 5")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    of_group = F.when(c == 0, text("HTTPS://X.example//j/", g, "/?from=", F.col("p_partkey"))).when(c == 3, text("https://z.example/", F.col("p_partkey")))
    parts = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    records = parts.select(
        F.col("p_partkey").alias("record_id"), F.when(c == 1, g % 5).otherwise(F.col("p_partkey") % 5).cast("int").alias("source_id"), F.when(c == 1, text("E", g)).otherwise(text("X", F.col("p_partkey"))).alias("external_job_id"),
        text("Acme  ", g % 7).alias("company"), F.when(c < 4, text("Data Engineer ", g)).otherwise(text("Sales ", F.col("p_partkey"))).alias("title"), F.lit("Berlin, Germany").alias("location"),
        of_group.alias("apply_url"), F.when(c == 2, text("https://y.example/", g)).alias("canonical_url"), F.to_json(F.struct(F.expr("repeat(concat(p_name, ' '), p_size)").alias("text"))).alias("payload"),
        F.expr("TIMESTAMP '2024-01-01' + make_dt_interval(p_size)").alias("last_seen_at"), F.when(c != 3, F.expr("TIMESTAMP '2023-12-01' + make_dt_interval(cast(p_partkey % 20 as int))")).alias("posted_at"), (F.col("p_partkey") % 13 != 0).alias("is_active"),
    )
    return C.keyed_records(records, sources)


def _jobs(spark, d):
    return C.canonical_jobs(_keyed(spark, d), F.lit(NOW).cast("timestamp"))


@query("canonical_postings", KEYED_SQL + f"""SELECT key AS canonical_key, primary_record, members, merge_reason, confidence, trust, {rule_sql("text", V.ROLE_FAMILIES)} AS category, {rule_sql("text", V.DEPARTMENTS)} AS department, last_seen_at, posted_at FROM c""")
def canonical_postings(spark, d):
    """One posting for each canonical key, from the active records of active sources."""
    return _jobs(spark, d).select("canonical_key", "primary_record", "members", "merge_reason", "confidence", "trust", "category", "department", "last_seen_at", "posted_at")


@query("canonical_posting_links", KEYED_SQL + "SELECT key AS canonical_key, id AS record_id, merge_reason, confidence FROM k JOIN c USING (key)")
def canonical_posting_links(spark, d):
    """Every record with the posting that it belongs to, why, and how surely."""
    return C.canonical_links(_keyed(spark, d), _jobs(spark, d))


@query("refreshed_postings", KEYED_SQL + "SELECT key AS canonical_key, primary_record IS NOT NULL AND members >= 2 AS is_active FROM c")
def refreshed_postings(spark, d):
    """A refresh that only brings postings of several records: the others are deactivated and kept."""
    jobs = _jobs(spark, d)
    return C.refreshed(jobs, jobs.filter("members >= 2")).select("canonical_key", "is_active")


TABLES = {"role": V.ROLE_FAMILIES, "discipline": V.DISCIPLINES, "department": V.DEPARTMENTS, "education": V.EDUCATION, "scope": V.SCOPES}
LISTS = {"skills": (V.SKILL_RULES, 24), "domains": (V.DOMAINS, 12), "languages": (V.LANGUAGES, 8)}
#: Every key word of all tables, from which each part's text takes four.
WORDS = [w for rules in (*TABLES.values(), *(r for r, _ in LISTS.values())) for _, words in rules for w in words] + list(V.MANAGEMENT)
PICKED = [f"p_partkey * {k} % {len(WORDS)} + 1" for k in (1, 7, 13, 31)]


def _list_sql(rules, limit: int) -> str:
    hits = ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, {w!r})' for w in words)} THEN '{name}' END" for name, words in rules)
    return f"array_to_string(list_filter([{hits}], lambda x: x IS NOT NULL)[1:{limit}], ',')"


@query(
    "rule_labels",
    f"""WITH w AS (SELECT [{", ".join(repr(w) for w in WORDS)}] AS w), p AS (SELECT p_partkey, regexp_replace(trim(lower(p_name) || {" || ".join(f"' ' || w[{i}]" for i in PICKED)}), ' +', ' ', 'g') AS t FROM part, w)
       SELECT p_partkey, {", ".join(f"{rule_sql('t', rules)} AS {name}" for name, rules in TABLES.items())}, {", ".join(f"{_list_sql(*x)} AS {name}" for name, x in LISTS.items())},
         CASE WHEN {" OR ".join(f"contains(t, '{w}')" for w in V.MANAGEMENT)} THEN 1 ELSE 0 END AS manages FROM p""",
)
def rule_labels(spark, d):
    """Every table of labels over a text for each part that holds four of the tables' own key words."""
    every = F.array(*map(F.lit, WORDS))
    text = F.concat_ws(" ", "p_name", *[F.element_at(every, F.expr(f"cast({i} as int)")) for i in PICKED])
    rows = spread(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").select("p_partkey", V.joined(text).alias("t"))
    t = F.col("t")
    lists = [F.array_join(V.labels_in(rules, t, limit), ",").alias(name) for name, (rules, limit) in LISTS.items()]
    return rows.select("p_partkey", *[V.label_in(rules, t).alias(name) for name, rules in TABLES.items()], *lists, V.manages_in(t).cast("int").alias("manages"))
