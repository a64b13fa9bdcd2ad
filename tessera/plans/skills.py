"""Skills named by the sections of short CVs that are made from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import skills as K
from tessera.plans.base import query, spread, table

PHRASES = (
    "Python, Docker and K8s", "We react to market changes", "react.js with Next.js", "built in Go", "go home early", "C++ / C# / CI/CD", "Node.js", "SQL; PostgreSQL | postgre sql",
    "Führung und iletişim", "Apache Spark", "REST APIs using express", "a swift answer", "AWS", "ml_ops, ML testing", "nothing here", "js and t-rpc", "html5éhtml css_css", "",
    "vue: a very long line of words that say nothing whatever before any word of the other kind comes, cloud", "Problem Çözme_x problem solving",
)
SECTIONS = ("'skills'", "'projects'", "'experience'", "'Summary'", "'header'", "'languages'", "NULL")
#: Three sections for each order; understood by Spark and DuckDB alike.
TEXT = lambda i: "(CASE (o_orderkey * 3 + %d) %% %d %s END) || ' - ' || (CASE (o_custkey * 7 + o_orderkey + %d) %% %d %s END)" % (
    i, len(PHRASES), " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PHRASES)), 5 * i, len(PHRASES), " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PHRASES))
)
TEXTS = ", ".join(TEXT(i) for i in range(3))
SECTION = "CASE (o_orderkey + o_custkey * spot) %% %d %s END" % (len(SECTIONS), " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(SECTIONS)))


def skills_sql(rows: str) -> str:
    """Skills of the rows (k, spot, section, text) that a query gives: every alias against every text."""
    known = ", ".join(
        f"({i}, {n}, '{a}', '{K.CATALOGUE[i][0]}', '{K.CATALOGUE[i][2]}', {K.CATALOGUE[i][3]}, {a.isascii() and a.isalnum()})" for i, n, a in K.aliases()
    )
    other = r"[^\p{L}\p{N}_]"
    context = f"(?:^|{other})(?:{'|'.join(K.CONTEXT)})(?:$|{other})"
    boost = " ".join(f"WHEN '{s}' THEN {b}" for s, b in K.BOOSTS.items())
    return rf"""WITH r AS (SELECT k, spot, lower(coalesce(section, 'other')) AS section, text, lower(text) AS low FROM ({rows})),
      c(skill, alias, word, name, category, ambiguous, whole) AS (VALUES {known}),
      h AS (SELECT *, string_split(low, word) AS parts FROM r JOIN c ON contains(low, word)),
      i AS (SELECT *, unnest(range(1, len(parts))) AS i FROM h),
      l AS (SELECT *, list_sum([length(x) for x in parts[1:i]])::BIGINT + (i - 1) * length(word) AS begins FROM i),
      u AS (SELECT *, left(low, begins) AS before, substr(low, begins + length(word) + 1) AS after FROM l),
      v AS (SELECT *, regexp_matches(low, '{context}') AS signal FROM u WHERE NOT CASE WHEN whole THEN regexp_matches(right(before, 1), '[\p{{L}}\p{{N}}_]') OR regexp_matches(left(after, 1), '[\p{{L}}\p{{N}}_]')
            ELSE regexp_matches(right(before, 1), '[A-Za-z0-9]') OR regexp_matches(left(after, 1), '[A-Za-z0-9]') END
            AND (NOT ambiguous OR section IN ('skills', 'projects') OR regexp_matches(right(before, {K.WINDOW}) || word || left(after, {K.WINDOW}), '{context}'))),
      s AS (SELECT *, substr(text, begins + 1, length(word)) AS matched, round(greatest(0, least(1, {K.BASE}::DOUBLE + {K.NAMED} + CASE section {boost} ELSE 0 END
            + CASE WHEN signal THEN {K.SIGNAL} ELSE 0 END - CASE WHEN ambiguous THEN {K.COMMON} ELSE 0 END)), 4)::DOUBLE AS confidence FROM v)
      SELECT k AS o_orderkey, name AS skill, category, CASE category WHEN '{K.SOFT}' THEN 'soft_skill' ELSE 'hard_skill' END AS kind, section, matched, ambiguous, confidence,
        CASE WHEN confidence >= {K.HIGH} THEN 'high' WHEN confidence >= {K.MEDIUM} THEN 'medium' ELSE 'low' END AS level
      FROM s QUALIFY row_number() OVER (PARTITION BY k, skill ORDER BY confidence DESC, spot, alias, begins) = 1"""


@query("cv_skills", skills_sql(f"SELECT o_orderkey AS k, spot, {SECTION} AS section, text FROM (SELECT o_orderkey, o_custkey, unnest(x) AS text, generate_subscripts(x, 1) - 1 AS spot FROM (SELECT o_orderkey, o_custkey, [{TEXTS}] AS x FROM orders))"))
def cv_skills(spark, d):
    """The skills of a short CV for every order, with the section that names each best."""
    rows = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select("o_orderkey", "o_custkey", F.posexplode(F.expr(f"array({TEXTS})")).alias("spot", "text"))
    return K.resolve(rows.withColumn("section", F.expr(SECTION)), ["o_orderkey"], "spot", "section", "text")
