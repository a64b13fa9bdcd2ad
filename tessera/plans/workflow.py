"""Queries over review workflows, queues, runs, look-ups and profile checks.

Customers stand in for candidates and employers, orders for applications with a stage, events for audited actions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import workflow as W
from tessera.plans.base import ENTRIES, query, table


@query(
    "candidate_workflow",
    """SELECT c_custkey, coalesce(tags, '') AS tags, coalesce(notes, 0) AS notes, last_note, stage FROM customer LEFT JOIN (
         SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS tags, count(*) FILTER (o_totalprice >= 100000) AS notes,
           first('order ' || o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC) FILTER (o_totalprice >= 100000) AS last_note, first(o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS stage
         FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
)
def candidate_workflow(spark, d):
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    note = F.when(F.col("o_totalprice") >= 100000, entry("note", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))))
    found = F.array_compact(F.array(entry("tag", F.col("o_orderpriority")), note, entry("stage", F.col("o_orderstatus"))))
    entries = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", F.inline(found))
    out = W.workflow(table(spark, d, "customer").select("c_custkey"), entries, "c_custkey", "kind", "value", ["o_orderdate", "o_orderkey"])
    return out.withColumn("tags", F.array_join("tags", "|"))


@query(
    "employer_averages",
    """SELECT c_nationkey AS employer, count(l_quantity) AS applications, floor(coalesce(sum(l_quantity) / nullif(count(l_quantity), 0), 0) * 10 + 0.5) / 10 AS average
       FROM customer JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
)
def employer_averages(spark, d):
    # Summed for each posting first, so that a popular employer is no hot key of the join.
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("l_quantity").alias("n"), F.sum("l_quantity").alias("s"))
    postings = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    summed = postings.groupBy(F.col("c_nationkey").alias("employer")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("applications"), F.sum("s").alias("s"))
    mean = F.coalesce(F.col("s") / F.nullif("applications", F.lit(0)), F.lit(0.0))
    return summed.select("employer", "applications", W.rounded(mean).alias("average"))


@query(
    "posting_averages",
    """SELECT o_orderkey, count(l_orderkey) AS applicants, count(*) FILTER (l_quantity >= 25) AS qualified, floor(coalesce(sum(l_quantity) / nullif(count(l_quantity), 0), 0) * 10 + 0.5) / 10 AS average
       FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
)
def posting_averages(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") >= 25).alias("q"), F.avg("l_quantity").alias("a"))
    rows = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("applicants"), F.coalesce("q", F.lit(0)).alias("qualified"), W.rounded(F.coalesce("a", F.lit(0.0))).alias("average"))


@query(
    "candidate_latest",
    """SELECT c_custkey, coalesce(best, c_acctbal, 0)::DOUBLE AS best, stage FROM customer LEFT JOIN (
         SELECT o_custkey, max(o_totalprice) AS best, first(o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS stage FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
)
def candidate_latest(spark, d):
    found = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("m"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("stage"))
    return table(spark, d, "customer").join(found, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("m", "c_acctbal", F.lit(0.0)).alias("best"), "stage")


QUEUE = {"O": "ready", "P": "review", "F": "blocked"}


@query(
    "queue_counts",
    """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS ready, count(*) FILTER (o_orderstatus = 'P') AS review, count(*) FILTER (o_orderstatus = 'F') AS blocked FROM orders""",
)
def queue_counts(spark, d):
    status = F.create_map(*[F.lit(x) for kv in QUEUE.items() for x in kv])[F.col("o_orderstatus")]
    return W.status_counts(table(spark, d, "orders").select(status.alias("status")), "status", list(QUEUE.values()))


@query(
    "run_summaries",
    """SELECT user_id, count(*) AS total, count(*) FILTER (event_type IN ('purchase', 'signup')) AS succeeded, count(*) FILTER (event_type IN ('click', 'view')) AS partial,
         count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1""",
)
def run_summaries(spark, d):
    """A user's events stand in for the items of one batch run."""
    kind = F.col("event_type")
    status = F.when(kind.isin("purchase", "signup"), "succeeded").when(kind.isin("click", "view"), "partial").when(kind == "error", "failed")
    return W.status_counts(table(spark, d, "events").select("user_id", status.alias("status")), "status", ["succeeded", "partial", "failed"], ["user_id"])


@query("metric_totals", "SELECT event_type, count(value) AS n, round(coalesce(sum(value), 0), 4) AS total, round(coalesce(avg(value), 0), 6) AS mean FROM events GROUP BY 1")
def metric_totals(spark, d):
    return W.metrics(table(spark, d, "events"), "event_type", "value").withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query(
    "line_confidence",
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax > 0 THEN (l_discount + l_tax) / 2 ELSE l_discount END, 6) AS confidence FROM lineitem""",
)
def line_confidence(spark, d):
    mean = W.mean_confidence(F.array("l_discount"), F.array("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(mean, 6).alias("confidence"))


@query(
    "category_terms",
    """SELECT p_type, string_agg(term, ' ' ORDER BY term) AS terms, count(*) AS n FROM (SELECT DISTINCT p_type, unnest(string_split(p_name, ' ')) AS term FROM part) WHERE term <> '' GROUP BY 1""",
)
def category_terms(spark, d):
    found = W.grouped_terms(table(spark, d, "part"), "p_type", F.split("p_name", " "))
    return found.select("p_type", F.array_join("terms", " ").alias("terms"), F.size("terms").cast("long").alias("n"))


@query(
    "ready_items",
    """SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       WHERE o_orderstatus = 'O' AND l_linestatus = 'O' AND l_returnflag = 'N' AND l_quantity IS NOT NULL AND o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def ready_items(spark, d):
    """Sources, documents and chunks that are all ready stand as orders, lines and their flags."""
    state = lambda c, v: F.when(F.col(c) == v, "ready")
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    wanted = W.ready([state("o_orderstatus", "O"), state("l_linestatus", "O"), state("l_returnflag", "N")], F.col("l_quantity"), [(F.col("o_orderpriority"), ("1-URGENT", "2-HIGH")), (F.col("l_linenumber"), ())])
    return rows.filter(wanted).select("l_orderkey", "l_linenumber")


@query(
    "audit_sensitivity",
    """SELECT event_id, CASE event_type WHEN 'signup' THEN 'high' WHEN 'error' THEN 'high' WHEN 'click' THEN 'medium' ELSE 'low' END AS sensitivity FROM events""",
)
def audit_sensitivity(spark, d):
    kind = F.col("event_type")
    event = F.when(kind == "signup", "employer.auth.signup").when(kind == "error", "employer.audit.error").otherwise(F.concat(F.lit("employer.job."), kind))
    return table(spark, d, "events").select("event_id", W.sensitivity(event, F.when(kind == "click", "candidate_note").otherwise("job")).alias("sensitivity"))


@query(
    "shown_terms",
    """SELECT p_partkey, array_to_string(list_filter([a, b, c, 'team work'], lambda x: x <> ''), '|') AS terms FROM (
         SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS a, CASE WHEN lower(split_part(p_name, ' ', 2)) <> lower(split_part(p_name, ' ', 1)) THEN lower(split_part(p_name, ' ', 2)) ELSE '' END AS b,
           CASE WHEN lower(p_type) IN (lower(split_part(p_name, ' ', 1)), lower(split_part(p_name, ' ', 2))) THEN '' ELSE lower(p_type) END AS c FROM part)""",
)
def shown_terms(spark, d):
    terms = F.concat(F.slice(F.split("p_name", " "), 1, 2), F.array(F.lit("Senior"), F.col("p_type"), F.lit(" team_work "), F.lit("")))
    return table(spark, d, "part").select("p_partkey", F.array_join(W.display_terms(terms), "|").alias("terms"))


@query(
    "location_fit",
    """SELECT p_partkey, coalesce(len(list_filter(string_split(p_name, ' '), lambda a: contains(lower(a), 'small') OR contains('small', lower(a)) OR contains(lower(a), 'old') OR contains('old', lower(a)))) > 0, false) AS fit FROM part""",
)
def location_fit(spark, d):
    return table(spark, d, "part").select("p_partkey", W.either_contains(F.split("p_name", " "), F.array(F.lit("Small"), F.lit("OLD"))).alias("fit"))


@query(
    "profile_checks",
    """SELECT c_custkey, ((a::INT + b::INT + c::INT + d::INT) * 25)::INT AS score, concat_ws('|', CASE WHEN NOT a THEN 'full_name' END, CASE WHEN NOT b THEN 'balance' END, CASE WHEN NOT c THEN 'skills' END, CASE WHEN NOT d THEN 'experience' END) AS missing
       FROM (SELECT c_custkey, coalesce(trim(c_name) <> '', false) AS a, coalesce(c_acctbal >= 1000, false) AS b, coalesce(kinds >= 3, false) AS c, coalesce(n >= 1, false) AS d FROM customer LEFT JOIN (
         SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1) ON c_custkey = o_custkey)""",
)
def profile_checks(spark, d):
    # Kinds are made distinct by a small set for each customer, not by a second shuffle.
    found = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.size(F.collect_set("o_orderpriority")).alias("kinds"))
    rows = table(spark, d, "customer").join(found, F.col("c_custkey") == F.col("o_custkey"), "left")
    checks = {"full_name": F.trim("c_name") != "", "balance": F.col("c_acctbal") >= 1000, "skills": F.col("kinds") >= 3, "experience": F.col("n") >= 1}
    return rows.select("c_custkey", W.checked(checks).alias("c")).select("c_custkey", "c.score", F.array_join("c.missing", "|").alias("missing"))


@query(
    "snapshot_lookup",
    f"""WITH n AS ({ENTRIES['url_normalized'][1]}), c AS (SELECT url AS known, min(page_id) AS snapshot FROM n GROUP BY 1)
       SELECT p.page_id, CASE WHEN e.known IS NOT NULL THEN 1 ELSE 2 END::INTEGER AS rank, coalesce(e.snapshot, c.snapshot) AS snapshot FROM pages p JOIN n USING (page_id)
       LEFT JOIN c AS e ON e.known = p.url LEFT JOIN c ON c.known = n.url WHERE e.known IS NOT NULL OR c.known IS NOT NULL""",
)
def snapshot_lookup(spark, d):
    """Each page's snapshot by its address as written, else by its normalised one."""
    pages = table(spark, d, "pages").select("page_id", F.col("url"), X.normalize_url(F.col("url")).alias("normal"))
    catalog = pages.groupBy(F.col("normal").alias("known")).agg(F.min("page_id").alias("snapshot"))
    return W.ranked_lookup(pages, "page_id", [F.col("url"), F.col("normal")], catalog, "known", "snapshot")
