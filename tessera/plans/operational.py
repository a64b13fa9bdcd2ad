"""Operational queries: summaries, pages, latest rows, funnels, changes, resolution of duplicate postings.

The driver's tables stand in for postings: orders for postings with a state, customers for companies,
parts for titles, events for what readers did.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import analytics as A
from tessera.operators import entity as E
from tessera.operators import merge as M
from tessera.plans.base import query, table

OPEN = "o_orderstatus <> 'F'"
MEASURES = """count(*) AS total, coalesce(sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END), 0)::BIGINT AS active,
  coalesce(sum(CASE WHEN o_orderstatus <> 'F' THEN 0 ELSE 1 END), 0)::BIGINT AS inactive"""


@query("summary_overall", f"SELECT {MEASURES} FROM orders")
def summary_overall(spark, d):
    return A.activity(table(spark, d, "orders"), F.expr(OPEN))


@query("summary_by_source", f"SELECT o_orderpriority AS source, {MEASURES} FROM orders GROUP BY 1")
def summary_by_source(spark, d):
    return A.activity(table(spark, d, "orders"), F.expr(OPEN), [F.col("o_orderpriority").alias("source")])


@query("summary_by_company", f"SELECT c_mktsegment AS company, {MEASURES} FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def summary_by_company(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return A.activity(joined, F.expr(OPEN), [F.col("c_mktsegment").alias("company")])


@query(
    "postings_page",
    """SELECT p_partkey, p_name, p_brand, p_retailprice FROM part
       WHERE p_size >= 5 AND p_size <= 40 AND (coalesce(p_name, '') ILIKE '%re_%' OR coalesce(p_brand, '') ILIKE '%re_%')
       ORDER BY p_retailprice DESC NULLS LAST, p_partkey DESC LIMIT 25 OFFSET 25""",
)
def postings_page(spark, d):
    """A page is the feature: 25 rows, the second page."""
    rows = A.where_all(table(spark, d, "part"), equal={"p_type": None}, search="re_", search_in=["p_name", "p_brand"], between={"p_size": (5, 40)}, within={"p_brand": []})
    return A.page(rows, [F.desc("p_retailprice"), F.desc("p_partkey")], number="2", size="x").select("p_partkey", "p_name", "p_brand", "p_retailprice")


@query(
    "keyword_split",
    """SELECT (contains(lower(coalesce(text, '')), 'the') OR contains(lower(coalesce(source, '')), 'src1'))
         AND NOT (contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(source, '')), 'license')) AS passed,
         count(*) AS items FROM documents GROUP BY 1""",
)
def keyword_split(spark, d):
    docs = table(spark, d, "documents")
    passed = A.keyword_pass(docs, ["text"], ["The"], ["license"]) | A.keyword_pass(docs, ["source"], ["SRC1 "], ["license"])
    blocked = A.keyword_pass(docs, ["text", "source"], [], ["license"])
    return docs.groupBy((passed & blocked).alias("passed")).agg(F.count("*").alias("items"))


@query(
    "keyword_provenance",
    """SELECT p_partkey, field, keyword FROM (
         SELECT p_partkey, 'p_name' AS field, k AS keyword, contains(lower(coalesce(p_name, '')), k) AS hit FROM part, (VALUES ('ring'), ('red'), ('eco')) v(k)
         UNION ALL SELECT p_partkey, 'p_type', k, contains(lower(coalesce(p_type, '')), k) FROM part, (VALUES ('ring'), ('red'), ('eco')) v(k)) WHERE hit""",
)
def keyword_provenance(spark, d):
    part = table(spark, d, "part")
    found = part.select("p_partkey", F.explode(A.keyword_matches(part, ["p_name", "p_type"], ["Ring", "red", "RED ", "eco", " "])).alias("m"))
    return found.select("p_partkey", "m.field", "m.keyword")


@query(
    "digest_sections",
    """SELECT o_orderpriority AS source, o_orderstatus AS kind, count(*) AS items, min(o_orderdate) AS first_seen, max(o_orderkey) AS newest
       FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1, 2""",
)
def digest_sections(spark, d):
    rows = A.where_all(table(spark, d, "orders"), since=("o_orderdate", "1998-01-01 00:00:00"))
    return rows.groupBy(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("items"), F.min("o_orderdate").alias("first_seen"), F.max("o_orderkey").alias("newest"))


@query(
    "latest_per_company",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC NULLS LAST) AS k FROM orders) WHERE k = 1""",
)
def latest_per_company(spark, d):
    return A.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query(
    "best_contact",
    """SELECT o_custkey, o_orderkey, o_orderpriority FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey) AS k FROM orders) WHERE k = 1""",
)
def best_contact(spark, d):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return A.latest(table(spark, d, "orders"), ["o_custkey"], [rank, F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query(
    "employer_kpi",
    """SELECT c.c_nationkey AS employer, count(DISTINCT o.o_orderkey) AS postings,
         count(DISTINCT CASE WHEN o.o_orderstatus IN ('O', 'P') THEN o.o_orderkey END) AS active_postings,
         count(l.l_orderkey) AS applications, coalesce(sum(CASE WHEN l.l_returnflag = 'N' THEN 1 ELSE 0 END), 0)::BIGINT AS pending
       FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1""",
)
def employer_kpi(spark, d):
    # Applications are summed for each posting first, so that a popular employer is no hot key of the join.
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("p"))
    postings = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return postings.groupBy(F.col("c_nationkey").alias("employer")).agg(F.count("o_orderkey").alias("postings"), F.count_if(F.col("o_orderstatus").isin("O", "P")).alias("active_postings"), F.coalesce(F.sum("n"), F.lit(0)).alias("applications"), F.coalesce(F.sum("p"), F.lit(0)).alias("pending"))


@query(
    "posting_stats",
    """SELECT o_orderkey, count(l_orderkey) AS applicants, coalesce(sum(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END), 0)::BIGINT AS qualified,
         coalesce(sum(l_quantity), 0)::DOUBLE AS quantity
       FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag <> 'R' GROUP BY 1""",
)
def posting_stats(spark, d):
    """The condition belongs to the join: postings without matching applications stay, with zeros."""
    kept = table(spark, d, "lineitem").filter("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") >= 25).alias("q"), F.sum("l_quantity").alias("s"))
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return table(spark, d, "orders").join(kept, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", zero("n", 0).alias("applicants"), zero("q", 0).alias("qualified"), zero("s", 0.0).alias("quantity"))


@query(
    "candidate_best_score",
    """SELECT c_custkey, coalesce(max(o_totalprice), any_value(c_acctbal), 0)::DOUBLE AS best FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""",
)
def candidate_best_score(spark, d):
    best = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("m"))
    return table(spark, d, "customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("m", "c_acctbal", F.lit(0.0)).alias("best"))


@query(
    "funnel",
    """SELECT user_id, count(*) AS views, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS hires,
         round(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) * 100.0 / count(*), 4) AS conversion FROM events GROUP BY 1""",
)
def funnel(spark, d):
    hired = F.count_if(F.col("event_type") == "purchase")
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("views"), hired.alias("hires"), F.round(hired * 100.0 / F.count("*"), 4).alias("conversion"))


@query("source_breakdown", "SELECT event_type AS source, count(*) AS items, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def source_breakdown(spark, d):
    return A.shares(table(spark, d, "events"), F.col("event_type"), "source", F.col("value")).select("source", "items", F.round("share", 4).alias("share"), F.round("mean", 6).alias("mean"))


@query(
    "score_histogram",
    """SELECT CASE WHEN p_size >= 41 THEN '5: 41 and more' WHEN p_size >= 31 THEN '4: 31 to 40' WHEN p_size >= 21 THEN '3: 21 to 30' WHEN p_size >= 11 THEN '2: 11 to 20' ELSE '1: below 11' END AS band, count(*) AS items
       FROM part GROUP BY 1""",
)
def score_histogram(spark, d):
    band = A.bands(F.col("p_size"), [(41, "5: 41 and more"), (31, "4: 31 to 40"), (21, "3: 21 to 30"), (11, "2: 11 to 20")], "1: below 11")
    return table(spark, d, "part").groupBy(band.alias("band")).agg(F.count("*").alias("items"))


@query(
    "weekly_counts",
    """WITH days AS (SELECT ts::DATE AS day, count(*) AS items FROM events WHERE event_type = 'signup' GROUP BY 1 ORDER BY 1 DESC LIMIT 7),
         placed AS (SELECT 8 - row_number() OVER (ORDER BY day DESC) AS place, day, items FROM days)
       SELECT i::INTEGER AS place, strftime(day, '%Y-%m-%d') AS day, coalesce(items, 0) AS items FROM range(1, 8) r(i) LEFT JOIN placed ON place = i""",
)
def weekly_counts(spark, d):
    """Seven days are the feature."""
    return A.recent_days(table(spark, d, "events").filter("event_type = 'signup'"), F.col("ts")).withColumn("day", F.col("day").cast("string"))


AFFINITY_SQL = """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS opens,
    count(*) FILTER (event_type = 'signup') AS saves, count(*) FILTER (event_type = 'purchase') AS applies,
    coalesce(sum(CASE WHEN event_type = 'click' THEN floor(value) ELSE 0 END), 0)::BIGINT AS dwell, coalesce(max(CASE WHEN event_type = 'click' THEN floor(value) END), 0)::BIGINT AS longest
    FROM events WHERE event_type <> 'error' GROUP BY 1)
  SELECT *, round(least(1.0, least(0.06, ln(1 + impressions) * 0.016) + least(0.40, ln(1 + opens) * 0.18) + least(0.24, ln(1 + saves) * 0.16)
    + least(0.18, ln(1 + applies) * 0.13) + least(0.22, ln(1 + dwell / 30.0) * 0.085)), 4) AS affinity FROM c"""


@query("interaction_affinity", AFFINITY_SQL)
def interaction_affinity(spark, d):
    return E.interactions(table(spark, d, "events"))


@query("companies_without_postings", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def companies_without_postings(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("pruned_children", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def pruned_children(spark, d):
    open_orders = table(spark, d, "orders").filter(OPEN).select(F.col("o_orderkey").alias("l_orderkey"))
    return M.prune(table(spark, d, "lineitem"), open_orders, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query(
    "weighted_rank",
    """SELECT s_suppkey, round(0.65 * s_acctbal / 10000 + 0.35 * s_nationkey / 25.0, 6) AS weight FROM supplier
       ORDER BY weight DESC, s_suppkey LIMIT 20""",
)
def weighted_rank(spark, d):
    """The twenty best are the feature."""
    weight = F.round(0.65 * F.col("s_acctbal") / 10000 + 0.35 * F.col("s_nationkey") / 25.0, 6)
    return table(spark, d, "supplier").select("s_suppkey", weight.alias("weight")).orderBy(F.desc("weight"), "s_suppkey").limit(20)


@query(
    "diversified_all",
    """SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY deferred, s_acctbal DESC NULLS LAST, s_suppkey) AS place FROM (
         SELECT *, CASE WHEN row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_suppkey) = 1 THEN 0 ELSE 1 END AS deferred FROM supplier)""",
)
def diversified_all(spark, d):
    """Every supplier and its place."""
    return A.diversified_places(table(spark, d, "supplier"), "s_nationkey", [-F.col("s_acctbal"), F.col("s_suppkey")]).select("s_suppkey", "s_nationkey", "place")


@query(
    "employment_spans",
    """WITH s AS (SELECT user_id, date_diff('hour', TIMESTAMP '1970-01-01', ts)::INTEGER AS a, date_diff('hour', TIMESTAMP '1970-01-01', ts)::INTEGER + 6 AS z FROM events WHERE event_type <> 'error'),
         f AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
         g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM f)
       SELECT user_id, min(a)::INTEGER AS a, max(z)::INTEGER AS z FROM g GROUP BY user_id, island""",
)
def employment_spans(spark, d):
    hours = 24 * F.datediff("ts", F.lit("1970-01-01").cast("date")) + F.hour("ts")
    spans = table(spark, d, "events").filter("event_type <> 'error'").select("user_id", hours.alias("a"), (hours + 6).alias("z"))
    return A.merged_intervals(spans, ["user_id"], "a", "z")


@query(
    "sync_changes",
    """WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_orderdate < TIMESTAMP '1998-01-01' AS active FROM orders WHERE o_orderpriority <> '1-URGENT'),
         n AS (SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderpriority <> '5-LOW')
       SELECT change, count(*) AS items FROM (SELECT CASE WHEN o.o_orderkey IS NULL THEN 'inserted' WHEN n.o_orderkey IS NULL AND o.active THEN 'deactivated'
         WHEN n.o_orderkey IS NULL THEN 'gone' WHEN NOT o.active THEN 'reactivated' WHEN o.s IS NOT DISTINCT FROM n.s THEN 'unchanged' ELSE 'updated' END AS change
         FROM o FULL JOIN n USING (o_orderkey)) GROUP BY 1""",
)
def sync_changes(spark, d):
    """Two states of one table, made from it by rule, compared as a source's sync compares them."""
    orders = table(spark, d, "orders")
    old = orders.filter("o_orderpriority <> '1-URGENT'").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.expr("o_orderdate < TIMESTAMP '1998-01-01'").alias("active"))
    new = orders.filter("o_orderpriority <> '5-LOW'").select("o_orderkey", F.when(F.col("o_totalprice") > 400000, "X").otherwise(F.col("o_orderstatus")).alias("s"))
    return M.changes(old, new, ["o_orderkey"], ["s"], "active").groupBy("change").agg(F.count("*").alias("items"))


@query(
    "upserted_parts",
    """WITH o AS (SELECT p_partkey, p_name, p_size AS first_size, p_retailprice FROM part WHERE p_type <> 'ECONOMY'),
         n AS (SELECT p_partkey, upper(p_name) AS p_name, p_size + 1 AS first_size, p_retailprice * 2 AS p_retailprice FROM part WHERE p_size > 25)
       SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN n.p_partkey IS NULL THEN o.p_name ELSE n.p_name END AS p_name,
         coalesce(o.first_size, n.first_size) AS first_size, CASE WHEN n.p_partkey IS NULL THEN o.p_retailprice ELSE n.p_retailprice END AS p_retailprice
       FROM o FULL JOIN n ON o.p_partkey = n.p_partkey""",
)
def upserted_parts(spark, d):
    """An old and a new state made from the table by rule; a first value once known stays."""
    part = table(spark, d, "part")
    old = part.filter("p_type <> 'ECONOMY'").select("p_partkey", "p_name", F.col("p_size").alias("first_size"), "p_retailprice")
    new = part.filter("p_size > 25").select("p_partkey", F.upper("p_name").alias("p_name"), (F.col("p_size") + 1).alias("first_size"), (F.col("p_retailprice") * 2).alias("p_retailprice"))
    return M.upsert(old, new, ["p_partkey"], keep=["first_size"])


@query(
    "tombstoned",
    "SELECT p_partkey, (p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')) AND p_size > 10 AS live FROM part",
)
def tombstoned(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") > 10).alias("live"))
    seen = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return M.tombstone(rows, seen, ["p_partkey"], "live")


@query(
    "last_of_batch",
    """SELECT user_id, event_type, min(event_id) AS place, max_by(value, event_id) AS value FROM events GROUP BY 1, 2""",
)
def last_of_batch(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("place"), "value")
    return M.last_of_batch(rows, ["user_id", "event_type"], "place")


@query(
    "reinforced_memory",
    """SELECT user_id, event_type, max(value) AS confidence, max(ts) AS seen_at, count(*) AS times FROM events GROUP BY 1, 2""",
)
def reinforced_memory(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", F.col("value").alias("confidence"), F.col("ts").alias("seen_at"))
    early, late = rows.filter("seen_at < TIMESTAMP '2024-01-16'"), rows.filter("seen_at >= TIMESTAMP '2024-01-16'")
    key = ["user_id", "event_type"]
    memory = early.groupBy(*key).agg(F.max("confidence").alias("confidence"), F.max("seen_at").alias("seen_at"), F.count("*").alias("times"))
    return M.reinforce(memory, late, key)


RESOLVED_SQL = """WITH g AS (SELECT p_partkey AS record, p_partkey // 3 AS g, p_partkey // 3 % 5 AS c, p_brand, p_name, p_type, p_size, p_retailprice FROM part),
    r AS (SELECT record, p_size, p_retailprice, CASE WHEN c = 4 THEN 'p' || record ELSE 'g' || g END AS key, CASE WHEN c IN (0, 2) THEN 'title ' || g ELSE lower(p_name) END AS title,
      CASE WHEN c = 2 THEN 'company' ELSE lower(p_brand) END AS company, CASE WHEN c = 2 THEN 'berlin' ELSE lower(p_type) END AS place, CASE WHEN c = 0 THEN 'https://x.example/' || g WHEN c = 1 THEN 'https://x.example/jobs/' || g END AS url FROM g),
    q AS (SELECT key, arg_max(record, (p_size, p_retailprice, -record)) AS primary_record, count(*) AS members, count(DISTINCT url) AS urls, count(DISTINCT title) AS titles, count(DISTINCT company) AS companies, count(DISTINCT place) AS places FROM r GROUP BY key),
    m AS (SELECT key, primary_record, members, CASE WHEN members = 1 THEN 'single_source_record' WHEN urls = 1 AND titles = 1 THEN 'exact_apply_url_and_title' WHEN urls = 1 THEN 'exact_apply_url'
      WHEN companies = 1 AND titles = 1 AND places = 1 THEN 'normalized_company_title_location' ELSE 'title_company_cluster' END AS merge_reason FROM q)
  SELECT *, least(0.995, CASE merge_reason WHEN 'single_source_record' THEN 0.9 WHEN 'exact_apply_url_and_title' THEN 0.99 WHEN 'exact_apply_url' THEN 0.97 WHEN 'normalized_company_title_location' THEN 0.94 ELSE 0.88 END
    + CASE WHEN members >= 3 THEN 0.01 ELSE 0 END)::DOUBLE AS confidence FROM m"""


@query("resolved_postings", RESOLVED_SQL)
def resolved_postings(spark, d):
    """Groups of three parts, each made alike in other ways, so that every reason to merge occurs."""
    g, c = F.expr("p_partkey div 3"), F.expr("p_partkey div 3 % 5")
    records = table(spark, d, "part").select(
        F.col("p_partkey").alias("record"), "p_size", "p_retailprice", F.when(c == 4, F.concat(F.lit("p"), "p_partkey")).otherwise(F.concat(F.lit("g"), g)).alias("key"),
        F.when(c.isin(0, 2), F.concat(F.lit("Title  "), g)).otherwise(F.col("p_name")).alias("title"), F.when(c == 2, "Company ").otherwise(F.col("p_brand")).alias("company"), F.when(c == 2, "BERLIN").otherwise(F.col("p_type")).alias("location"),
        F.when(c == 0, F.concat(F.lit("https://x.example/"), g)).when(c == 1, F.concat(F.lit("HTTPS://X.example//jobs/"), g, F.lit("/?from="), "p_partkey")).alias("url"),
    )
    return E.resolve(records, [F.col("p_size"), F.col("p_retailprice"), -F.col("record")]).select("key", "primary_record", "members", "merge_reason", "confidence")


@query(
    "group_trust",
    """WITH s AS (SELECT l_partkey, l_returnflag, least(1.0, greatest(0.2, 0.5 + l_discount + CASE WHEN l_returnflag = 'A' THEN 0.01 WHEN l_returnflag = 'N' THEN 0.005 ELSE -0.03 END)) AS trust, l_suppkey FROM lineitem)
       SELECT l_partkey, round(least(1.0, round(max(round(trust, 4)), 4) + least(0.02, 0.01 * (count(DISTINCT l_returnflag) - 1)) + CASE WHEN count(*) > 1 AND count(DISTINCT l_suppkey) = 1 THEN 0.01 ELSE 0 END), 4)::DOUBLE AS trust FROM s GROUP BY 1""",
)
def group_trust(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", 0.01).when(F.col("l_returnflag") == "N", 0.005).otherwise(-0.03)
    trust = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.2), 0.5 + F.col("l_discount") + kind)), 4)
    rows = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", F.col("l_suppkey").cast("string").alias("url"), trust.alias("trust"))
    return rows.groupBy("l_partkey").agg(E.group_trust(F.col("trust"), F.col("l_returnflag"), F.col("url")).alias("trust"))
