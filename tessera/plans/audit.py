"""Queries over logs of changes: a line item is a change of its part's price, from the list price to the discounted one in whole units."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import audit as U
from tessera.operators import retrieval as R
from tessera.plans.base import query, table

KEY, ORDER, MARK = ["part", "field"], ["changed_at", "l_orderkey", "l_linenumber"], "1998-06-15"
LOG_SQL = """SELECT l_partkey AS part, CASE l_linestatus WHEN 'F' THEN 'headline' ELSE 'summary' END AS field, l_extendedprice AS before,
    CASE WHEN l_discount > 0 THEN floor(l_extendedprice * (1 - l_discount)) END AS after, l_shipdate AS changed_at, l_orderkey, l_linenumber, l_returnflag FROM lineitem"""
LAST = "DESC, l_orderkey DESC, l_linenumber DESC"
VALUES_SQL = f"""SELECT part, field, CASE WHEN bool_or(l) THEN max(after) FILTER (WHERE l AND n = 1) ELSE max(before) FILTER (WHERE NOT l AND m = 1) END AS value FROM (
    SELECT *, changed_at < TIMESTAMP '{{mark}}' AS l, row_number() OVER (PARTITION BY part, field, changed_at < TIMESTAMP '{{mark}}' ORDER BY changed_at {LAST}, after DESC) AS n,
      row_number() OVER (PARTITION BY part, field, changed_at < TIMESTAMP '{{mark}}' ORDER BY changed_at, l_orderkey, l_linenumber, before) AS m FROM log) GROUP BY 1, 2"""


def _log(spark, d):
    items = table(spark, d, "lineitem")
    after = F.when(F.col("l_discount") > 0, F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double"))
    field = F.when(F.col("l_linestatus") == "F", "headline").otherwise("summary")
    return items.select(F.col("l_partkey").alias("part"), field.alias("field"), F.col("l_extendedprice").alias("before"), after.alias("after"), F.col("l_shipdate").alias("changed_at"), "l_orderkey", "l_linenumber", "l_returnflag")


@query("values_at_a_time", f"WITH log AS ({LOG_SQL}) {VALUES_SQL.format(mark=MARK)}")
def values_at_a_time(spark, d):
    """Every part's fields as they were at a time."""
    return U.values_at(_log(spark, d), KEY, ORDER, F.col("changed_at") < F.lit(MARK).cast("timestamp"))


@query(
    "reverted_fields",
    f"""WITH log AS ({LOG_SQL}), now AS ({VALUES_SQL.format(mark="2100-01-01")}),
         back AS (SELECT part, field, before, count(*) OVER (PARTITION BY part, field) AS reverts FROM log WHERE l_returnflag = 'R' AND field = 'headline'
                  QUALIFY row_number() OVER (PARTITION BY part, field ORDER BY changed_at {LAST}, before DESC) = 1)
       SELECT part, field, CASE WHEN reverts IS NOT NULL THEN before ELSE value END AS value, coalesce(reverts, 0) AS reverts FROM now LEFT JOIN back USING (part, field)""",
)
def reverted_fields(spark, d):
    """Every part's fields after the changes of returned items were reverted; summaries cannot be."""
    log = _log(spark, d)
    return U.reverted(U.values_at(log, KEY, ORDER, F.lit(True)), log, KEY, "value", ORDER, F.col("l_returnflag") == "R", ["headline"])


@query(
    "logged_changes",
    """WITH o AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 11 <> 0),
         n AS (SELECT c_custkey, CASE WHEN c_nationkey > 12 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 13 <> 0),
         f AS (SELECT * FROM (SELECT c_custkey, 'c_name' AS field, o.c_name AS before, n.c_name AS after FROM o FULL JOIN n USING (c_custkey)
               UNION ALL SELECT c_custkey, 'c_mktsegment', o.c_mktsegment, n.c_mktsegment FROM o FULL JOIN n USING (c_custkey)))
       SELECT * FROM f WHERE before IS DISTINCT FROM after""",
)
def logged_changes(spark, d):
    """The rows by which a log grows when a table of customers takes the place of an older one."""
    people = table(spark, d, "customer")
    new = people.filter("c_custkey % 13 <> 0").select("c_custkey", F.expr("if(c_nationkey > 12, upper(c_name), c_name)").alias("c_name"), F.expr("if(c_acctbal >= 0, c_mktsegment, null)").alias("c_mktsegment"))
    return U.changed_fields(people.filter("c_custkey % 11 <> 0"), new, ["c_custkey"], ["c_name", "c_mktsegment"])


@query("finalised_changes")
def finalised_changes(spark, d):
    """Whether each page's address was saved as it is, or normalised, and how far both lie apart."""
    pages = table(spark, d, "pages").select("page_id", "url", X.normalize_url(F.col("url")).alias("saved"))
    made = pages.select("page_id", "url", "saved", U.finalised(F.col("url"), F.col("saved")).alias("r"))
    both = (F.coalesce(U.quoted(F.col(c)), F.lit("null")) for c in ("url", "saved"))
    return made.select("page_id", "r.*", U.edit_distance(*both).alias("manual_edit_distance"))


PATCH_SQL = """SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN upper(c_name) ELSE c_name END AS name FROM customer"""


@query(
    "masked_updates",
    """SELECT c_custkey, c_nationkey, c_acctbal, CASE WHEN c_custkey % 5 < 3 AND c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 5 < 3 AND c_custkey % 3 = 1 THEN upper(c_name) ELSE c_name END AS c_name,
         CASE WHEN c_custkey % 5 = 1 THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
)
def masked_updates(spark, d):
    """Customers after patches that name one field, two, an unknown one, or none."""
    people = table(spark, d, "customer")
    return U.masked_update(people, _patches(people), ["c_custkey"], "fields", ["c_name", "c_mktsegment"])


@query(
    "refused_patches",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN 'no_fields' WHEN c_custkey % 5 = 3 THEN 'unknown_fields' ELSE 'no_row' END AS reason, CASE WHEN c_custkey % 5 = 3 THEN 'c_phone' ELSE '' END AS unknown
       FROM (SELECT c_custkey FROM customer UNION ALL SELECT -c_custkey - 1 FROM customer WHERE c_nationkey = 3) WHERE c_custkey < 0 OR c_custkey % 5 >= 3""",
)
def refused_patches(spark, d):
    people = table(spark, d, "customer")
    strangers = people.filter("c_nationkey = 3").select((-F.col("c_custkey") - 1).alias("c_custkey"), F.create_map(F.lit("c_name"), F.lit("x")).alias("fields"))
    return U.refused_patches(people, _patches(people).unionByName(strangers), ["c_custkey"], "fields", ["c_name", "c_mktsegment"])


def _patches(people):
    name = F.expr("case c_custkey % 3 when 0 then null when 1 then upper(c_name) else c_name end")
    one = F.create_map(F.lit("c_name"), name)
    two, unknown = F.map_concat(one, F.create_map(F.lit("c_mktsegment"), F.lit("NONE"))), F.map_concat(one, F.create_map(F.lit("c_phone"), F.lit("1")))
    rest = F.col("c_custkey") % 5
    return people.select("c_custkey", F.when(rest == 4, F.create_map().cast("map<string,string>")).when(rest == 3, unknown).when(rest == 1, two).otherwise(one).alias("fields"))


BODY_SQL = """SELECT user_id, '# Audit' || chr(10) || string_agg('Field: ' || event_type || ' | Value: ' || value::DECIMAL(18, 2) || ' | Status: ' || CASE WHEN value < 20 THEN 'draft' ELSE 'saved' END, chr(10) ORDER BY ts DESC, event_id DESC) AS body
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE {where}) WHERE n <= 20 GROUP BY 1"""
BEFORE = "ts < TIMESTAMP '2024-01-24' AND user_id % 7 <> 0"
AFTER = "ts < TIMESTAMP '2024-01-24' OR (user_id % 3 = 0 AND user_id % 5 <> 0)"


def _bodies(spark, d, where):
    events = table(spark, d, "events").filter(where)
    status = F.when(F.col("value") < 20, "draft").otherwise("saved")
    line = F.concat(F.lit("Field: "), F.col("event_type"), F.lit(" | Value: "), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" | Status: "), status)
    return U.latest_lines(events, ["user_id"], [F.desc("ts"), F.desc("event_id")], line, 20, "# Audit")


@query("rendered_logs", "SELECT user_id, sha256(body) AS checksum, length(body)::INTEGER AS characters FROM (" + BODY_SQL.format(where="true") + ")")
def rendered_logs(spark, d):
    """A document for each user, of the twenty latest events, which are the feature."""
    return _bodies(spark, d, "true").select("user_id", F.sha2("body", 256).alias("checksum"), F.length("body").alias("characters"))


@query(
    "stale_sources",
    f"""WITH s AS ({BODY_SQL.format(where=BEFORE)}), n AS ({BODY_SQL.format(where=AFTER)})
       SELECT user_id, CASE WHEN s.body IS NULL THEN 'pending' WHEN s.body = n.body THEN 'ready' ELSE 'stale' END AS status FROM s FULL JOIN n USING (user_id)""",
)
def stale_sources(spark, d):
    """What became of each user's stored document once later events are known."""
    return U.stale_marks(_stored(spark, d), _bodies(spark, d, AFTER), ["user_id"], "body")


def _stored(spark, d):
    return _bodies(spark, d, BEFORE).select("user_id", "body", F.sha2("body", 256).alias("checksum"))


@query("stale_chunks")
def stale_chunks(spark, d):
    """Stored chunks with the status carried from their source."""
    stored = _stored(spark, d)
    marks = U.stale_marks(stored, _bodies(spark, d, AFTER), ["user_id"], "body")
    chunks = R.chunk_rows(stored, "user_id", "body")
    return U.marked_children(chunks, marks, ["user_id"]).withColumn("content", F.sha2("content", 256))
