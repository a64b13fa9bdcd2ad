"""Queries over entries of sections: documents' own lines, and short CVs that are made from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import entries as E
from tessera.plans.base import query, spread, table

KINDS = (
    "year(o_orderdate) || ' - ' || (year(o_orderdate) + 2) || ' Senior Engineer'", "'Built reports for the team'", "''", "'Acme Data GmbH'", "year(o_orderdate) || ' Analyst'",
    "'present Blue Harbour'", "'• Led 3 projects in ' || year(o_orderdate)", "'Technical University of ' || o_orderpriority", "'Lead Developer | Remote'", "'mail lead@x.org or +49 30 1234567'",
    "'Yazılım Mühendisi'", "'Kuzey Yazılım Evi, İstanbul'", "year(o_orderdate) || ' Grand Foods'", "'• worked as manager'",
)
#: Ten lines for each order, each of one of the kinds; understood by Spark and DuckDB alike.
PICKS = ["(o_orderkey * 7 + o_custkey * %d + %d) %% %d" % (i + 1, 5 * i, len(KINDS)) for i in range(10)]
LINES = ", ".join("CASE %s %s END" % (pick, " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(KINDS))) for pick in PICKS)

NOT = r"[^\p{L}\p{N}_]"


def _whole_sql(x: str, words) -> str:
    return f"regexp_matches({x}, '(?:^|{NOT})(?:{'|'.join(E._bare(words))})(?:$|{NOT})')"


def entries_sql(lines: str, key: str) -> str:
    """Entries of the rows (key, spot, line) that a query gives: marks by line, then a walk over the lines of all keys at once."""
    years = r"(?:19|20)[0-9]{2}"
    ends = "present|current|ongoing|heute|devam"
    year = rf"regexp_matches(line, '(?:^|[^0-9]){years}(?:$|[^0-9])') OR regexp_matches(line, '(?i){years}\s*(?:-|–|—|to)\s*(?:{years}|{ends})')"
    short, rest = [w for w in E._bare(E.SCHOOLS) if len(w) <= 4], "|".join(w for w in E._bare(E.SCHOOLS) if len(w) > 4)
    places = "|".join(E.PLACES)
    phone = rf"trim(regexp_extract(clean, '{E.PHONE}'))"
    return rf"""WITH RECURSIVE l AS ({lines}),
      c AS (SELECT *, regexp_replace(trim(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{E.AROUND}'), '\s+', ' ', 'g') AS clean FROM l),
      w AS (SELECT *, lower(replace(translate(clean, '{E.MARKED}', '{E.BARE}'), 'ß', 'ss')) AS low FROM c),
      b AS (SELECT *, regexp_replace(low, '(?s)(^|{NOT})(?:{places})(?:$|{NOT}.*$)', '\1') AS before, regexp_extract(low, '^(?:{years})\s*[-–—]?\s+(.+)$', 1) AS title, regexp_extract(low, '^(?:{years}|{ends})\s*[-–—]?\s+(.+)$', 1) AS company, {year} AS dated FROM w),
      n AS (SELECT *, NOT regexp_matches(line, '{E.BULLET}') AND NOT (regexp_matches(clean, '{E.CONTACT}') OR ({phone} <> '' AND NOT regexp_full_match({phone}, '(?i){years}|{years}\s*(?:-|–|—|to)\s*{years}')))
             AND NOT dated AND clean <> '' AND length(clean) <= {E.NAMED} AND ({_whole_sql("low", E.ROLES)} OR regexp_matches(low, '{rest}') OR {_whole_sql("low", short)} OR {_whole_sql("low", E.COMPANIES)}
             OR (length(clean) <= {E.PLACED} AND before <> low AND regexp_matches(trim(before, ' ,'), '\S\s+\S'))) AS names FROM b),
      m AS (SELECT {key}, spot, line, trim(line) = '' AS blank, dated, dated OR names OR (contains(clean, '|') AND length(clean) <= {E.PIPED}) AS begins,
             {_whole_sql("title", E.ROLES)} AS titled, company <> '' AND NOT {_whole_sql("company", E.ROLES)} AS company FROM n),
      s AS (SELECT {key}, -1 AS spot, 0 AS entry, false AS open, false AS d, 0 AS size, false AS t FROM m WHERE spot = 0
        UNION ALL SELECT m.{key}, m.spot, CASE WHEN NOT m.blank AND (NOT s.open OR (s.d AND m.begins AND NOT (s.size = 1 AND s.t AND m.company))) THEN s.entry + 1 ELSE s.entry END,
          CASE WHEN m.blank THEN s.open AND s.d ELSE true END,
          CASE WHEN m.blank THEN s.d AND s.open WHEN NOT s.open OR (s.d AND m.begins AND NOT (s.size = 1 AND s.t AND m.company)) THEN m.dated ELSE s.d OR m.dated END,
          CASE WHEN m.blank THEN s.size WHEN NOT s.open OR (s.d AND m.begins AND NOT (s.size = 1 AND s.t AND m.company)) THEN 1 ELSE s.size + 1 END,
          CASE WHEN m.blank THEN s.t WHEN NOT s.open OR (s.d AND m.begins AND NOT (s.size = 1 AND s.t AND m.company)) THEN m.titled ELSE false END
        FROM s JOIN m ON m.{key} = s.{key} AND m.spot = s.spot + 1)
      SELECT s.{key}, (s.entry - 1)::INTEGER AS entry, count(*) AS n_lines, sha256(string_agg(m.line, chr(10) ORDER BY m.spot)) AS lines_sha256 FROM s JOIN m USING ({key}, spot) WHERE NOT m.blank GROUP BY 1, 2"""


def _rows(frame, key):
    made = frame.select(key, F.posexplode("entries").alias("entry", "own"))
    return made.select(key, "entry", F.size("own").cast("long").alias("n_lines"), F.sha2(F.array_join("own", "\n"), 256).alias("lines_sha256"))


@query("cv_entries", entries_sql(f"SELECT o_orderkey, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS spot FROM (SELECT o_orderkey, [{LINES}] AS x FROM orders)", "o_orderkey"))
def cv_entries(spark, d):
    """Entries of a short CV for every order."""
    orders = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"), "o_orderkey")
    kinds = orders.select("o_orderkey", "o_custkey", F.array(*map(F.expr, KINDS)).alias("kinds"))  # each kind once for an order, not once for a line
    made = kinds.select("o_orderkey", F.array(*[F.get("kinds", F.expr(pick)) for pick in PICKS]).alias("lines"))
    return _rows(E.entry_rows(made, "o_orderkey", "lines"), "o_orderkey")


@query("document_entries", entries_sql("SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS spot FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text <> '')", "doc_id"))
def document_entries(spark, d):
    """Entries of every whole document."""
    made = table(spark, d, "documents").filter("text <> ''").select("doc_id", F.split("text", "\n").alias("lines"))
    return _rows(E.entry_rows(made, "doc_id", "lines"), "doc_id")
