"""Queries over the layout of documents: sections, ranges of dates, near-duplicate hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dates as T
from tessera.operators import analytics as A
from tessera.operators import documents as D
from tessera.operators import sections as S
from tessera.plans.base import query, table
from tessera.plans.texts import SIMHASH_SQL

# Names of months in the notations that are made from order dates.
EN = "'Jan,Feb,March,April,May,June,Jul,Aug,Sept,October,Nov,December'"
TR = "'Ocak,Şubat,Mart,Nisan,Mayıs,Haziran,Temmuz,Ağustos,Eylül,Ekim,Kasım,Aralık'"
DE = "'Januar,Februar,März,April,Mai,Juni,Juli,August,September,Okt,Nov,Dezember'"
M1, Y1, M2, Y2 = "month(o_orderdate)", "cast(year(o_orderdate) AS STRING)", "month(o_orderdate) % 12 + 1", "cast(year(o_orderdate) + o_orderkey % 3 AS STRING)"
#: A span of time in one of many notations for each order; understood by Spark and DuckDB alike.
NOTATION = f"""CASE o_orderkey % 17
  WHEN 0 THEN split_part({EN}, ',', {M1}) || ' ' || {Y1} || ' - ' || split_part({EN}, ',', {M2}) || ' ' || {Y2}
  WHEN 1 THEN lpad(cast({M1} AS STRING), 2, '0') || '/' || {Y1} || ' – Present'
  WHEN 2 THEN {Y1} || ' to ' || {Y2}
  WHEN 3 THEN {Y1}
  WHEN 4 THEN split_part({DE}, ',', {M1}) || ' ' || {Y1} || ' bis heute'
  WHEN 5 THEN split_part({TR}, ',', {M1}) || ' ' || {Y1} || ' - devam ediyor'
  WHEN 6 THEN cast({M1} AS STRING) || '.' || {Y1} || '  —  ' || cast({M2} AS STRING) || '.' || {Y2}
  WHEN 7 THEN 'Since ' || split_part({EN}, ',', {M1}) || ' ' || {Y1}
  WHEN 8 THEN 'no date at all'
  WHEN 9 THEN ''
  WHEN 10 THEN NULL
  WHEN 11 THEN lpad(cast({M1} AS STRING), 2, '0') || '-' || {Y1}
  WHEN 12 THEN '• ' || {Y1} || ' — halen |'
  WHEN 13 THEN {Y1} || ' UNTIL now'
  WHEN 14 THEN split_part({DE}, ',', {M1}) || ' ' || {Y1} || ' bis ' || split_part({DE}, ',', {M2}) || ' ' || {Y2}
  WHEN 15 THEN split_part({TR}, ',', {M1}) || ' ' || {Y1} || ' – ' || split_part({TR}, ',', {M2}) || ' ' || {Y2}
  ELSE 'heute' END"""
LANGUAGE = "CASE WHEN o_orderkey % 17 IN (4, 14) THEN 'de' WHEN o_orderkey % 17 IN (5, 12, 15) THEN 'tr' WHEN o_orderkey % 5 = 0 THEN 'fr' ELSE 'en' END"
#: The month in which what still goes on ends here.
NOW = 1998 * 12 + 11


def _bare_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[•|]', ' ', 'g'), '\s+', ' ', 'g'), ' ,;:/')"


def _folded_sql(x: str) -> str:
    return f"trim(lower(translate(replace({x}, 'ß', 'ss'), 'şŞıİğĞüÜöÖçÇäÄ', 'ssiigguuooccaa')))"


def _fragment_sql(x: str) -> str:
    t = _bare_sql(x)
    month = lambda name: f"list_filter([{', '.join(f'{{k: {k!r}, v: {v}}}' for k, v in T.MONTHS[name].items())}], lambda m: list_contains(regexp_extract_all({_folded_sql(t)}, '\\w+'), m.k))[1].v"
    made = lambda y, m, p, c: f"{{y: {y}, m: {m}, p: {p}, c: {c}::DOUBLE}}"
    number = lambda pattern, group: f"nullif(regexp_extract({t}, '{pattern}', {group}), '')::INTEGER"
    year = number(r"(?:^|\D)(19\d{2}|20\d{2})(?:\D|$)", 1)
    named = f"CASE lang WHEN 'de' THEN {month('de')} WHEN 'tr' THEN {month('tr')} ELSE {month('en')} END"
    y, m = (number(r"(?:^|\D)(0?[1-9]|1[0-2])[./-](19\d{2}|20\d{2})(?:\D|$)", g) for g in (2, 1))
    return f"""CASE WHEN {x} IS NULL THEN NULL WHEN {_folded_sql(t)} IN ({", ".join(repr(p) for p in T.PRESENT)}) THEN {made("NULL::INTEGER", "NULL::INTEGER", "true", T.SURE_PRESENT)}
      WHEN {y} IS NOT NULL THEN {made(y, m, "false", T.SURE_NUMERIC)}
      WHEN {named} IS NOT NULL AND {year} IS NOT NULL THEN {made(year, named, "false", T.SURE_MONTH)}
      WHEN {year} IS NOT NULL THEN {made(year, "NULL::INTEGER", "false", T.SURE_YEAR)} END"""


RANGES_SQL = rf"""WITH n AS (SELECT o_orderkey, o_custkey, {NOTATION} AS text, {LANGUAGE} AS lang FROM orders),
  p AS (SELECT *, list_filter(list_transform(string_split_regex({_bare_sql("text")}, '(?i)\s*(?:-|–|—|to|until|through|bis)\s*'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM n),
  q AS (SELECT *, parts[1] AS a, parts[2] AS b FROM p),
  f AS (SELECT *, {_fragment_sql("a")} AS fa, {_fragment_sql("b")} AS fb, {_fragment_sql(_bare_sql("text"))} AS ft FROM q),
  r AS (SELECT o_orderkey, o_custkey, CASE WHEN fa IS NOT NULL AND fb IS NOT NULL THEN {{sy: fa.y, sm: fa.m, ey: fb.y, em: fb.m, p: fb.p, c: round((fa.c + fb.c) / 2, 4)}}
         WHEN ft IS NOT NULL THEN {{sy: ft.y, sm: ft.m, ey: NULL::INTEGER, em: NULL::INTEGER, p: ft.p, c: ft.c}} END AS r FROM f)"""


def _notations(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.expr(NOTATION).alias("text"), F.expr(LANGUAGE).alias("lang"))


@query("date_ranges", RANGES_SQL + "SELECT o_orderkey, r.sy AS start_year, r.sm AS start_month, r.ey AS end_year, r.em AS end_month, r.p AS present, r.c AS confidence FROM r")
def date_ranges(spark, d):
    """Every order's span of time, written in one of seventeen notations, read back."""
    return _notations(spark, d).select("o_orderkey", T.date_range(F.col("text"), F.col("lang")).alias("r")).select("o_orderkey", "r.*")


@query(
    "experience_months",
    RANGES_SQL
    + f""", i AS (SELECT o_custkey, r.sy * 12 + coalesce(r.sm, 1) - 1 AS a, CASE WHEN r.p THEN {NOW + 1} ELSE coalesce(r.ey * 12 + coalesce(r.em, 12), CASE WHEN r.sm IS NULL THEN r.sy * 12 + 12 ELSE r.sy * 12 + r.sm END) END AS z FROM r),
         g AS (SELECT * FROM i WHERE z > a),
         k AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY o_custkey ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM g),
         l AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM k),
         m AS (SELECT o_custkey, island, max(z) - min(a) AS months FROM l GROUP BY 1, 2)
       SELECT o_custkey, sum(months)::BIGINT AS months, count(*) AS spans FROM m GROUP BY 1""",
)
def experience_months(spark, d):
    """Months that a person's spans cover together, overlapping ones once."""
    read = _notations(spark, d).select("o_custkey", T.month_interval(T.date_range(F.col("text"), F.col("lang")), F.lit(NOW)).alias("i")).filter("i is not null").select("o_custkey", "i.first", "i.last")
    merged = A.merged_intervals(read, ["o_custkey"], "first", "last")
    return merged.groupBy("o_custkey").agg(F.sum(F.col("last") - F.col("first")).cast("long").alias("months"), F.count("*").alias("spans"))


@query("document_sections")
def document_sections(spark, d):
    """Sections of every whole document, by the names of its language; digests of their lines."""
    made = S.sections(table(spark, d, "documents"), "doc_id", "text", "lang")
    return made.select("doc_id", "place", "section", "heading", "confidence", F.size("lines").cast("long").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("lines_sha256"))


@query(
    "near_duplicate_hashes",
    f"""WITH h AS ({SIMHASH_SQL}), g AS (SELECT source, simhash, ('0x' || simhash)::UBIGINT AS v, count(*) AS documents, min(doc_id) AS first FROM documents JOIN h USING (doc_id) GROUP BY 1, 2)
       SELECT a.source, a.simhash AS left_hash, b.simhash AS right_hash, a.first AS left_doc, b.first AS right_doc, a.documents * b.documents AS document_pairs, bit_count(xor(a.v, b.v))::INTEGER AS distance
       FROM g a JOIN g b ON a.source = b.source AND a.simhash < b.simhash AND bit_count(xor(a.v, b.v)) <= 7""",
)
def near_duplicate_hashes(spark, d):
    """All pairs of different hashes of a source within seven bits, with the documents that each stands for."""
    docs = table(spark, d, "documents").filter(D.has_words(F.col("text")))
    hashed = docs.select("doc_id", "source").join(D.word_votes(docs, "doc_id", "text"), "doc_id")
    return D.near_pairs(hashed, "source", "doc_id", 7)
