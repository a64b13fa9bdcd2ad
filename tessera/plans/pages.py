"""Reading order of pages: an order is a page, its line items are the blocks; eight orders make a document."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import layout as L
from tessera.plans.base import query, table

PAGE_WIDTH = 600
#: Blocks on both engines: wide ones, narrow ones on either side, and main ones.
BLOCKS = {
    "doc": "CAST(floor(l_orderkey / 8) AS BIGINT)",
    "page": "l_orderkey % 8",
    "block": "l_partkey * 10 + l_linenumber",
    "x0": "CASE (l_partkey + l_suppkey) % 5 WHEN 0 THEN 20 WHEN 1 THEN 20 + l_partkey % 30 WHEN 2 THEN 210 WHEN 3 THEN 200 + l_partkey % 40 ELSE 420 + l_suppkey % 20 END",
    "w": "CASE (l_partkey + l_suppkey) % 5 WHEN 0 THEN CASE WHEN l_partkey % 2 = 0 THEN 540 ELSE 130 END WHEN 1 THEN 120 WHEN 2 THEN 340 WHEN 3 THEN 150 + l_partkey % 90 ELSE 130 END",
    "y0": "(l_partkey * 7 + l_suppkey) % 700",
    "words": "CASE WHEN l_partkey % 23 = 0 THEN ' ' ELSE ' ' || l_returnflag || ' item ' || CAST(l_partkey AS STRING) END",
}
BLOCKS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in BLOCKS.items()) + " FROM lineitem"
ORDER_SQL = f"""b AS (SELECT doc, page, block, words, x0::DOUBLE AS x0, (x0 + w)::DOUBLE AS x1, y0::DOUBLE AS y0, (x0 + x0 + w)::DOUBLE / 2 AS centre FROM ({BLOCKS_SQL})),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY centre, y0, block, x0, x1, words) AS n FROM b),
  f AS (SELECT doc, page, n, 0 AS c, centre AS total, 1 AS size FROM n WHERE n = 1
    UNION ALL SELECT n.doc, n.page, n.n, CASE WHEN abs(n.centre - f.total / f.size) > {max(PAGE_WIDTH * L.GAP, L.LEAST_GAP)} AND f.c < {L.MOST - 1} THEN f.c + 1 ELSE f.c END,
      CASE WHEN abs(n.centre - f.total / f.size) > {max(PAGE_WIDTH * L.GAP, L.LEAST_GAP)} AND f.c < {L.MOST - 1} THEN n.centre ELSE f.total + n.centre END,
      CASE WHEN abs(n.centre - f.total / f.size) > {max(PAGE_WIDTH * L.GAP, L.LEAST_GAP)} AND f.c < {L.MOST - 1} THEN 1 ELSE f.size + 1 END
    FROM f JOIN n ON n.doc = f.doc AND n.page = f.page AND n.n = f.n + 1),
  c AS (SELECT doc, page, c, min(x0) AS lft, (max(x1) - min(x0)) / {PAGE_WIDTH} <= {L.SIDEBAR} AS sidebar FROM f JOIN n USING (doc, page, n) GROUP BY 1, 2, 3),
  d AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY lft, c) - 1 AS col, bool_and(sidebar) OVER (PARTITION BY doc, page) AS every, count(*) OVER (PARTITION BY doc, page) AS cols FROM c),
  o AS (SELECT n.doc, n.page, block, words, col, sidebar, (x1 - x0) / {PAGE_WIDTH} >= {L.WIDE} AS wide, cols, row_number() OVER (PARTITION BY n.doc, n.page ORDER BY
      CASE WHEN (x1 - x0) / {PAGE_WIDTH} >= {L.WIDE} THEN -1 ELSE col + CASE WHEN sidebar AND NOT every THEN {L.MOST} ELSE 0 END END, y0, x0, block, centre, words) - 1 AS place
    FROM f JOIN n USING (doc, page, n) JOIN d USING (doc, page, c))"""


def _ordered(spark, d):
    blocks = table(spark, d, "lineitem").select(*[F.expr(e).alias(n) for n, e in BLOCKS.items()], F.lit(PAGE_WIDTH).alias("width"))
    return L.reading_order(blocks.withColumn("x1", F.expr("x0 + w")).withColumn("y1", F.expr("y0 + 20")), ["doc", "page"], "width", ("x0", "y0", "x1", "y1"), "block", "words")


@query("page_columns", f'WITH RECURSIVE {ORDER_SQL} SELECT doc, page, block, words, col::INTEGER AS "column", sidebar, wide, cols::INTEGER AS columns, place::INTEGER AS place FROM o')
def page_columns(spark, d):
    """Every block's column and its place in the reading order of its page."""
    return _ordered(spark, d)


@query(
    "reading_texts",
    f"""WITH RECURSIVE {ORDER_SQL} SELECT doc, coalesce(string_agg(trim(words), chr(10) || chr(10) ORDER BY page, place) FILTER (WHERE trim(words) <> ''), '') AS words,
      count(DISTINCT page) AS pages, bool_or(cols > 1) AS multi_column FROM o GROUP BY doc""",
)
def reading_texts(spark, d):
    """Every document's text in reading order."""
    return L.reading_text(_ordered(spark, d), ["doc"], "page", "words")
