"""Columns of a page and the order in which its blocks are read.

A block is a rectangle with a text. Blocks of a page are dealt to at most three columns: in the order of
their centres, a block joins the last column where its centre lies within a gap of the column's mean
centre, and begins a column otherwise. Wide blocks are read first, then the columns from the left, then
narrow columns (sidebars); where all columns are narrow, all are main ones.

Only the running mean is an ordered fold, over a page's centres alone; the rest are windows over the page,
all on one shuffle. A page is taken together, so it must fit in a task, as one of paper does.

Edge cases: blocks without a place (a null coordinate) count as at zero; a page without a width counts as one
unit wide; pages without blocks have no rows; repeated blocks stay, in the order of their texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import free

# Shares of the page's width for wide blocks, sidebars and gaps, the least gap, the most columns.
WIDE, SIDEBAR, GAP, LEAST_GAP, MOST = 0.68, 0.35, 0.14, 36.0, 3


def _deal(centres: np.ndarray | None, gap: float, most: int) -> list[int]:
    column, total, n, out = -1, 0.0, 0, []
    for x in () if centres is None else centres:
        if column < 0 or (abs(x - total / n) > gap and column + 1 < most):
            column, total, n = column + 1, 0.0, 0
        total, n = total + x, n + 1
        out.append(column)
    return out


def dealt(centres: Column, gap: Column, most: int = MOST) -> Column:
    """array<int>: the column of each of a page's centres, which are in ascending order."""

    @F.pandas_udf("array<int>")
    def fold(every: pd.Series, gaps: pd.Series) -> pd.Series:
        return pd.Series([_deal(c, g, most) for c, g in zip(every, gaps, strict=True)], dtype=object)

    return fold(centres, gap)


def reading_order(blocks: DataFrame, keys: list[str], width: str, box: tuple[str, str, str, str], number: str, text: str) -> DataFrame:
    """(keys, number, text, column, sidebar, wide, columns, place): every block with its column and its place on its page.

    keys: columns that name a page; width: its width; box: x0, y0, x1, y1 of a block; number: the block's
    number on the page. column and place count from 0.
    """
    x0, y0, x1, y1 = box
    k, b, w, c = free(keys + [number, text], "page_keys", "block", "page_width", "cluster")
    at = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    rows = blocks.select(
        F.struct(*keys).alias(k),
        F.coalesce(F.col(width).cast("double"), F.lit(0.0)).alias(w),
        F.struct(((at(x0) + at(x1)) / 2).alias("centre"), at(y0).alias("y0"), F.col(number).alias("number"), at(x0).alias("x0"), at(x1).alias("x1"), F.col(text).alias("text")).alias(b),
    )
    pages = rows.groupBy(k).agg(F.max(w).alias(w), F.sort_array(F.collect_list(b)).alias(b))
    gap = F.greatest(F.col(w) * GAP, F.lit(LEAST_GAP))
    pages = pages.withColumn(c, dealt(F.transform(b, lambda x: x["centre"]), gap))
    own = pages.select(k, F.greatest(F.col(w), F.lit(1.0)).alias(w), F.explode(F.arrays_zip(F.col(b).alias("b"), F.col(c).alias("c"))).alias("z")).select(k, w, "z.b.*", F.col("z.c").alias("c"))
    page, column = Window.partitionBy(k), Window.partitionBy(k, "c")
    own = own.withColumn("left", F.min("x0").over(column)).withColumn("narrow", (F.greatest(F.max("x1").over(column) - F.col("left"), F.lit(0.0)) / F.col(w)) <= SIDEBAR)
    own = own.withColumn("column", F.dense_rank().over(page.orderBy("left", "c")) - 1).withColumn("all_narrow", F.min("narrow").over(page)).withColumn("columns", F.max("c").over(page) + 1)
    own = own.withColumn("wide", (F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0)) / F.col(w)) >= WIDE)
    part = F.when(F.col("wide"), -1).otherwise(F.col("column") + F.when(F.col("narrow") & ~F.col("all_narrow"), MOST).otherwise(0))
    place = F.row_number().over(page.orderBy("part", "y0", "x0", "number", "centre", "text")) - 1
    return own.withColumn("part", part).withColumn("place", place).select(
        f"{k}.*", F.col("number").alias(number), F.col("text").alias(text), "column", F.col("narrow").alias("sidebar"), "wide", "columns", "place"
    )


def reading_text(ordered: DataFrame, document: list[str], page: str, text: str) -> DataFrame:
    """(document, text, pages, columns): each document's texts in reading order, empty ones left out, and whether a page has columns.

    ordered: rows of ``reading_order``; page: the column that orders a document's pages.
    """
    own = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    kept = F.when(own != "", F.struct(F.col(page).alias("page"), "place", own.alias("text")))
    made = ordered.groupBy(*document).agg(F.sort_array(F.collect_list(kept)).alias("t"), F.count_distinct(page).alias("pages"), F.max(F.col("columns") > 1).alias("multi_column"))
    return made.select(*document, F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias(text), "pages", "multi_column")
