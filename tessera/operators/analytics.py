"""Filters, pages, summaries, latest rows, funnels and histograms over operational tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_all(df: DataFrame, equal: dict | None = None, search: str | None = None, search_in: Sequence[str] = (), since: tuple | None = None, between: dict | None = None, within: dict | None = None) -> DataFrame:
    """Rows that meet every given condition; a condition that is None or an empty list is left out.

    search: case-blind text over several columns, in which % and _ keep their meaning of patterns.
    """
    out = df
    for name, value in (equal or {}).items():
        if value is not None:
            out = out.filter(F.col(name) == F.lit(value))
    if search:
        pattern = "%" + search.replace("\\", "\\\\") + "%"
        hit = F.lit(False)
        for c in search_in:
            hit = hit | F.coalesce(F.col(c).cast("string"), F.lit("")).ilike(pattern)
        out = out.filter(hit)
    if since:
        out = out.filter(F.col(since[0]) >= F.lit(since[1]))
    for name, (low, high) in (between or {}).items():
        if low is not None:
            out = out.filter(F.col(name) >= F.lit(low))
        if high is not None:
            out = out.filter(F.col(name) <= F.lit(high))
    for name, values in (within or {}).items():
        if values:
            out = out.filter(F.col(name).isin(list(values)))
    return out


def page_bounds(page, size, default_size: int = 25, max_size: int = 100, max_page: int = 1000) -> tuple[int, int]:
    """(limit, offset) of a page; bad numbers become the defaults, large ones the limits."""

    def number(value, default):
        try:
            return int(value)
        except (TypeError, ValueError):
            return default

    p, s = min(max(number(page, 1), 1), max_page), number(size, default_size)
    s = min(s, max_size) if s > 0 else default_size
    return s, (p - 1) * s


def page(df: DataFrame, order: Sequence[Column], number=1, size=25, **limits) -> DataFrame:
    """One page of the ordered rows."""
    limit, offset = page_bounds(number, size, **limits)
    return df.orderBy(*order).offset(offset).limit(limit)


def keyword_matches(df: DataFrame, fields: Sequence[str], words: Sequence[str]) -> Column:
    """array<struct<field, keyword, value>> of key words found in fields, case-blind, fields first."""
    clean = list(dict.fromkeys(w.strip().casefold() for w in words if w.strip()))
    hits = [F.when(F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(w)), F.struct(F.lit(f).alias("field"), F.lit(w).alias("keyword"), F.col(f).alias("value"))) for f in fields for w in clean]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<struct<field:string,keyword:string,value:string>>")


def keyword_pass(df: DataFrame, fields: Sequence[str], include: Sequence[str], exclude: Sequence[str]) -> Column:
    """True when a key word to include is found, or none is asked for, and no key word to exclude is."""
    wanted = F.lit(True) if not [w for w in include if w.strip()] else F.size(keyword_matches(df, fields, include)) > 0
    return wanted & (F.size(keyword_matches(df, fields, exclude)) == 0)


def activity(df: DataFrame, active: Column, by: Sequence[Column] = ()) -> DataFrame:
    """Total, active and inactive rows, for each group of by or overall."""
    on = F.coalesce(active, F.lit(False)).cast("long")
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.coalesce(F.sum(on), F.lit(0)).alias("active"), F.coalesce(F.sum(1 - on), F.lit(0)).alias("inactive"))


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_place = 1").drop("_place")


def shares(df: DataFrame, by: Column, name: str, value: Column) -> DataFrame:
    """(name, items, share in percent, mean value) of each group; the total runs over the groups, not the rows."""
    grouped = df.groupBy(by.alias(name)).agg(F.count("*").alias("items"), F.avg(value).alias("mean"))
    return grouped.withColumn("share", F.col("items") * 100.0 / F.sum("items").over(Window.partitionBy(F.lit(1))))


def bands(value: Column, edges: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first band whose lower edge value reaches; edges from the highest down."""
    label = F.lit(otherwise)
    for low, name in reversed(edges):
        label = F.when(value >= low, name).otherwise(label)
    return label


def recent_days(df: DataFrame, ts: Column, days: int = 7) -> DataFrame:
    """(place, day, items) of the last days that have rows, oldest first, zeros before them where there are fewer."""
    counted = df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("items")).orderBy(F.desc("day")).limit(days)
    placed = counted.withColumn("place", days - F.row_number().over(Window.orderBy(F.desc("day"))) + 1)  # at most `days` rows
    every = df.sparkSession.range(1, days + 1).select(F.col("id").cast("int").alias("place"))
    return every.join(placed, "place", "left").select("place", "day", F.coalesce("items", F.lit(0)).alias("items"))


def merged_intervals(df: DataFrame, key: Sequence[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of each key taken together: (key, start, end)."""
    order = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("_island", island).groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def diversified(df: DataFrame, source: str, order: Sequence[Column]) -> DataFrame:
    """Place of each row when the best row of every source comes first, then the others, each in order."""
    first = F.when(F.row_number().over(Window.partitionBy(source).orderBy(*order)) == 1, 0).otherwise(1)
    return df.withColumn("deferred", first)


def diversified_places(df: DataFrame, source: str, order: Sequence[Column], parts: int = 64) -> DataFrame:
    """All rows with their place when the best row of every source comes first, then the others, each in order.

    order: columns from the lowest up, nulls last, the last of them unique. Rows are dealt to ranges by
    borders from a sample, numbered inside each range, and moved on by the sizes of the ranges before, so
    that no task orders the whole table; the borders change the work, not the places.
    """
    rank = lambda first: F.struct(first.alias("deferred"), *[x for i, c in enumerate(order) for x in (c.isNull().alias(f"n{i}"), c.alias(f"v{i}"))])
    best = df.groupBy(F.col(source).alias("_source")).agg(F.min(rank(F.lit(0))).alias("_best"))
    joined = df.join(best, F.col(source).eqNullSafe(F.col("_source")))
    ranked = joined.withColumn("_rank", rank(F.when(rank(F.lit(0)) == F.col("_best"), 0).otherwise(1))).drop("_source", "_best")
    keys = ranked.select("_rank")
    sample = keys.sample(min(1.0, 100.0 * parts / max(1, df.count())), 1).distinct().orderBy("_rank")
    found = sample.collect()
    picked = sorted({len(found) * k // parts for k in range(1, parts)}) if found else []
    if not picked:
        return ranked.withColumn("place", F.row_number().over(Window.orderBy("_rank")).cast("long")).drop("_rank")
    borders = df.sparkSession.createDataFrame([([found[i]["_rank"] for i in picked],)], f"_borders array<{keys.schema['_rank'].dataType.simpleString()}>")
    placed = ranked.crossJoin(F.broadcast(borders)).withColumn("_part", F.size(F.filter("_borders", lambda b: b <= F.col("_rank")))).drop("_borders")
    sizes = {r[0]: r[1] for r in placed.groupBy("_part").agg(F.count("*")).collect()}
    base, before = [], 0
    for k in range(len(picked) + 1):
        base.append(F.lit(before).cast("long"))
        before += sizes.get(k, 0)
    start = F.element_at(F.array(*base), F.col("_part") + 1)
    return placed.withColumn("place", start + F.row_number().over(Window.partitionBy("_part").orderBy("_rank"))).drop("_part", "_rank")
