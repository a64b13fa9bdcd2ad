"""Changes to tables kept as Parquet: upserts, change detection, tombstones and pruning by joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_of_batch(batch: DataFrame, key: Sequence[str], arrival: str) -> DataFrame:
    """One row for each key: the values that came last, with the place at which the key came first."""
    by = Window.partitionBy(*key)
    placed = batch.withColumn("_first", F.min(arrival).over(by)).withColumn("_last", F.row_number().over(by.orderBy(F.desc(arrival))))
    return placed.filter("_last = 1").withColumn(arrival, F.col("_first")).drop("_first", "_last")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of both tables by key; the new values win, but for the columns to keep where an old row has them."""
    marked = old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), list(key), "full_outer")
    picked = []
    for c in old.columns:
        if c in key:
            picked.append(F.col(c))
        elif c in keep or c not in new.columns:
            other = F.col(f"n.{c}") if c in new.columns else F.lit(None)
            picked.append(F.coalesce(F.col(f"o.{c}"), other).alias(c))
        else:
            picked.append(F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return marked.select(*picked)


def changes(old: DataFrame, new: DataFrame, key: Sequence[str], compared: Sequence[str], active: str) -> DataFrame:
    """(key, change): inserted, reactivated, updated, unchanged, or deactivated for active rows that are not among the new."""
    o = old.select(*key, *[F.col(c).alias(f"_o_{c}") for c in (*compared, active)]).withColumn("_old", F.lit(True))
    n = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in compared]).withColumn("_new", F.lit(True))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}"))
    was = F.coalesce(F.col(f"_o_{active}").cast("boolean"), F.lit(False))
    change = (
        F.when(F.col("_old").isNull(), "inserted")
        .when(F.col("_new").isNull() & was, "deactivated")
        .when(F.col("_new").isNull(), "gone")
        .when(~was, "reactivated")
        .when(same, "unchanged")
        .otherwise("updated")
    )
    return o.join(n, list(key), "full_outer").select(*key, change.alias("change"))


def tombstone(table: DataFrame, seen: DataFrame, key: Sequence[str], active: str) -> DataFrame:
    """Rows that were not seen become inactive; when nothing was seen, all do."""
    marks = seen.select(*key).distinct().withColumn("_seen", F.lit(True))
    return table.join(marks, list(key), "left").withColumn(active, F.coalesce(F.col("_seen"), F.lit(False)) & F.col(active)).drop("_seen")


def replace_children(table: DataFrame, parents: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The children of some parents give way to new rows."""
    return table.join(parents.select(*key).distinct(), list(key), "left_anti").unionByName(rows)


def prune(children: DataFrame, parents: DataFrame, key: Sequence[str]) -> DataFrame:
    """Children whose parent exists."""
    return children.join(parents.select(*key), list(key), "left_semi")


def reinforce(memory: DataFrame, seen: DataFrame, key: Sequence[str]) -> DataFrame:
    """Memories with the highest confidence so far and the number of times they were met."""
    once = seen.select(*key, "confidence", "seen_at").withColumn("times", F.lit(1).cast("long"))
    both = memory.select(*key, "confidence", "seen_at", "times").unionByName(once)
    return both.groupBy(*key).agg(F.max("confidence").alias("confidence"), F.max("seen_at").alias("seen_at"), F.sum("times").alias("times"))
