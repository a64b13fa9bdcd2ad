"""Logs of changes: appending, values at a time, reverting and finalising, masks of fields, lifecycles, stale sources.

A log has a row for each change of a field: its key, the field, the values before and after, and an order in
which changes came. No step orders the changes of a key in one task: all are aggregates that combine before
they shuffle, so a key with most of the changes is no harder than others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import free

# Scores of what became of a change.
SCORES = {"accepted": 1.0, "modified": 0.65, "rejected": 0.0, "reverted": 0.25}


def changed_fields(old: DataFrame, new: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(key, field, before, after): what a log is appended with: each field, as text, that differs by key in both tables.

    Keys of one table alone have null on the other side; equal values, nulls included, give no row.
    """
    both = old.alias("o").join(new.alias("n"), list(key), "full_outer")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("string").alias("before"), F.col(f"n.{f}").cast("string").alias("after")) for f in fields])
    return both.select(*key, F.explode(pairs).alias("change")).filter("not (change.before <=> change.after)").select(*key, "change.*")


def values_at(log: DataFrame, key: Sequence[str], order: Sequence[str], at: Column) -> DataFrame:
    """(key, value): a key's value at a time: after its last change before then, else before its first change since.

    at: a boolean column of the log, true for changes made by then. key has the field among its columns. Of
    changes with equal order the greater value counts, so that reruns agree.
    """
    last, first, met = free(log, "last", "first", "met")
    when = F.struct(*order)
    # The value stands in a struct, as max_by and min_by would pass over keys whose value is null.
    picked = log.groupBy(*key).agg(
        F.max_by(F.struct(F.col("after").alias("v")), F.when(at, F.struct(when.alias("o"), F.col("after").alias("v")))).alias(last),
        F.min_by(F.struct(F.col("before").alias("v")), F.when(~at, F.struct(when.alias("o"), F.col("before").alias("v")))).alias(first),
        F.max(F.when(at, True)).alias(met),
    )
    return picked.select(*key, F.when(F.col(met), F.col(f"{last}.v")).otherwise(F.col(f"{first}.v")).alias("value"))


def reverted(current: DataFrame, log: DataFrame, key: Sequence[str], value: str, order: Sequence[str], chosen: Column, fields: Sequence[str] | None = None) -> DataFrame:
    """current with the value from before the chosen changes, and ``reverts``, their number.

    Chosen changes of a key are reverted in their order, so the last one's value before stays. With fields,
    changes of other fields cannot be reverted and leave their values alone.
    """
    reverts, back = free(current, "reverts", "back")
    able = chosen if fields is None else chosen & F.col("field").isin(list(fields))
    undone = log.filter(able).groupBy(*key).agg(F.max_by(F.struct(F.col("before").alias("v")), F.struct(F.struct(*order), "before")).alias(back), F.count("*").alias(reverts))
    joined = current.join(undone, list(key), "left")
    changed = F.when(F.col(reverts).isNotNull(), F.col(f"{back}.v")).otherwise(F.col(value))
    return joined.select(*[changed.alias(c) if c == value else F.col(c) for c in current.columns], F.coalesce(reverts, F.lit(0).cast("long")).alias("reverts"))


def log_after_revert(log: DataFrame, chosen: Column, at: Column) -> DataFrame:
    """The log with the chosen changes marked as reverted; columns that it lacks are added."""
    marks = {"persistence_status": F.lit("reverted"), "evaluation_status": F.lit("reverted"), "evaluation_score": F.lit(SCORES["reverted"]), "reverted_at": at}
    old = {c: F.col(c) if c in log.columns else F.lit(None) for c in marks}
    return log.withColumns({c: F.when(chosen, new).otherwise(old[c]) for c, new in marks.items()})


def edit_distance(before: Column, after: Column) -> Column:
    """Characters of the longer text that matched blocks of both do not cover; nulls count as JSON's null."""

    def one(a: str | None, b: str | None) -> int:
        a, b = ("null" if t is None else t for t in (a, b))
        return 0 if a == b else round(max(len(a), len(b), 1) * (1 - SequenceMatcher(a=a, b=b).ratio()))

    @F.pandas_udf("int")
    def each(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(left, right)], dtype="int32")

    return each(before, after)


def quoted(value: Column) -> Column:
    """A text without spaces around it, as JSON; null for null."""
    bare = F.regexp_replace(value, r"^\s+|\s+$", "")
    inner = F.to_json(F.struct(bare.alias("v")))
    return F.when(value.isNotNull(), F.substr(inner, F.lit(6), F.length(inner) - 6))


def finalised(offered: Column, saved: Column) -> Column:
    """struct(evaluation_status, evaluation_score, saved_snapshot): whether a text was saved as it was offered."""
    same = quoted(offered).eqNullSafe(quoted(saved))
    status = F.when(same, "accepted").otherwise("modified")
    return F.struct(status.alias("evaluation_status"), F.when(same, SCORES["accepted"]).otherwise(SCORES["modified"]).alias("evaluation_score"), F.coalesce(quoted(saved), F.lit("null")).alias("saved_snapshot"))


def masked_update(table: DataFrame, patches: DataFrame, key: Sequence[str], fields: str, allowed: Sequence[str]) -> DataFrame:
    """table with the fields that a patch names, null values included; the others stay.

    patches: one row for each key with a map of texts in the column ``fields``. A patch that names a field
    which is not allowed, or none, changes nothing; ``refused_patches`` gives those and patches of no row.
    """
    (patch,) = free(table, "patch")
    good = patches.filter(_fit(fields, allowed)).select(*key, F.col(fields).alias(patch))
    joined = table.join(good, list(key), "left")
    named = lambda c: F.coalesce(F.map_contains_key(patch, F.lit(c)), F.lit(False))
    types = dict(table.dtypes)
    return joined.select(*[F.when(named(c), F.col(patch)[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in allowed else F.col(c) for c in table.columns])


def refused_patches(table: DataFrame, patches: DataFrame, key: Sequence[str], fields: str, allowed: Sequence[str]) -> DataFrame:
    """(key, reason, unknown): patches without fields, with unknown ones, or of no row."""
    (there,) = free(patches, "there")
    known = patches.join(table.select(*key).distinct().withColumn(there, F.lit(True)), list(key), "left")
    unknown = F.array_sort(F.array_except(F.map_keys(F.col(fields)), F.array(*[F.lit(c).cast("string") for c in allowed])))
    empty = F.col(fields).isNull() | (F.size(fields) == 0)
    reason = F.when(empty, "no_fields").when(F.size(unknown) > 0, "unknown_fields").when(F.col(there).isNull(), "no_row")
    return known.select(*key, reason.alias("reason"), F.array_join(unknown, ", ").alias("unknown")).filter("reason is not null")


def _fit(fields: str, allowed: Sequence[str]) -> Column:
    return F.coalesce((F.size(fields) > 0) & (F.size(F.array_except(F.map_keys(F.col(fields)), F.array(*[F.lit(c).cast("string") for c in allowed]))) == 0), F.lit(False))


def lifecycle(table: DataFrame, changes: DataFrame, key: Sequence[str], taken: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """table with the columns of a change: those taken as they are, nulls too; those kept only where the change knows them.

    changes: at most one row for each key; keys that the table has not are left out.
    """
    (mark,) = free([*table.columns, *changes.columns], "changed")
    joined = table.alias("t").join(changes.select(*key, *taken, *kept).withColumn(mark, F.lit(True)).alias("c"), list(key), "left")
    pick: Mapping[str, Column] = {
        **{c: F.when(F.col(mark), F.col(f"c.{c}")).otherwise(F.col(f"t.{c}")) for c in taken},
        **{c: F.coalesce(f"c.{c}", f"t.{c}") for c in kept},
    }
    return joined.select(*[pick[c].alias(c) if c in pick else (F.col(c) if c in key else F.col(f"t.{c}")) for c in table.columns])


def latest_lines(log: DataFrame, key: Sequence[str], order: Sequence[Column], line: Column, most: int, heading: str) -> DataFrame:
    """(key, body): a document for each key: a heading and the lines of its latest changes, at most so many.

    The limit is applied before rows are shuffled, and again after; a document holds no more than its lines.
    """
    place, text = free(log, "place", "line")
    ranked = log.withColumn(text, line).withColumn(place, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(place) <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(place, text))), lambda x: x[text])
    return ranked.groupBy(*key).agg(F.concat_ws("\n", F.lit(heading), lines).alias("body"))


def stale_marks(stored: DataFrame, rendered: DataFrame, key: Sequence[str], body: str) -> DataFrame:
    """(key, status): ready where the rendered document is the stored one, stale where it differs or is gone, pending where it is new.

    stored: (key, checksum); rendered: (key, body). An empty body counts as none.
    """
    (now,) = free(stored, "now")
    sums = rendered.filter(F.trim(F.coalesce(F.col(body), F.lit(""))) != "").select(*key, F.sha2(body, 256).alias(now))
    both = stored.select(*key, "checksum").join(sums, list(key), "full_outer")
    return both.select(*key, F.when(F.col("checksum").isNull(), "pending").when(F.col(now) == F.col("checksum"), "ready").otherwise("stale").alias("status"))


def marked_children(children: DataFrame, marks: DataFrame, key: Sequence[str], status: str = "status") -> DataFrame:
    """Chunks or vectors with the status that is carried to them: stale where their source is, else their own."""
    (above,) = free(children, "above")
    joined = children.join(marks.filter("status = 'stale'").select(*key, F.col("status").alias(above)), list(key), "left")
    return joined.withColumn(status, F.coalesce(F.col(above), F.col(status) if status in children.columns else F.lit("ready"))).drop(above)
