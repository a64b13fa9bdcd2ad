"""What a draft would change in a profile: single values, lists and entries, each with an action.

A value fills a missing one (chosen unless refused) or asks for a review where both differ; lists and
entries only ever gain what they lack. Values are compared without case and outer white space.

Edge cases: values of white space alone are missing; null items of lists are passed over; lists that are null are
empty; of repeated items the first stays; an entry's missing text equals an empty one, its missing number another
missing number; of existing entries with equal keys the last by its order is the match; entries
without an owner are compared among themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import free
from tessera.functions.vocabulary import bound

# The actions.
NOOP, FILL_MISSING, REVIEW_REQUIRED, ADD_UNIQUE = "noop", "fill_missing", "review_required", "add_unique"


def cleaned(value: Column) -> Column:
    """The value without outer white space; null where nothing is left."""
    return F.nullif(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), F.lit(""))


def same_key(value: Column) -> Column:
    """What values are compared by."""
    return F.lower(F.replace(F.coalesce(cleaned(value), F.lit("")), F.lit("ß"), F.lit("ss")))


def value_plan(current: Column, suggested: Column) -> Column:
    """struct(current, suggested, action, chosen) of a single value."""
    now, new = cleaned(current), cleaned(suggested)
    action = F.when(new.isNull(), NOOP).when(now.isNull(), FILL_MISSING).when(same_key(now) == same_key(new), NOOP).otherwise(REVIEW_REQUIRED)
    return F.struct(now.alias("current"), new.alias("suggested"), action.alias("action"), (new.isNotNull() & now.isNull()).alias("chosen"))


def distinct_items(items: Column) -> Column:
    """The items without outer white space, empty and repeated ones, in their order."""
    some = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), cleaned), lambda x: x.isNotNull())
    both = F.struct(some.alias("items"), F.transform(some, same_key).alias("keys"))
    return bound(both, lambda b: F.filter(b["items"], lambda x, i: F.array_position(b["keys"], F.get(b["keys"], i)) == i + 1))


def list_plan(current: Column, suggested: Column) -> Column:
    """struct(current, suggested, to_add, action, chosen) of a list."""

    def lacking(b: Column) -> Column:
        keys = F.transform(b["current"], same_key)
        return F.struct(b["current"].alias("current"), b["suggested"].alias("suggested"), F.filter(b["suggested"], lambda x: ~F.array_contains(keys, same_key(x))).alias("to_add"))

    def told(b: Column) -> Column:
        some = F.size(b["to_add"]) > 0
        return F.struct(*[b[c].alias(c) for c in ("current", "suggested", "to_add")], F.when(some, ADD_UNIQUE).otherwise(NOOP).alias("action"), some.alias("chosen"))

    return bound(bound(F.struct(distinct_items(current).alias("current"), distinct_items(suggested).alias("suggested")), lacking), told)


def entry_plans(drafts: DataFrame, existing: DataFrame, owner: list[str], texts: list[str], numbers: list[str], identity: str, order: list[str]) -> DataFrame:
    """drafts with matched_existing_id, action and chosen: entries that an owner's existing ones lack are to be added.

    owner: columns that name the profile; texts, numbers: columns of both that an entry is compared by;
    identity: the existing entry's id; order: what makes one of equal existing entries the last.
    Drafts keep all their rows and columns. Existing entries are first taken together by key, so the join adds no rows.
    """
    have = [*drafts.columns, *existing.columns]
    k, n, last = free(have, "entry_key", "owner_key", "last_entry")
    numbered = lambda c: F.struct(F.col(c).isNull().alias("none"), F.coalesce(F.col(c).cast("long"), F.lit(0)).alias("number"))
    key = F.struct(*[same_key(F.col(c)) for c in texts], *[numbered(c) for c in numbers])
    named = F.struct(*owner)
    newest = F.max(F.struct(*order, F.col(identity).alias("entry_id"))).alias(last)
    had = existing.select("*", named.alias(n), key.alias(k)).groupBy(n, k).agg(newest)
    made = drafts.withColumn(n, named).withColumn(k, key).join(had, [n, k], "left")
    fresh = F.col(last).isNull()
    return made.select(*drafts.columns, F.col(last)["entry_id"].alias("matched_existing_id"), F.when(fresh, ADD_UNIQUE).otherwise(NOOP).alias("action"), fresh.alias("chosen"))
