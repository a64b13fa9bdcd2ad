"""Duplicate postings taken together, and what readers did with postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import affinity, fold, normalize_url

# Confidence by the reason for which records were merged.
CONFIDENCE = {"exact_apply_url_and_title": 0.99, "exact_apply_url": 0.97, "normalized_company_title_location": 0.94, "title_company_cluster": 0.88, "single_source_record": 0.9}


def group_trust(trust: Column, kind: Column, url: Column) -> Column:
    """Aggregate: the best source's trust, more for several kinds of sources and for one link in all of several records."""
    several = F.least(F.lit(0.02), 0.01 * (F.count_distinct(kind) - 1))
    agreed = F.when((F.count("*") > 1) & (F.count_distinct(url) == 1), 0.01).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.round(F.max(trust), 4) + F.greatest(F.lit(0.0), several) + agreed), 4)


def all_equal(value: Column) -> Column:
    """Aggregate: whether all values that are not null are one; false where there is none."""
    return F.coalesce(F.min(value) == F.max(value), F.lit(False))


def merge_reason(members: Column, one_url: Column, one_title: Column, one_company: Column, one_location: Column) -> Column:
    """From the number of members and from what is the same in all of them."""
    return (
        F.when(members == 1, "single_source_record")
        .when(one_url & one_title, "exact_apply_url_and_title")
        .when(one_url, "exact_apply_url")
        .when(one_company & one_title & one_location, "normalized_company_title_location")
        .otherwise("title_company_cluster")
    )


def link_confidence(reason: Column, members: Column) -> Column:
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])[reason], F.lit(0.85))
    return F.round(F.least(F.lit(0.995), base + F.when(members >= 3, 0.01).otherwise(0.0)), 4)


def resolve(records: DataFrame, order: Sequence[Column]) -> DataFrame:
    """One row for each key: its primary record, members, why they were merged, and how sure that is.

    records: key, record, company, title, location, url. order: values of which the greatest, first by first,
    make the primary record; the last of them should be unique. One aggregate without windows or distinct
    counts: groups are reduced on the map side, none is ever collected.
    """
    link = normalize_url(F.col("url"))
    best = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    named = records.groupBy("key").agg(
        F.max_by("record", best).alias("primary_record"),
        F.count("*").alias("members"),
        merge_reason(F.count("*"), all_equal(F.when(link != "", link)), *[all_equal(fold(F.col(c))) for c in ("title", "company", "location")]).alias("merge_reason"),
    )
    return named.withColumn("confidence", link_confidence(F.col("merge_reason"), F.col("members")))


def interaction_counts(events: DataFrame, key: Sequence[str] = ("user_id",)) -> DataFrame:
    """Counters of supported events for each key; others are left out. Works on streams as on tables."""
    kind = F.col("event_type")
    dwell = F.when(kind == "click", F.floor("value"))
    named = (("impressions", "view"), ("opens", "click"), ("saves", "signup"), ("applies", "purchase"))
    sums = [F.count(F.when(kind == e, 1)).alias(n) for n, e in named]
    return events.filter(kind.isin([e for _, e in named])).groupBy(*key).agg(*sums, F.coalesce(F.sum(dwell), F.lit(0)).alias("dwell"), F.coalesce(F.max(dwell), F.lit(0)).alias("longest"))


def scored(counts: DataFrame) -> DataFrame:
    return counts.withColumn("affinity", affinity(*[F.col(c) for c in ("impressions", "opens", "saves", "applies", "dwell")]))


def interactions(events: DataFrame, key: Sequence[str] = ("user_id",)) -> DataFrame:
    return scored(interaction_counts(events, key))
