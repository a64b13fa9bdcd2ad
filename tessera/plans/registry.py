"""All registered queries over the driver's tables, with the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import apply_plan, audit, canonical, entries, layouts, matching, operational, pages, redaction, retrieval, skills, texts, workflow  # noqa: F401  each registers its queries
from tessera.plans.base import ENTRIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in ENTRIES.items() if s}
