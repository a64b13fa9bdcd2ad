"""Names for helper columns that no table can clash with."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(df: DataFrame | list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it none of df's columns, case apart."""
    have, out = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out
