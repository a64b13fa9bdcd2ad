"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key to four tasks for each core, for rows that are small to read and cost much.

    A table of many rows can be a file of a few MB, which Spark reads in one or two tasks whatever the cores.
    """
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, key)


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its DuckDB SQL where there is one."""

    def keep(f):
        ENTRIES[name] = (f, sql)
        return f

    return keep
