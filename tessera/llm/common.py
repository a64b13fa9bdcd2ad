"""Helpers that the operators of this subpackage share: shared storage, checkpoints, word rules."""

from __future__ import annotations

import ctypes
import gc
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every operator of this subpackage.
SPACE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Spark's setting by which the shuffle files of a query go when it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir of the session, else the warehouse on one machine.

    On a cluster the setting is needed: no folder of one machine would do.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where and sc.master.startswith("local"):
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    if not where:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage; survives lost executors.

    The shuffle files of its plan serve nothing once it is written: Spark removes them at the end of the action
    instead of when the driver happens to collect garbage. The setting counts when a plan is built, so df is
    selected anew under it.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(RELEASE, before)


def give_back() -> None:
    """Return memory that a Python process, the driver's or a worker, has freed to the system, where the C library offers it.

    The arrays of a fit, or the texts of a batch, are freed in many small pieces, which would otherwise stay with the process through all later stages.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it none of df's columns."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        out.append(n)
    return out


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; nothing is created."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def most_frequent(counted: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the highest counts, at most so many: those above a cut that a coarse histogram of the counts gives.

    No task sorts or gathers more than its own rows, whatever the number of partitions.
    """
    level = F.floor(F.log(F.col(count)) / math.log(1.05)).cast("int")
    held = {r[0]: r[1] for r in counted.filter(F.col(count) > 0).groupBy(level.alias("level")).agg(F.count("*")).collect()}  # under a thousand levels
    cut, kept = None, 0
    for k in sorted(held, reverse=True):
        if kept + held[k] > most:
            break
        cut, kept = k, kept + held[k]
    return counted.filter(F.lit(False)) if cut is None else counted.filter((F.col(count) > 0) & (level >= cut))


def hashed_sample(rows: DataFrame, most: int) -> DataFrame:
    """At most so many distinct rows, those whose hashes are lowest; rows: columns with a hash, of one type each.

    A threshold on the hash, from one count, leaves a few times ``most`` rows before anything is compared, and
    equal rows are taken together where they lie, so neither partitions nor copies make the last step grow.
    """
    (h,) = free_names(rows, "sample_hash")
    total = rows.count()
    kept = rows.withColumn(h, F.xxhash64(*rows.columns))
    if total > 4 * most:
        # As many again as are wanted: copies count for one, so more than a half may be such.
        kept = kept.filter(F.pmod(F.col(h), F.lit(1 << 40)) < max(1, int((1 << 40) * 4 * most / total)))
    return kept.distinct().orderBy(F.pmod(F.col(h), F.lit(1 << 40)), h, *rows.columns).limit(most).drop(h)


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(doc_id.cast("string")) % parts


def held_out(doc_id: Column, parts: int, fold: int) -> Column:
    """True for the fold that learning must not see; a null id is never learned from and counts as held out."""
    return F.coalesce(bucket(doc_id, parts) == fold, F.lit(True))


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points of a text as unsigned 32-bit integers."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


def hashed_ngrams(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket numbers below 2**bits of all runs of n code points, in text order."""
    if len(codes) < n:
        return np.empty(0, dtype=np.uint32)
    h = codes[: len(codes) - n + 1].copy()
    for k in range(1, n):
        h *= np.uint32(0x01000193)
        h += codes[k : len(codes) - n + 1 + k]
    h += np.uint32(n)
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h >>= np.uint32(32 - bits)
    return h
