"""Event streams: running counters, incremental digests, rate limits, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tessera.operators.entity import interaction_counts, scored


def source(spark: SparkSession, where: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream; where: a folder, or a pattern of files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(where)


def rollup(events: DataFrame, checkpoint: str, upsert) -> StreamingQuery:
    """Counters and affinity of each key, kept up to date; upsert(rows, epoch) takes the changed keys of a batch."""
    counts = scored(interaction_counts(events))
    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(upsert).start()


def digest(events: DataFrame, checkpoint: str, deliver) -> StreamingQuery:
    """Sections of what is new since the last run; the checkpoint is the cursor and moves on only after delivery."""

    def sections(batch: DataFrame, epoch: int) -> None:
        deliver(batch.groupBy("event_type").agg(F.count("*").alias("items"), F.min("ts").alias("first"), F.max("ts").alias("last")), epoch)

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sections).start()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each kind by event-time window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("items"), F.sum("value").alias("value"))


def rate_limited(events: DataFrame, limit: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, wait): 0 for an event that passes, else the whole seconds to wait.

    A window opens with a key's first event and not at a round time; batches of a key are taken in order
    of time. State is the window's end and its count; it goes when the watermark passes the end, so
    memory follows the number of live keys. Events later than the watermark are left out.
    """

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        end, n = state.get if state.exists else (0.0, 0)
        waits = []
        for t in rows["ts"].astype("int64") / (1e9 if str(rows["ts"].dtype).endswith("ns]") else 1e6):
            if end <= t:
                end, n = t + seconds, 1
                waits.append(0)
            elif n >= limit:
                waits.append(max(1, int(end - t)))
            else:
                n += 1
                waits.append(0)
        if end * 1000 > state.getCurrentWatermarkMs():
            state.update((float(end), int(n)))
            state.setTimeoutTimestamp(int(end * 1000) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "wait": waits})

    live = events.withWatermark("ts", late)
    return live.groupBy("user_id").applyInPandasWithState(check, "user_id long, event_id long, wait long", "end double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited_batch(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """The same for a table: each task folds its sorted rows and carries one key's window from batch to batch."""
    kinds = dict(events.dtypes)
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ordered = events.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").select("user_id", "event_id", at.alias("t"), F.col("user_id").isNull().alias("unknown"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, end, n = None, 0.0, 0
        for rows in frames:
            waits = []
            for user, unknown, t in zip(rows["user_id"], rows["unknown"], rows["t"], strict=True):
                now = (True, None) if unknown else (False, user)
                if now != key:
                    key, end, n = now, 0.0, 0
                if end <= t:
                    end, n = t + seconds, 1
                    waits.append(0)
                elif n >= limit:
                    waits.append(max(1, int(end - t)) if t == t else 1)
                else:
                    n += 1
                    waits.append(0)
            yield rows[["user_id", "event_id"]].assign(wait=waits)

    return ordered.mapInPandas(fold, f"user_id {kinds['user_id']}, event_id {kinds['event_id']}, wait long")


def latest_state(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in a log of changes, reduced on the map side."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), order).alias("last"))
    return last.select("last.*")
