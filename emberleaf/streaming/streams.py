"""Streams: incremental ingestion, windows, session buffers, counters and expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as they arrive; the checkpoint remembers which were read."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def tumbling(events: DataFrame, ts: str, width: str, late: str, *keys: Column) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"))


def sliding(events: DataFrame, ts: str, width: str, slide: str, late: str, *keys: Column) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w"), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, gap: str, late: str, key: str, item: Column) -> DataFrame:
    """A session of a key ends after ``gap`` without an event; it carries its distinct items, a buffer to make pairs from."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(item)).alias("items"))


def recall_counts(events: DataFrame, item: Column) -> DataFrame:
    """Running accesses of each item, for update or complete output."""
    return events.groupBy(item.alias("item")).agg(F.count("*").alias("n_a"))


def deduplicated(events: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def expiring(events: DataFrame, key: str, ts: str, hours: int, late: str = "0 seconds") -> DataFrame:
    """Keys whose last event is ``hours`` old by event time, with their number of events: (key, n, last)."""
    kind = dict(events.dtypes)[key]

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "n": [n], "last": [pd.Timestamp(last, unit="us")]})
            return
        n, last = state.get if state.exists else (0, 0)
        for f in frames:
            n += len(f)
            last = max(last, int(f[ts].max().value // 1000))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last // 1000 + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))

    rows = events.withWatermark(ts, late).groupBy(key)
    return rows.applyInPandasWithState(step, f"{key} {kind}, n long, last timestamp", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Reads all there is, writes Parquet and stops."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def latest_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The whole result of the last batch as a table, for complete output."""

    def write(batch: DataFrame, _id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def append_audit(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Audit events appended to a log of JSON lines."""
    q = df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
