"""Streams of records: idempotent ingest, version vectors, clocks, delivery to peers.

Late records are welcome forever, so the parity operators have no watermark. Ingest holds no state at all:
each micro-batch is joined against the store it appends to. ``dedupe_within`` is the bounded-state
variant, weaker by design.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from mnemolake.functions.clock import advance
from mnemolake.functions.ids import canonical
from mnemolake.schema import RECORD
from mnemolake.sources.store import RecordStore


def record_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RECORD)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def ingest(stream: DataFrame, store: RecordStore, checkpoint: str, hook: Callable[[DataFrame], None] | None = None, every: str | None = None) -> StreamingQuery:
    """Append what is new of each micro-batch; a replayed batch adds nothing. ``hook`` sees the new rows."""

    def write(batch: DataFrame, _: int) -> None:
        fresh = store.append(batch)
        if hook is not None and not fresh.isEmpty():
            hook(fresh)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def dedupe_within(stream: DataFrame, delay: str) -> DataFrame:
    """Duplicates dropped only while they arrive within ``delay`` of event time; later ones pass."""
    timed = stream.withColumn("event_time", F.timestamp_millis(F.col("hlc.wall")))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["space", "id"]).drop("event_time")


def vector_stream(stream: DataFrame) -> DataFrame:
    """Incremental version vector; write in update or complete mode."""
    return stream.groupBy("space", F.col("author_node").alias("node")).agg(F.max(canonical("id")).alias("high"))


class ClockProcessor(StatefulProcessor):
    """A node's hybrid clock: one (wall, counter) value a node, moved on by every observed record."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "wall bigint, counter bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.last.get() if self.last.exists() else (0, 0)
        now = (int(held[0]), int(held[1]))
        for pdf in rows:
            for wall, counter, local in pdf[["wall", "counter", "now"]].itertuples(index=False):
                now = advance(now, (int(wall), int(counter)), int(local))
        self.last.update(now)
        yield pd.DataFrame({"node": [key[0]], "wall": [now[0]], "counter": [now[1]]})

    def close(self) -> None:
        pass


def clock_stream(stream: DataFrame) -> DataFrame:
    """node, wall, counter after each micro-batch (update mode; RocksDB state store)."""
    timed = stream.select(F.col("author_node").alias("node"), F.col("hlc.wall").alias("wall"), F.col("hlc.counter").alias("counter"), F.unix_millis(F.col("received_at").cast("timestamp")).alias("now"))
    return timed.groupBy("node").transformWithStateInPandas(ClockProcessor(), "node string, wall bigint, counter bigint", "Update", "None")


def push(stream: DataFrame, targets: list[RecordStore], checkpoint: str) -> StreamingQuery:
    """Deliver each micro-batch to the chosen peers' stores."""

    def write(batch: DataFrame, _: int) -> None:
        for t in targets:
            t.append(batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
