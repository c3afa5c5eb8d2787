"""Deduplication, the latest signal, sinks and listeners of streams."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def distinct_updates(stream: DataFrame, keys: list[str], time: str, lateness: str = "1 minute") -> DataFrame:
    """The first of repeated template updates; keys are forgotten at the watermark."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def latest_signal(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest control signal of all batches as a table for each batch; columns sig_type, at. Read it with current_signal()."""

    def write(batch: DataFrame, number: int) -> None:
        before = signal_before(batch.sparkSession, folder, number)
        rows = batch.select("sig_type", "at")
        rows = rows if before is None else rows.unionByName(before)
        newest = rows.orderBy(F.desc("at"), F.desc("sig_type")).limit(1)
        newest.write.mode("overwrite").parquet(f"{folder}/version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signal_before(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame | None:
    """The signal that the last finished batch (before `number`) left, or None; versions are never overwritten by later ones."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_SUCCESS")
    done = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    versions = [int(str(f.getPath().getParent().getName()).removeprefix("version=")) for f in done]
    versions = [v for v in versions if number is None or v < number]
    return spark.read.parquet(f"{folder}/version={max(versions)}").select("sig_type", "at") if versions else None


def current_signal(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest signal so far, for joins of later batches with it; None before the first."""
    return signal_before(spark, folder)


def to_report_lines(batch: DataFrame, kind: str) -> DataFrame:
    """value: `kind:component->json` lines of rows with a component, as the scheduler reports allocations and tasks."""
    rest = F.struct(*[c for c in batch.columns if c != "component"])
    return batch.select(F.concat(F.lit(f"{kind}:"), "component", F.lit("->"), F.to_json(rest)).alias("value"))


def to_reports(stream: DataFrame, kind: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Reports as text, a folder for each batch; a batch that is run again after a failure overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        to_report_lines(batch, kind).write.mode("overwrite").text(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def to_frames(stream: DataFrame, folder: str, checkpoint: str, patience: int = 4) -> StreamingQuery:
    """Frames of each video in ascending order over all batches; those that come too late are dropped.

    stream: video, frame, at; a null frame ends a video. A batch is a folder of its own, sorted within.
    """
    from .stateful import in_order

    def write(batch: DataFrame, number: int) -> None:
        batch.repartition("video").sortWithinPartitions("video", "frame").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return in_order(stream, patience).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_console(stream: DataFrame, mode: str = "append", rows: int = 20) -> StreamingQuery:
    return stream.writeStream.format("console").outputMode(mode).option("numRows", rows).trigger(availableNow=True).start()


class ProgressListener(StreamingQueryListener):
    """Gives the figures of each micro-batch to a function: what a scheduler measures of a running query."""

    def __init__(self, measured: Callable[[dict[str, Any]], None]):
        self.measured = measured

    def onQueryStarted(self, event) -> None:
        self.measured({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.measured({"event": "progress", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "duration": p.batchDuration, "rate": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.measured({"event": "terminated", "id": str(event.id)})
