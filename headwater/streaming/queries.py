"""Structured Streaming versions of the running aggregates and stateful joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import metrics, text


def read_folder(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A parquet folder as a stream; back-pressure by files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_word_count(stream: DataFrame, column: str = "text") -> DataFrame:
    """Exactly-once running counts, for the update or complete mode."""
    return text.split_words(stream.select(column), column).groupBy("word").agg(F.count("*").alias("cnt"))


def windowed_moments(stream: DataFrame, time: str, key: str, value: str, width: str = "10 seconds", lateness: str = "1 minute") -> DataFrame:
    """Tumbling count, sum and sum of squares by key; state ends with the watermark."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", lateness)
    return timed.groupBy(F.window("_t", width).alias("w"), key).agg(*metrics.moments(F.col(value))).select(F.col("w.start").alias("start"), key, "cnt", "total", "sumsq")


def frame_join(frames: DataFrame, rects: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """Frames with their detections; both sides are forgotten at the watermark. Columns: frame, ts."""
    a = frames.withWatermark("ts", lateness).alias("a")
    b = rects.withColumnRenamed("ts", "rect_ts").withWatermark("rect_ts", lateness).alias("b")
    bound = F.expr(f"rect_ts BETWEEN ts - INTERVAL {lateness} AND ts + INTERVAL {lateness}")
    return a.join(b, (F.col("a.frame") == F.col("b.frame")) & bound).drop(F.col("b.frame"))


def to_parquet(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", folder).trigger(availableNow=True).start()


def to_metric_lines(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Metric rows as JSON text, batch by batch; a batch written twice after a failure overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
