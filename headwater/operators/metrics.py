"""Operator telemetry: mergeable moments, histograms, rates, queues, samples and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import numbered
from .ranges import within


def moments(value: Column, prefix: str = "") -> list[Column]:
    """The mergeable triple of a value: count, sum, sum of squares."""
    return [F.count(value).alias(f"{prefix}cnt"), F.sum(value).alias(f"{prefix}total"), F.sum(value * value).alias(f"{prefix}sumsq")]


def derived(df: DataFrame) -> DataFrame:
    """avg, var (of the population) and scv from cnt, total, sumsq; all 0 without observations."""
    avg = F.col("total") / F.col("cnt")
    e2 = F.col("sumsq") / F.col("cnt")
    some = F.col("cnt") > 0
    guard = lambda c: F.when(some, c).otherwise(0.0)
    return df.select("*", guard(avg).alias("avg"), guard(e2 - avg * avg).alias("var"), guard(F.when(avg != 0, e2 / (avg * avg) - 1)).alias("scv"))


def merge(df: DataFrame, *keys: str) -> DataFrame:
    """Moments of moments."""
    return df.groupBy(*keys).agg(F.sum("cnt").alias("cnt"), F.sum("total").alias("total"), F.sum("sumsq").alias("sumsq"))


def histogram_bucket(value: Column, axis: list[float]) -> Column:
    """0-based bucket of len(axis) + 1; a value on a boundary belongs to the lower one."""
    return F.aggregate(F.array(*[F.lit(float(a)) for a in axis]), F.lit(0).cast("long"), lambda n, x: n + F.when(x < value, 1).otherwise(0))


def latency_histogram(df: DataFrame, key: str, value: str, axis: list[float]) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(key, histogram_bucket(F.col(value), axis).alias("bucket")).agg(F.count("*").alias("cnt"))


def misses(df: DataFrame, key: str, value: str, limit: float) -> DataFrame:
    """Observations above the limit (strictly), and moments of all."""
    return df.groupBy(key).agg(*moments(F.col(value)), F.count(F.when(F.col(value) > limit, 1)).alias("missed"))


def systematic_sample(df: DataFrame, task: str, order: list[str], rate: float) -> DataFrame:
    """Every floor(1 / rate)-th record of a task, the first one always."""
    if not 0 < rate <= 1:
        raise ValueError("rate must lie in (0, 1]")
    w = Window.partitionBy(task).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w) - 1).filter(F.col("_n") % int(1 / rate) == 0).drop("_n")


def metric_lines(df: DataFrame) -> DataFrame:
    """component:task:ts->json lines of event records."""
    return df.select(F.concat_ws("", "event_type", F.lit(":"), "user_id", F.lit(":"), F.unix_millis(F.col("ts").cast("timestamp")), F.lit("->"), "props").alias("line"))


def parse_metric_lines(lines: DataFrame) -> DataFrame:
    """component, task, millis, data json; lines that don't parse are left out. Accepts lines without a time."""
    part = lambda i: F.regexp_extract("line", r"^([^:]+):(\d+)(?::(\d+))?->(\{.*\})$", i)
    return lines.filter(part(1) != "").select(part(1).alias("component"), part(2).cast("long").alias("task"), F.nullif(part(3), F.lit("")).cast("long").alias("millis"), part(4).alias("data"))


def whitelist(df: DataFrame, names: DataFrame) -> DataFrame:
    """Keeps metrics that are listed and renames them; names: (name, alias), a table of configuration lines.

    Components of the system (two leading underscores) and empty values go.
    """
    keep = ~F.col("component").startswith("__") & F.col("value").isNotNull() & (F.col("value") != "") & (F.col("value") != "{}")
    return df.filter(keep).join(names, "name").withColumn("name", F.coalesce("alias", "name")).drop("alias")


def queue_rates(df: DataFrame, *keys: str) -> DataFrame:
    """From total_count, total_len, samples, duration_ms: mean queue length and arrivals a second, 0 or null without a base."""
    sums = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("total_count", "total_len", "samples", "duration_ms")])
    return sums.select(
        *keys, "total_count",
        F.coalesce(F.try_divide("total_len", "samples"), F.lit(0.0)).alias("avg_len"),
        F.try_divide(F.col("total_count") * 1000.0, "duration_ms").alias("arrival_rate"),
    )


def history(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Moments merged over the last n intervals; intervals without a full history are left out."""
    ordered = Window.partitionBy(key).orderBy(order)
    w = ordered.rowsBetween(1 - n, 0)
    merged = [F.sum(c).over(w).alias(c) for c in ("cnt", "total", "sumsq")]
    return df.select(key, order, *merged, F.row_number().over(ordered).alias("_n")).filter(F.col("_n") >= n).drop("_n")


def executor_rollup(tasks: DataFrame, executors: DataFrame) -> DataFrame:
    """Task metrics by executor; the duration counts for an executor's first task alone.

    tasks: component, task, cnt, total, sumsq, duration; executors: component, executor,
    start_task, end_task.
    """
    held = within(tasks, "task", executors.select("component", "executor", "start_task", "end_task"), ["component"], ("start_task", "end_task"))
    return held.groupBy("component", "executor").agg(
        F.sum("cnt").alias("cnt"), F.sum("total").alias("total"), F.sum("sumsq").alias("sumsq"),
        F.sum(F.when(F.col("task") == F.col("start_task"), F.col("duration")).otherwise(0)).alias("duration"),
    )


def execution_stats(df: DataFrame, key: Column, cost: str, size: str, order: list[str]) -> DataFrame:
    """Count, total cost and the latest size by key."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("cnt"), F.sum(cost).alias("cost"), F.max_by(size, F.struct(*order)).alias("last_size"))


def transitions(df: DataFrame, order: str, load: str, edges: list[float]) -> DataFrame:
    """(from_state, to_state, p) between consecutive loads in order; one row for each step, e.g. a day."""
    state = histogram_bucket(F.col(load).cast("double"), edges)
    steps = numbered(df.select(order, state.alias("_s")), [order], "_i")
    steps = steps.select("_i", F.col("_s").alias("from_state")).join(steps.select((F.col("_i") - 1).alias("_i"), F.col("_s").alias("to_state")), "_i")
    counts = steps.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
    return counts.select("from_state", "to_state", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("from_state"))).alias("p"))
