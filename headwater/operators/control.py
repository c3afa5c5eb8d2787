"""From measurements to an allocation: executor roll-ups, service nodes, calculators, decisions and budgets.

Measurements come by interval, component and executor; all steps are aggregates and joins
of tables of a few rows for each component, so the loop from metrics to a new allocation is
one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Registry, Scheduling
from ..functions.ordering import staged
from . import queueing
from .ranges import within

QUEUES = ("send", "recv")


def queue_rollup(tasks: DataFrame, executors: DataFrame, *keys: str) -> DataFrame:
    """Queues and duration by executor.

    tasks: component, task, send_total, send_samples, send_len, recv_total, recv_samples,
    recv_len, duration, and keys; executors: component, executor, start_task, end_task. A
    report of a queue that nothing arrived at doesn't count; the duration is that of an
    executor's first task.
    """
    held = within(tasks, "task", executors.select("component", "executor", "start_task", "end_task"), ["component"], ("start_task", "end_task"))
    some = lambda q, c: F.sum(F.when(F.col(f"{q}_total") > 0, F.col(f"{q}_{c}")).otherwise(0)).alias(f"{q}_{c}")
    duration = F.sum(F.when(F.col("task") == F.col("start_task"), F.col("duration")).otherwise(0)).alias("duration")
    return held.groupBy(*keys, "component", "executor").agg(*[some(q, c) for q in QUEUES for c in ("total", "samples", "len")], duration)


def moments_rollup(rows: DataFrame, *keys: str) -> DataFrame:
    """Moments by keys; reports without a count are left out."""
    return rows.filter("cnt > 0").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("cnt", "total", "sumsq")])


def queue_lengths_and_rates(df: DataFrame) -> DataFrame:
    """Adds the mean length of both queues (0 without samples), and arrivals and departures a second (null without a duration)."""
    mean = lambda q: F.coalesce(F.try_divide(f"{q}_len", f"{q}_samples"), F.lit(0.0)).alias(f"{q}_avg")
    rate = lambda q, name: F.try_divide(F.col(f"{q}_total") * 1000.0, F.col("duration")).alias(name)
    return df.select("*", mean("send"), mean("recv"), rate("recv", "arrival_rate"), rate("send", "departure_rate"))


def completion_rate(cnt: Column, duration_ms: Column, sample_rate: float) -> Column:
    """Completed records a second, scaled up from the sampled ones; null without a duration."""
    return F.try_divide(cnt * 1000.0, duration_ms * sample_rate)


def emit_counts(df: DataFrame, keys: list[str], sampled: Column) -> DataFrame:
    """Records emitted while sampling, by keys; keys without any are left out."""
    return df.filter(sampled).groupBy(*keys).agg(F.count("*").alias("emitted"))


def failure_histogram(df: DataFrame, key: str, value: str, failed: str, axis: list[float]) -> DataFrame:
    """key, bucket, cnt, fails: latencies of successes by bucket with the key's failures; a key without successes is left out."""
    from .metrics import latency_histogram

    fails = df.groupBy(key).agg(F.count_if(F.col(failed)).alias("fails"))
    return latency_histogram(df.filter(~F.col(failed)), key, value, axis).join(fails, key)


def duration(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Milliseconds between a key's first and last record."""
    millis = F.unix_millis(F.col(ts).cast("timestamp"))
    return df.groupBy(key).agg((F.max(millis) - F.min(millis)).alias("duration"))


def last_intervals(results: DataFrame, n: int, ignore: int = 0) -> DataFrame:
    """Sums by component over the last n intervals, once n intervals (less `ignore`) have come; before that, nothing.

    results: interval, component and numbers, one row for each executor and interval.
    """
    numbers = [c for c in results.columns if c not in ("interval", "component", "executor")]
    sums = results.groupBy("interval", "component").agg(*[F.sum(c).alias(c) for c in numbers])
    place = F.dense_rank().over(Window.partitionBy("component").orderBy(F.desc("interval")))
    merged = sums.withColumn("_place", place).filter(F.col("_place") <= n).groupBy("component").agg(*[F.sum(c).alias(c) for c in numbers])
    seen = results.agg((F.countDistinct("interval") + ignore >= n).alias("_full"))
    return merged.crossJoin(F.broadcast(seen)).filter("_full").drop("_full")


def optimise_step(millis: Column, start_ms: int, interval_s: int) -> Column:
    """The optimisation step that a measurement goes into: one every interval, the first after two intervals, which takes both."""
    return F.greatest(F.floor((millis - start_ms) / (interval_s * 1000)) - 1, F.lit(0)).cast("long")


def executors_by_component(executors: DataFrame) -> DataFrame:
    """comp, k: the current allocation; executors: component, executor, start_task, end_task."""
    return executors.groupBy(F.col("component").alias("comp")).agg(F.count("*").alias("k"))


def component_tasks(executors: DataFrame) -> DataFrame:
    """component, executors, tasks (ascending) with the ranges opened."""
    opened = executors.select("component", "executor", F.explode(F.sequence("start_task", "end_task")).alias("task"))
    return opened.groupBy("component").agg(F.countDistinct("executor").alias("executors"), F.array_sort(F.collect_set("task")).alias("tasks"))


def ordered_executors(executors: DataFrame) -> DataFrame:
    """Executors by their first task."""
    return executors.orderBy("start_task", "component", "executor")


def task_costs(df: DataFrame, cost: str) -> DataFrame:
    """total, mean and largest cost of all tasks."""
    return df.agg(F.sum(cost).alias("total"), F.avg(cost).alias("mean"), F.max(cost).alias("most"))


# --- nodes and calculators --------------------------------------------------------


def source_node(merged: DataFrame, alloc: DataFrame, sources: list[str], sample_rate: float = 1.0, send_factor: float = 2.0, mean_of_all: bool = False) -> DataFrame:
    """One row: real_ms, complete_rate, leave_rate of the first source by name, or the mean latency of all."""
    own = merged.filter(F.col("component").isin(sources)).join(alloc.withColumnRenamed("comp", "component"), "component")
    real = F.coalesce(F.try_divide("total", "cnt"), F.lit(0.0))
    leave = F.try_divide(F.col("send_total") * 1000.0, F.col("duration")) * F.col("k") / send_factor
    rows = own.select("component", real.alias("real_ms"), completion_rate(F.col("cnt"), F.col("duration"), sample_rate).alias("complete_rate"), leave.alias("leave_rate"))
    if mean_of_all:
        return rows.agg(F.avg("real_ms").alias("real_ms"), F.sum("complete_rate").alias("complete_rate"), F.sum("leave_rate").alias("leave_rate"))
    first = rows.agg(F.min_by(F.struct("real_ms", "complete_rate", "leave_rate"), "component").alias("_s"))
    return first.select("_s.*")


def service_nodes(merged: DataFrame, alloc: DataFrame, sources: list[str], source: DataFrame, chain: bool = False) -> DataFrame:
    """comp, lam, mu, ratio of all components that are no sources and have served something."""
    own = merged.filter(~F.col("component").isin(sources)).join(alloc.withColumnRenamed("comp", "component"), "component")
    lam = F.try_divide(F.col("recv_total") * 1000.0, F.col("duration")) * F.col("k")
    mu = F.try_divide(F.lit(1000.0) * F.col("cnt"), F.col("total"))
    nodes = own.select(F.col("component").alias("comp"), lam.alias("lam"), mu.alias("mu")).crossJoin(F.broadcast(source.select("leave_rate")))
    ratio = F.lit(1.0) if chain else F.try_divide("lam", "leave_rate")
    return nodes.select("comp", "lam", "mu", ratio.alias("ratio")).filter("lam > 0 and mu > 0")


class Calculator(Protocol):
    """comp, k_now, k_min, k_opt, status, est_ms, ratio from an interval's results and the current allocation; empty until there is enough history."""

    def __call__(self, results: DataFrame, alloc: DataFrame, sources: list[str], most: int | DataFrame, settings: Scheduling) -> DataFrame: ...


CALCULATORS = Registry("calculator")


def _calculate(results: DataFrame, alloc: DataFrame, sources: list[str], most: int | DataFrame, settings: Scheduling, chain: bool) -> DataFrame:
    # a row for each component, which the model's plan uses many times over
    merged = staged(last_intervals(results, settings.history, settings.ignore))
    alloc = staged(alloc)
    source = source_node(merged, alloc, sources, settings.sample_rate, settings.send_factor, mean_of_all=chain)
    nodes = service_nodes(merged, alloc, sources, source, chain)
    held = alloc.agg(F.coalesce(F.sum(F.when(F.col("comp").isin(sources), F.col("k"))), F.lit(0)).alias("held"))
    allowed = most.toDF("_most") if isinstance(most, DataFrame) else held.select(F.lit(most).alias("_most"))
    limit = held.crossJoin(allowed).select((F.col("_most") - F.col("held")).cast("long").alias("most"))
    return queueing.check_optimised(nodes, alloc.filter(~F.col("comp").isin(sources)), source.select("real_ms"), settings.qos_ms, limit)


@CALCULATORS.add("general")
def general(results: DataFrame, alloc: DataFrame, sources: list[str], most: int | DataFrame, settings: Scheduling) -> DataFrame:
    """Nodes weigh by their arrivals for each record that leaves the first source."""
    return _calculate(results, alloc, sources, most, settings, chain=False)


@CALCULATORS.add("chain")
def chain(results: DataFrame, alloc: DataFrame, sources: list[str], most: int | DataFrame, settings: Scheduling) -> DataFrame:
    """Every record visits every node once; the latency is the mean over all sources."""
    return _calculate(results, alloc, sources, most, settings, chain=True)


# --- decisions ----------------------------------------------------------------------

DECISIONS = Registry("decision")
#: (result of a calculator, current allocation, seconds since the start) to the wanted allocation, or None for no change.
Decision = Callable[[DataFrame, DataFrame, float], "DataFrame | None"]


@DECISIONS.add("optimum")
def optimum(result: DataFrame, alloc: DataFrame, elapsed: float) -> DataFrame:
    """The best allocation; components without one keep theirs."""
    best = result.select("comp", F.col("k_opt").alias("_k"))
    return alloc.join(best, "comp", "left").select("comp", F.coalesce("_k", "k").cast("long").alias("k"))


@DECISIONS.add("never")
def never(result: DataFrame, alloc: DataFrame, elapsed: float) -> None:
    """No change, ever."""
    return None


@DECISIONS.add("keep")
def keep(result: DataFrame, alloc: DataFrame, elapsed: float) -> DataFrame:
    """The current allocation, for runs that only watch."""
    return alloc.select("comp", F.col("k").cast("long").alias("k"))


def once(plan: dict[str, int], after: float = 300.0) -> Decision:
    """One fixed plan from `after` seconds on, until it holds; components that aren't in it keep theirs."""

    def decide(result: DataFrame, alloc: DataFrame, elapsed: float) -> DataFrame | None:
        if elapsed < after:
            return None
        fixed = alloc.sparkSession.createDataFrame(list(plan.items()), "comp string, _k long")
        return alloc.join(fixed, "comp", "left").select("comp", F.coalesce("_k", "k").cast("long").alias("k"))

    return decide


def drift(seed: int) -> Decision:
    """One executor more or less for each component, drawn by its name: for tests of the loop. None falls under one."""

    def decide(result: DataFrame, alloc: DataFrame, elapsed: float) -> DataFrame:
        step = F.when(F.pmod(F.xxhash64("comp", F.lit(seed)), F.lit(2)) == 0, 1).otherwise(-1)
        return alloc.select("comp", F.greatest(F.col("k") + step, F.lit(1)).cast("long").alias("k"))

    return decide


def rebalance(results: DataFrame, alloc: DataFrame, sources: list[str], settings: Scheduling, workers: int = 1, calculator: str = "general", decision: str | Decision = "optimum", elapsed: float = 0.0) -> DataFrame:
    """comp, k_now, k_new of what an optimisation step changes: metrics to model to decision."""
    most = executor_budget(alloc, settings, workers)
    result = CALCULATORS.get(calculator)(results, alloc, sources, most, settings)
    wanted = (DECISIONS.get(decision) if isinstance(decision, str) else decision)(result, alloc, elapsed)
    return queueing.moves(alloc if wanted is None else wanted, alloc.select("comp", F.col("k").cast("long").alias("k")))


def executor_budget(alloc: DataFrame, settings: Scheduling, workers: int) -> DataFrame:
    """One row, budget: the executors allowed, a setting or what the larger of the asked and the current number of workers holds."""
    held = F.ceil(F.coalesce(F.sum("k"), F.lit(0)) / settings.per_worker)
    budget = F.greatest(held, F.lit(workers)) * settings.per_worker
    return alloc.agg((budget if settings.allowed == -1 else F.lit(settings.allowed)).cast("long").alias("budget"))


def workers_by_half(alloc: DataFrame, per_worker: int) -> DataFrame:
    """workers, executors; a last worker is only added if more than half of it is needed."""
    total = F.sum("k").cast("long")
    more = F.when(total % per_worker > per_worker // 2, 1).otherwise(0)
    return alloc.agg((F.floor(total / per_worker) + more).cast("long").alias("workers"), total.alias("executors"))
