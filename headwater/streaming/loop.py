"""The optimisation loop as a stream: metric lines to executors, history, a model and moves, which the next batch runs under.

A batch holds the lines of one interval. What a batch leaves (the allocation that the loop
knows of, the one that runs, and the intervals since the last change) is a version of its own,
so a batch that is run again after a failure reads what it read before and writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import COMPLETE_LATENCY, DURATION, EXECUTE, RECV_QUEUE, SEND_QUEUE, Scheduling
from ..functions.ordering import staged
from ..operators import control, metrics
from ..operators.ranges import within

_RESULTS = "interval long, component string, executor long, cnt long, total double, send_total long, recv_total long, duration long"
_ALLOC = "comp string, known long, running long"
_MOVES = "step long, comp string, k_now long, k_new long"


def execute_moments(lines: DataFrame, name: str = EXECUTE) -> DataFrame:
    """component, task, source, stream, cnt, total, sumsq of a metric's entries `source:stream` (or `stream`); those without a count are left out."""
    parsed = metrics.parse_metric_lines(lines)
    entries = F.from_json(F.get_json_object("data", f"$['{name}']"), "map<string,string>")
    rows = parsed.select("component", "task", F.explode(entries).alias("_key", "_value"))
    key, value = F.split("_key", ":"), F.split("_value", ",")
    number = lambda i, kind: F.try_element_at(value, F.lit(i)).try_cast(kind)
    source = F.when(F.size(key) > 1, F.get(key, F.lit(0)))
    out = rows.select("component", "task", source.alias("source"), F.element_at(key, -1).alias("stream"), number(1, "long").alias("cnt"), number(2, "double").alias("total"), number(3, "double").alias("sumsq"))
    return out.filter("cnt > 0")


def task_measurements(lines: DataFrame, sources: list[str]) -> DataFrame:
    """component, task, cnt, total (sources: complete latencies, others: executions), queues and duration, of all lines of an interval."""
    served = execute_moments(lines, COMPLETE_LATENCY).filter(F.col("component").isin(sources)).unionByName(execute_moments(lines).filter(~F.col("component").isin(sources)))
    served = served.groupBy("component", "task").agg(F.sum("cnt").alias("cnt"), F.sum("total").alias("total"))
    field = lambda *path: F.get_json_object("data", "$" + "".join(f"['{p}']" for p in path)).try_cast("long")
    queues = {f"{q}_{c}": field(name, of) for q, name in (("send", SEND_QUEUE), ("recv", RECV_QUEUE)) for c, of in (("total", "totalCount"), ("samples", "sampleCount"), ("len", "totalQueueLen"))}
    rows = metrics.parse_metric_lines(lines).groupBy("component", "task").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in queues.items()], F.coalesce(F.sum(field(DURATION)), F.lit(0)).alias("duration"))
    return rows.join(served, ["component", "task"], "left").fillna(0, ["cnt", "total"])


def executor_ranges(alloc: DataFrame, tasks: int) -> DataFrame:
    """component, executor, start_task, end_task: the tasks 0 to tasks - 1 of a component in k even ranges; alloc: comp, k."""
    one = alloc.select(F.col("comp").alias("component"), F.least(F.col("k"), F.lit(tasks)).alias("_k"))
    opened = one.select("component", "_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)).alias("executor"))
    at = lambda e: F.floor(e * tasks / F.col("_k"))
    return opened.select("component", "executor", at(F.col("executor")).alias("start_task"), (at(F.col("executor") + 1) - 1).alias("end_task"))


def executor_results(lines: DataFrame, alloc: DataFrame, sources: list[str], tasks: int, interval: int) -> DataFrame:
    """A row of measurements for each executor of an interval."""
    measured = staged(task_measurements(lines, sources))
    ranges = executor_ranges(alloc, tasks)
    queues = control.queue_rollup(measured, ranges).select("component", "executor", "send_total", "recv_total", "duration")
    served = within(measured, "task", ranges, ["component"], ("start_task", "end_task")).groupBy("component", "executor").agg(F.sum("cnt").alias("cnt"), F.sum("total").alias("total"))
    both = queues.join(served, ["component", "executor"])
    return both.select(F.lit(interval).cast("long").alias("interval"), "component", F.col("executor").cast("long").alias("executor"), "cnt", F.col("total").cast("double").alias("total"), F.col("send_total").cast("long").alias("send_total"), F.col("recv_total").cast("long").alias("recv_total"), F.col("duration").cast("long").alias("duration"))


class Loop:
    """Takes the lines of an interval, and gives the moves that the model and the decision want.

    If the running allocation isn't the one that the loop knows of, the interval was measured across a change:
    it is discarded with all history, and the running allocation is known from then on. Else the interval joins
    the history and, once that is long enough, the model runs; what it wants is the running
    allocation of the next interval. A component has no more executors than its `tasks`.
    """

    def __init__(self, folder: str, alloc: DataFrame, sources: list[str], tasks: int, settings: Scheduling, calculator: str = "general", decision: str = "optimum", workers: int = 1):
        self.folder, self.sources, self.tasks, self.settings = folder, sources, tasks, settings
        self.how = {"calculator": calculator, "decision": decision, "workers": workers}
        alloc.select("comp", F.col("k").cast("long").alias("known"), F.col("k").cast("long").alias("running")).write.mode("overwrite").parquet(f"{folder}/alloc/version=0")
        alloc.sparkSession.createDataFrame([], _RESULTS).write.mode("overwrite").parquet(f"{folder}/history/version=0")

    def read(self, spark: SparkSession, name: str, version: int, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.folder}/{name}/version={version}")

    def step(self, lines: DataFrame, number: int) -> None:
        spark, after = lines.sparkSession, number + 1
        alloc = self.read(spark, "alloc", number, _ALLOC)
        history = self.read(spark, "history", number, _RESULTS)
        running = alloc.select("comp", F.col("running").alias("k"))
        if alloc.filter("known <> running").limit(1).count():
            history, moves, wanted = spark.createDataFrame([], _RESULTS), spark.createDataFrame([], _MOVES), running
        else:
            results = executor_results(lines, running, self.sources, self.tasks, number)
            recent = F.col("interval") > number - max(self.settings.history, 1)
            results.unionByName(history.filter(recent)).write.mode("overwrite").parquet(f"{self.folder}/history/version={after}")
            history = None
            merged = self.read(spark, "history", after, _RESULTS)
            moves = control.rebalance(merged, running, self.sources, self.settings, **self.how)
            fits = F.least(F.col("k_new"), F.lit(self.tasks)).cast("long").alias("k_new")
            moves = moves.filter("k_new IS NOT NULL").select(F.lit(number).cast("long").alias("step"), "comp", "k_now", fits)
            moves = staged(moves.filter("k_now <> k_new"))
            wanted = running.join(moves, "comp", "left").select("comp", F.coalesce("k_new", "k").alias("k"))
        if history is not None:
            history.write.mode("overwrite").parquet(f"{self.folder}/history/version={after}")
        alloc.select("comp", F.col("running").alias("known")).join(wanted, "comp").select("comp", "known", F.col("k").alias("running")).write.mode("overwrite").parquet(f"{self.folder}/alloc/version={after}")
        moves.write.mode("overwrite").parquet(f"{self.folder}/moves/batch={number}")

    def run(self, lines: DataFrame) -> StreamingQuery:
        """The loop over a stream of lines (line), an interval a batch."""
        return lines.writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()

    def moves(self, spark: SparkSession) -> DataFrame:
        """step, comp, k_now, k_new of all intervals so far."""
        return spark.read.schema(_MOVES).parquet(f"{self.folder}/moves").select("step", "comp", "k_now", "k_new")
