"""Registered queries of the stateful streams, run step by step over a table, with their SQL twins.

A table becomes a stream of a few steps of time. Each step is written, then taken by the query
in one batch, started anew from its checkpoint, so every query goes through restarts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _GAINS, _NODES, _VECTORS, _frames, _objects, query, table
from .config import Scheduling
from .functions.ordering import numbered, shared_dir, staged
from .operators import outliers, patterns
from .sources import queue
from .streaming import stateful
from .streaming.loop import Loop

STEPS = 4


def replay(spark: SparkSession, rows: DataFrame, stream: Callable[[DataFrame], DataFrame], steps: int = STEPS, base: str | None = None, tasks: int | None = None) -> DataFrame:
    """All that a stream gives over the steps (column `step`, from 0) of a table, each one batch of a query that starts from the last one's checkpoint (in `base`), with at most `tasks` parts of the state."""
    stateful.use_rocksdb(spark)
    base = base or f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    rows.withColumn("_step", F.col("step")).write.partitionBy("_step").parquet(f"{base}/steps")
    found, batches = None, []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        batches.append(number)

    name = "spark.sql.shuffle.partitions"
    partitions = spark.conf.get(name)
    try:
        spark.conf.set(name, str(min(int(partitions), tasks or int(partitions))))
        for i in range(steps):
            seen = ",".join(str(s) for s in range(i + 1))  # the folders of the steps so far
            found = stream(spark.readStream.schema(rows.schema).parquet(f"{base}/steps/_step={{{seen}}}"))
            found.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, partitions)
    if not batches:
        return spark.createDataFrame([], found.schema)
    return spark.read.schema(found.schema).parquet(f"{base}/out").select(found.columns)


_STEP_BASKETS = """b AS (SELECT DISTINCT l_orderkey AS k, l_orderkey % 4 AS step, l_orderkey % 5 <> 0 AS is_add, n_regionkey AS i FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
w AS (SELECT k, step, is_add, list_sort(list(i)) AS w FROM b GROUP BY ALL),
s AS (SELECT step, is_add, list_filter(w, lambda x, j: (m::BIGINT >> (j - 1)) & 1 = 1) AS p FROM (SELECT *, unnest(range(1, (1 << len(w))::BIGINT)) AS m FROM w)),
f AS (SELECT x.step, p, sum(CASE WHEN is_add THEN 1 ELSE -1 END) AS cnt FROM s JOIN range(4) AS x(step) ON s.step <= x.step GROUP BY ALL HAVING sum(CASE WHEN is_add THEN 1 ELSE -1 END) >= 400),
m AS (SELECT step, p FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.step = f.step AND len(g.p) > len(f.p) AND list_has_all(g.p, f.p)))"""


@query(f"""WITH {_STEP_BASKETS} SELECT step::BIGINT AS step, array_to_string(p, ',') AS pattern, appeared FROM (
SELECT step, p, true AS appeared FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.step = m.step - 1 AND o.p = m.p)
UNION ALL SELECT step + 1, p, false FROM m WHERE step < 3 AND NOT EXISTS (SELECT 1 FROM m o WHERE o.step = m.step + 1 AND o.p = m.p))""")
def stream_maximal(spark, d):
    """Orders as baskets of their suppliers' regions, every fifth one taken back."""
    out = replay(spark, _signed(spark, d), lambda s: stateful.maximal_changes(s, 400))
    return out.withColumn("pattern", F.array_join(F.transform("pattern", lambda x: x.cast("string")), ","))


def _signed(spark, d):
    places = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("region"))
    items = table(spark, d, "lineitem").join(places, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", (F.col("l_orderkey") % 4).alias("step"), (F.col("l_orderkey") % 5 != 0).alias("is_add"), "region")
    return patterns.subsets(items, "l_orderkey", "is_add", "region", keep=["step"])


@query(f"""WITH {_STEP_BASKETS.split(chr(10) + "f AS")[0].rstrip(",")}
SELECT array_to_string(p, ',') AS pattern, sum(CASE WHEN is_add THEN 1 ELSE -1 END)::BIGINT AS n FROM s WHERE step < 2 GROUP BY p HAVING sum(CASE WHEN is_add THEN 1 ELSE -1 END) <> 0""")
def state_counts(spark, d):
    """The counts that the state of a stream of patterns holds after two steps, read from its checkpoint."""
    base = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    replay(spark, _signed(spark, d), lambda s: stateful.crossings(s, 400), steps=2, base=base)
    counts = stateful.state_rows(spark, f"{base}/checkpoint", "count")
    return counts.select(F.array_join(F.transform("pattern", lambda x: x.cast("string")), ",").alias("pattern"), "n")


_AT = "((vec_id // 400) * 100 + vec_id % 100)::BIGINT AS id, ((vec_id % 400) // 100)::BIGINT AS step"
_MOVING = " UNION ALL ".join(f"SELECT {_AT}, {i} AS pid, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ({v}::DOUBLE[])[i])) AS pv FROM embeddings" for i, v in enumerate(_VECTORS))


@query(f"""WITH p AS ({_MOVING}),
l AS (SELECT x.step, id, pid, max_by(pv, p.step) AS pv FROM p JOIN range(4) AS x(step) ON p.step <= x.step GROUP BY ALL),
n AS (SELECT step, id, pid, count(*) OVER (PARTITION BY step, pid ORDER BY pv RANGE BETWEEN 0.05 PRECEDING AND 0.05 FOLLOWING) - 1 AS n FROM l),
o AS (SELECT step, id, bool_or(n < 10) AS is_outlier FROM n GROUP BY ALL)
SELECT step::BIGINT AS time, id, is_outlier FROM (SELECT *, lag(is_outlier) OVER (PARTITION BY id ORDER BY step) AS was FROM o) WHERE was IS NULL OR was <> is_outlier""")
def stream_outliers(spark, d):
    """Objects that move three times, by their latest values."""
    vec = F.col("id")
    moving = _objects(spark, d).select((F.floor(vec / 400) * 100 + vec % 100).cast("long").alias("id"), F.floor(vec % 400 / 100).cast("long").alias("step"), "vector")
    projected = outliers.project(moving, _VECTORS).withColumn("time", F.col("step"))
    return replay(spark, projected, lambda s: stateful.outlier_changes(s, 0.05, 10, len(_VECTORS)))


@query("""WITH a AS (SELECT o_orderkey AS frame, o_orderkey % 3 AS video, row_number() OVER (ORDER BY o_orderkey + (o_orderkey * 7919) % 23, o_orderkey) - 1 AS pos FROM orders),
p AS (SELECT *, max(frame) OVER (PARTITION BY video ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING) AS passed FROM a)
SELECT video, frame, pos AS emitted_at FROM p WHERE passed IS NULL OR frame > passed""")
def stream_reorder(spark, d):
    """Frames of three videos in the order of their arrival, four steps; the end of each video comes with the last."""
    frame = F.col("frame")
    arrivals = numbered(_frames(spark, d), [frame + (frame * 7919) % 23, "frame"], "at").withColumn("video", frame % 3)
    n = arrivals.count()
    arrivals = arrivals.withColumn("step", F.floor(F.col("at") * STEPS / n).cast("long"))
    ends = spark.range(3).select(F.lit(None).cast("long").alias("frame"), F.lit(n).cast("long").alias("at"), F.col("id").alias("video"), F.lit(STEPS - 1).cast("long").alias("step"))
    return replay(spark, arrivals.select("frame", "at", "video", "step").unionByName(ends), lambda s: stateful.in_order(s, 4))


_LATENESS = "8 days"


@query("""WITH e AS (SELECT event_type || ':' || user_id AS pattern, event_id % 5 <> 0 AS is_add, epoch_us(ts) // 1000 AS millis FROM events),
g AS (SELECT *, coalesce(millis - lag(millis) OVER w > 3600000, true)::INT AS anew FROM e WINDOW w AS (PARTITION BY pattern ORDER BY millis)),
s AS (SELECT *, sum(anew) OVER (PARTITION BY pattern ORDER BY millis ROWS UNBOUNDED PRECEDING) AS life FROM g)
SELECT pattern, millis, sum(CASE WHEN is_add THEN 1 ELSE -1 END) OVER (PARTITION BY pattern, life ORDER BY millis ROWS UNBOUNDED PRECEDING)::BIGINT AS cnt FROM s""")
def idle_patterns(spark, d):
    """Events of some weeks in four steps that overlap by a week, so by less than the lateness; a record of the far future ends them."""
    rows = table(spark, d, "events").select(F.concat("event_type", F.lit(":"), "user_id").alias("pattern"), (F.col("event_id") % 5 != 0).alias("is_add"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    bounds = rows.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    place = lambda t: F.unix_millis(t)
    week = 7 * 86_400_000
    shifted = place(F.col("ts")) - place(F.col("first")) + F.col("event_id") % 2 * week  # odd records come a week late
    step = F.least(F.floor(shifted * STEPS / (place(F.col("last")) - place(F.col("first")) + week + 1)), F.lit(STEPS - 1)).cast("long")
    rows = rows.crossJoin(F.broadcast(bounds)).select("pattern", "is_add", "ts", step.alias("step"))
    end = bounds.select(F.lit("").alias("pattern"), F.lit(True).alias("is_add"), (F.col("last") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit(STEPS - 1).cast("long").alias("step"))
    out = replay(spark, rows.unionByName(end), lambda s: stateful.idle_patterns(s, 3_600_000, _LATENESS))
    return out.filter("pattern <> ''")


_ARRIVED = "SELECT l_orderkey AS frame, l_linenumber AS patch, l_suppkey % 5 AS logo, l_partkey AS parent, l_shipdate AS seen FROM lineitem"


@query(f"""SELECT 'patch' AS kind, frame, patch::BIGINT AS patch, o_orderpriority AS image, NULL::BIGINT AS logo, NULL::BIGINT AS parent FROM ({_ARRIVED}) JOIN orders ON frame = o_orderkey WHERE o_orderkey % 10 <> 0
UNION ALL SELECT 'update', frame, (patch % 3)::BIGINT, any_value(o_orderpriority), arg_min(logo, (seen, logo, parent)), arg_min(parent, (seen, logo, parent)) FROM ({_ARRIVED}) JOIN orders ON frame = o_orderkey WHERE o_orderkey % 10 <> 0 GROUP BY frame, patch % 3""")
def stream_three_way(spark, d):
    """Orders as frames (one in ten lost, each sent twice), their lines as patches and updates, in three steps that mix all; a row of the far future ends them."""
    none = lambda kind: F.lit(None).cast(kind)
    at = F.lit(1_700_000_000).cast("timestamp")
    orders = table(spark, d, "orders").filter(F.col("o_orderkey") % 10 != 0)
    frame = orders.select(F.lit("frame").alias("kind"), F.col("o_orderkey").alias("frame"), none("long").alias("patch"), F.col("o_orderpriority").alias("image"), none("long").alias("at"), none("long").alias("logo"), none("long").alias("parent"), at.alias("ts"))
    lines = table(spark, d, "lineitem")
    line = lambda kind, patch: lines.select(F.lit(kind).alias("kind"), F.col("l_orderkey").alias("frame"), patch.cast("long").alias("patch"), none("string").alias("image"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("at"), (F.col("l_suppkey") % 5).alias("logo"), F.col("l_partkey").alias("parent"), at.alias("ts"))
    number = F.col("l_linenumber")
    rows = frame.withColumn("step", F.col("frame") % 3).unionByName(frame.withColumn("step", (F.col("frame") + 1) % 3))
    rows = rows.unionByName(line("patch", number).withColumn("step", (F.col("frame") + F.col("patch")) % 3)).unionByName(line("update", number % 3).withColumn("step", F.col("parent") % 3))
    end = spark.range(1).select(F.lit("frame").alias("kind"), F.lit(-1).cast("long").alias("frame"), none("long").alias("patch"), F.lit("").alias("image"), none("long").alias("at"), none("long").alias("logo"), none("long").alias("parent"), F.lit(1_800_000_000).cast("timestamp").alias("ts"), F.lit(2).cast("long").alias("step"))
    return replay(spark, rows.unionByName(end), lambda s: stateful.three_way(s, 3_600_000, "1 hour"), steps=3, tasks=4 * spark.sparkContext.defaultParallelism)


# --- the optimisation loop ----------------------------------------------------------------

_LOOP_SOURCE, _LOOP_TASKS, _LOOP_ALLOWED = "view", 12, 60
_LOOP_TASK = "(user_id % 12)"
_LOOP_LINES = f"""t AS (SELECT event_id % 3 AS step, event_type AS c, {_LOOP_TASK} AS task, count(value) AS n, round(sum(value), 2) AS total, count(*) AS recv, count(*) FILTER (WHERE event_id % 2 = 0) AS send FROM events GROUP BY ALL),
d AS (SELECT step, ceil(1.25 * max(total))::BIGINT AS dur FROM t GROUP BY step),
a AS (SELECT step, c, sum(n) AS n, sum(total) AS total, sum(recv) AS recv, sum(send) AS send, any_value(dur) AS dur FROM t JOIN d USING (step) GROUP BY step, c)"""


def _loop_step(step: int, k: str) -> str:
    """SQL of the best allocation that step finds, given the running one."""
    nodes = f"""SELECT c AS comp, recv * 1000.0::DOUBLE / (dur * k) * k AS lam, 1000.0::DOUBLE * n / total AS mu,
  recv * 1000.0::DOUBLE / (dur * k) * k / (SELECT send * 1000.0::DOUBLE / (dur * 2) * 2 / 2.0 FROM a WHERE step = {step} AND c = '{_LOOP_SOURCE}') AS ratio
  FROM a JOIN {k} ON comp = c WHERE step = {step} AND c <> '{_LOOP_SOURCE}'"""
    return f"""(WITH {_GAINS.replace(f"n AS ({_NODES})", f"n AS ({nodes})")},
o AS (SELECT comp, count(*) AS extra FROM r, need WHERE place <= {_LOOP_ALLOWED} - 2 - need GROUP BY comp)
SELECT m.comp, least(CASE WHEN need <= {_LOOP_ALLOWED} - 2 THEN low + coalesce(extra, 0) ELSE k END, {_LOOP_TASKS})::BIGINT AS k FROM m JOIN {k} USING (comp) LEFT JOIN o USING (comp), need)"""


@query(f"""WITH {_LOOP_LINES}, k0 AS (SELECT DISTINCT c AS comp, 3::BIGINT AS k FROM a WHERE c <> '{_LOOP_SOURCE}'),
k1 AS {_loop_step(0, "k0")}, k2 AS {_loop_step(2, "k1")}
SELECT 0::BIGINT AS step, comp, k0.k AS k_now, k1.k AS k_new FROM k0 JOIN k1 USING (comp) WHERE k0.k <> k1.k
UNION ALL SELECT 2, comp, k1.k, k2.k FROM k1 JOIN k2 USING (comp) WHERE k1.k <> k2.k""")
def control_loop(spark, d):
    """Metric lines of three intervals: the first one's decision, a discarded interval, and the decision under the new allocation.

    Executions are the events' values as milliseconds; an interval lasts a quarter longer than the busiest task was busy.
    """
    tasks = table(spark, d, "events").groupBy((F.col("event_id") % 3).alias("step"), F.col("event_type").alias("component"), (F.col("user_id") % _LOOP_TASKS).alias("task"))
    tasks = tasks.agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.sum(F.col("value") * F.col("value")), 2).alias("sumsq"), F.count("*").alias("recv"), F.count_if(F.col("event_id") % 2 == 0).alias("send"))
    lasts = tasks.groupBy("step").agg(F.ceil(1.25 * F.max("total")).cast("long").alias("dur"))
    stat = F.concat_ws(",", F.col("n").cast("string"), F.format_string("%.2f", "total"), F.format_string("%.2f", "sumsq"))
    queue = lambda c: F.struct(F.col(c).alias("totalCount"), F.col(c).alias("sampleCount"), F.lit(0).alias("totalQueueLen"))
    source = F.col("component") == _LOOP_SOURCE
    named = F.struct(F.when(source, F.create_map(F.lit("default"), stat)).alias("complete-latency"), F.when(~source, F.create_map(F.lit(f"{_LOOP_SOURCE}:default"), stat)).alias("execute"), queue("send").alias("send-queue"), queue("recv").alias("recv-queue"), F.col("dur").alias("duration"))
    lines = tasks.join(lasts, "step").select("step", F.concat("component", F.lit(":"), F.col("task").cast("string"), F.lit("->"), F.to_json(named)).alias("line"))
    k = F.when(F.col("event_type") == _LOOP_SOURCE, 2).otherwise(3).cast("long")
    alloc = table(spark, d, "events").select("event_type").distinct().select(F.col("event_type").alias("comp"), k.alias("k"))
    base = f"{shared_dir(spark)}/loop-{uuid.uuid4().hex}"
    loop = Loop(base, alloc, [_LOOP_SOURCE], _LOOP_TASKS, Scheduling(qos_ms=800.0, allowed=_LOOP_ALLOWED))
    lines = staged(lines)
    for i in range(3):
        lines.filter(F.col("step") == i).select("line").write.mode("append").parquet(f"{base}/in")
        loop.run(spark.readStream.schema("line string").parquet(f"{base}/in")).awaitTermination()
    return loop.moves(spark)


# --- queue and lines ----------------------------------------------------------------------


@query("SELECT user_id::VARCHAR AS key, count(*) AS cnt FROM events GROUP BY 1")
def queue_records(spark, d):
    """Events as lines of growing files, read in small ranges over three batches and written by the sink; users counted from what it has committed."""
    base = f"{shared_dir(spark)}/queue-{uuid.uuid4().hex}"
    lines = table(spark, d, "events").select((F.col("event_id") % 3).alias("step"), F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("value"))
    lines = staged(lines)
    for i in range(3):
        lines.filter(F.col("step") == i).select("value").write.mode("append").text(f"{base}/in")
        out = queue.queue(spark, f"{base}/in", 1 << 16).select(F.get_json_object("text", "$.user_id").alias("key"), F.get_json_object("text", "$.event_id").alias("event"))
        queue.to_lines(out, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    rows = queue.committed(spark, f"{base}/out")
    return rows.groupBy(F.get_json_object("value", "$.key").alias("key")).agg(F.countDistinct(F.get_json_object("value", "$.event")).alias("cnt"))


@query()
def stream_templates(spark, d):
    """Lines as events of their suppliers' pools of four templates: a third add, a third hit, a third search. Its order is a replay, beyond SQL; tests compare with one."""
    at = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    kind = F.element_at(F.array(F.lit("add"), F.lit("hit"), F.lit("scan")), (at % 3 + 1).cast("int"))
    events = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("logo"), at.alias("at"), kind.alias("kind"), (F.col("l_partkey") % 20).alias("template"), F.col("l_quantity").cast("long").alias("value"))
    last = events.agg(F.max("at").alias("_last"))
    events = events.crossJoin(F.broadcast(last)).withColumn("step", F.least(F.floor(F.col("at") * STEPS / F.col("_last")), F.lit(STEPS - 1)).cast("long")).drop("_last")
    return replay(spark, events, lambda s: stateful.template_pool(s, 4))
