"""Registered queries of the control loop, sources, images and streams, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalog import _DERIVED, _GAINS, _HOURLY, _MOMENTS, _NODES, _RAW, _T, _rounded, nodes, query, table
from .config import Scheduling
from .functions.ordering import numbered, shared_dir
from .operators import control, frames, matching, metrics, patterns, queueing, text, vision
from .sources import readers
from .streaming import loop, state
from .streaming import queries as streaming

# --- measurements -----------------------------------------------------------------

_TASK_QUEUES = """SELECT event_type AS component, (user_id % 12)::INT AS task, count(*) FILTER (WHERE event_id % 2 = 0) AS send_total, count(*) FILTER (WHERE event_id % 4 = 0) AS send_samples,
sum(user_id % 7) AS send_len, count(*) FILTER (WHERE event_id % 3 <> 0) AS recv_total, count(*) FILTER (WHERE event_id % 6 = 1) AS recv_samples, sum(user_id % 11) AS recv_len, count(*) * 10 AS duration,
date_trunc('hour', ts) AS hour FROM events GROUP BY ALL"""


def _task_queues(spark, d):
    n = lambda c: F.count_if(c)
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("component"), (u % 12).cast("int").alias("task"), F.date_trunc("hour", "ts").alias("hour")).agg(
        n(e % 2 == 0).alias("send_total"), n(e % 4 == 0).alias("send_samples"), F.sum(u % 7).alias("send_len"),
        n(e % 3 != 0).alias("recv_total"), n(e % 6 == 1).alias("recv_samples"), F.sum(u % 11).alias("recv_len"), (F.count("*") * 10).alias("duration"))


def _executors(df, each: int = 4, n: int = 3):
    ranges = [F.struct(F.lit(i).alias("executor"), F.lit(each * i).alias("start_task"), F.lit(each * i + each - 1).alias("end_task")) for i in range(n)]
    return df.select("component").distinct().select("component", F.explode(F.array(*ranges)).alias("_e")).select("component", "_e.*")


@query(f"""WITH t AS ({_TASK_QUEUES}), s AS (SELECT component, (task // 4)::INT AS executor,
{", ".join(f"coalesce(sum({q}_{c}) FILTER (WHERE {q}_total > 0), 0) AS {q}_{c}" for q in ("send", "recv") for c in ("total", "samples", "len"))}, coalesce(sum(duration) FILTER (WHERE task % 4 = 0), 0) AS duration FROM t GROUP BY ALL)
SELECT component, executor, {", ".join(f"{q}_total::BIGINT AS {q}_total, CASE WHEN {q}_samples > 0 THEN round({q}_len / {q}_samples, 6) ELSE 0 END AS {q}_avg" for q in ("send", "recv"))}, duration::BIGINT AS duration,
CASE WHEN duration > 0 THEN round(recv_total * 1000.0 / duration, 6) END AS arrival_rate, CASE WHEN duration > 0 THEN round(send_total * 1000.0 / duration, 6) END AS departure_rate FROM s""")
def executor_queues(spark, d):
    tasks = _task_queues(spark, d)
    out = control.queue_lengths_and_rates(control.queue_rollup(tasks, _executors(tasks)))
    return _rounded(out, send_avg=6, recv_avg=6, arrival_rate=6, departure_rate=6).select("component", "executor", "send_total", "send_avg", "recv_total", "recv_avg", "duration", "arrival_rate", "departure_rate")


@query("SELECT event_type, user_id % 3 AS stream, count(*) AS emitted FROM events WHERE event_id % 20 = 0 GROUP BY ALL")
def emit_count(spark, d):
    rows = table(spark, d, "events").withColumn("stream", F.col("user_id") % 3)
    return control.emit_counts(rows, ["event_type", "stream"], F.col("event_id") % 20 == 0)


@query("""WITH e AS (SELECT event_type, value, event_id % 9 = 0 AS failed FROM events)
SELECT event_type, len(list_filter([10.0, 20.0, 50.0, 100.0], lambda x: x < value))::BIGINT AS bucket, count(*) AS cnt, any_value(fails) AS fails
FROM e JOIN (SELECT event_type, count(*) FILTER (WHERE failed) AS fails FROM e GROUP BY 1) USING (event_type) WHERE NOT failed AND value IS NOT NULL GROUP BY ALL""")
def fail_hist(spark, d):
    rows = table(spark, d, "events").withColumn("failed", F.col("event_id") % 9 == 0)
    return control.failure_histogram(rows, "event_type", "value", "failed", [10.0, 20.0, 50.0, 100.0])


@query("SELECT event_type, (epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000) AS duration, round(count(value) * 1000.0 / (((epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000)) * 0.05), 9) AS complete_rate FROM events GROUP BY 1")
def complete_rate(spark, d):
    events = table(spark, d, "events")
    counts = events.groupBy("event_type").agg(F.count("value").alias("cnt"))
    both = control.duration(events, "event_type", "ts").join(counts, "event_type")
    return both.select("event_type", "duration", F.round(control.completion_rate(F.col("cnt"), F.col("duration"), 0.05), 9).alias("complete_rate"))


@query(f"SELECT event_type, cnt, {_DERIVED} FROM (SELECT event_type, sum(cnt)::BIGINT AS cnt, sum(total) AS total, sum(sumsq) AS sumsq FROM ({_HOURLY}) WHERE cnt > 1 GROUP BY 1)")
def moments_rollup(spark, d):
    hourly = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(*metrics.moments(F.col("value")))
    out = metrics.derived(control.moments_rollup(hourly.withColumn("cnt", F.when(F.col("cnt") > 1, F.col("cnt")).otherwise(0)), "event_type"))
    return _rounded(out, avg=6, var=4, scv=6).select("event_type", "cnt", "avg", "var", "scv")


@query("SELECT greatest((epoch_us(ts) // 1000 - 1704067200000) // 30000 - 1, 0) AS step, event_type, count(*) AS cnt FROM events GROUP BY ALL")
def optimise_steps(spark, d):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").groupBy(control.optimise_step(millis, 1_704_067_200_000, Scheduling().interval_s).alias("step"), "event_type").agg(F.count("*").alias("cnt"))


@query("SELECT sum(l_extendedprice)::DOUBLE AS total, round(avg(l_extendedprice), 6) AS mean, max(l_extendedprice) AS most FROM lineitem")
def task_costs(spark, d):
    return _rounded(control.task_costs(table(spark, d, "lineitem"), "l_extendedprice"), mean=6)


@query("SELECT component, 3::BIGINT AS executors, '0,1,2,3,4,5,6,7,8,9,10,11' AS tasks FROM (SELECT DISTINCT event_type AS component FROM events)")
def component_tasks(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("component"))
    return control.component_tasks(_executors(rows)).withColumn("tasks", F.array_join(F.transform("tasks", lambda t: t.cast("string")), ","))


@query("SELECT component, executor, row_number() OVER (ORDER BY start_task, component, executor) AS place FROM (SELECT DISTINCT event_type AS component FROM events), (SELECT e AS executor, 4 * e AS start_task FROM range(0, 3) AS r(e))")
def executor_order(spark, d):
    ordered = control.ordered_executors(_executors(table(spark, d, "events").select(F.col("event_type").alias("component"))))
    placed = numbered(ordered, ["start_task", "component", "executor"], "_i")
    return placed.select("component", F.col("executor").cast("long").alias("executor"), (F.col("_i") + 1).alias("place"))


# --- model to decision ----------------------------------------------------------------


@query(f"""WITH {_GAINS.replace("* ratio AS t FROM k", "AS t FROM k")}, x AS (SELECT comp, count(*) AS extra FROM r, need WHERE place <= 200 - need GROUP BY comp)
SELECT comp, CASE WHEN need <= 200 THEN low + coalesce(extra, 0) END::BIGINT AS k FROM m LEFT JOIN x USING (comp), need""")
def suggest_chain(spark, d):
    return queueing.suggest(nodes(spark, d), 200, chain=True)


@query(f"""WITH {_GAINS.replace("* ratio AS t FROM k", "AS t FROM k")},
c AS (SELECT place, sum(gain) OVER (ORDER BY place) AS saved FROM r UNION ALL SELECT 0, 0),
f AS (SELECT min(place) AS n FROM c, need WHERE (start_ - saved) * 1.1 <= 0.9 AND (SELECT sum(1 / mu) FROM m) * 1.1 < 0.9), x AS (SELECT comp, count(*) AS extra FROM r, f WHERE place <= n GROUP BY comp)
SELECT comp, CASE WHEN n IS NOT NULL THEN low + coalesce(extra, 0) END::BIGINT AS k, CASE WHEN n IS NOT NULL THEN 'FEASIBLE' ELSE 'INFEASIBLE' END AS status FROM m LEFT JOIN x USING (comp), f""")
def least_chain(spark, d):
    return queueing.least_for(nodes(spark, d), 0.9, None, 1.1, chain=True)


@query(f"""SELECT (floor(sum(low) / 7) + (sum(low) % 7 > 3)::INT)::BIGINT AS workers, sum(low)::BIGINT AS executors FROM (SELECT floor(lam / mu)::BIGINT + 1 AS low FROM ({_NODES}))""")
def worker_count_half(spark, d):
    return control.workers_by_half(nodes(spark, d).select("comp", queueing.minimum(F.col("lam"), F.col("mu")).alias("k")), 7)


_SETTINGS = Scheduling(qos_ms=800.0, history=4, allowed=40)


def _results(spark, d):
    numbers = [F.count("value").alias("cnt"), F.sum("value").alias("total"), (3 * F.count("*")).alias("send_total"), (2 * F.count("*")).alias("recv_total"), F.lit(150).alias("duration")]
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("interval"), F.col("event_type").alias("component"), (F.col("user_id") % 2).alias("executor")).agg(*numbers)


def _alloc(spark, d, sources):
    return table(spark, d, "events").select(F.col("event_type").alias("comp")).distinct().select("comp", F.when(F.col("comp").isin(sources), 2).otherwise(3).cast("long").alias("k"))


def _measured(sources: str, chain: bool) -> str:
    real = "avg(total / cnt)" if chain else "any_value(total / cnt)"
    nodes_ = f"""SELECT c AS comp, recv_total * 1000.0::DOUBLE / duration * 3 AS lam, 1000.0::DOUBLE * cnt / total AS mu, {"1.0::DOUBLE" if chain else "recv_total * 1000.0::DOUBLE / duration * 3 / leave"} AS ratio FROM mm, src WHERE c NOT IN {sources}"""
    return f"""rr AS (SELECT date_trunc('hour', ts) AS h, event_type AS c, user_id % 2 AS ex, count(value) AS cnt, sum(value) AS total, 3 * count(*) AS send_total, 2 * count(*) AS recv_total, 150 AS duration FROM events GROUP BY ALL),
mm AS (SELECT c, sum(cnt) AS cnt, sum(total) AS total, sum(send_total) AS send_total, sum(recv_total) AS recv_total, sum(duration) AS duration
  FROM (SELECT *, dense_rank() OVER (PARTITION BY c ORDER BY h DESC) AS place FROM rr) WHERE place <= 4 GROUP BY c),
src AS (SELECT {real} AS real_ms, sum(send_total * 1000.0::DOUBLE / duration * 2 / 2.0) AS leave FROM mm WHERE c IN {sources}),
{_GAINS.replace(f"n AS ({_NODES})", f"n AS ({nodes_})")}, most AS (SELECT 40 - 2 * (SELECT count(*) FROM mm WHERE c IN {sources}) AS most),
e AS (SELECT CASE WHEN count(*) = (SELECT count(*) FROM n) THEN sum(t) END AS est FROM t WHERE k = 3),
sc AS (SELECT est, greatest(1.0, coalesce(real_ms / (est * 1000), 1.0)) AS factor FROM e, src),
c AS (SELECT place, sum(gain) OVER (ORDER BY place) AS saved FROM r UNION ALL SELECT 0, 0),
f AS (SELECT min(place) AS n FROM c, need, sc, most WHERE (start_ - saved) * factor <= 0.8 AND need + place <= 2 * most AND (SELECT sum(ratio / mu) FROM m) * factor < 0.8),
x AS (SELECT comp, count(*) AS extra FROM r, f WHERE place <= n GROUP BY comp), o AS (SELECT comp, count(*) AS extra FROM r, need, most WHERE place <= most - need GROUP BY comp),
res AS (SELECT comp, 3::BIGINT AS k_now, CASE WHEN f.n IS NOT NULL THEN low + coalesce(x.extra, 0) END::BIGINT AS k_min, CASE WHEN need <= most THEN low + coalesce(o.extra, 0) END::BIGINT AS k_opt,
CASE WHEN f.n IS NOT NULL THEN 'FEASIBLE' ELSE 'INFEASIBLE' END AS status, round(est * 1000, 6) AS est_ms, round(factor, 9) AS ratio FROM m LEFT JOIN x USING (comp) LEFT JOIN o USING (comp), f, need, sc, most)"""


@query(f"WITH {_measured("('view')", False)} SELECT * FROM res")
def alloc_calc(spark, d):
    out = control.CALCULATORS.get("general")(_results(spark, d), _alloc(spark, d, ["view"]), ["view"], 40, _SETTINGS)
    return _rounded(out, est_ms=6, ratio=9)


@query(f"WITH {_measured("('click', 'view')", True)} SELECT * FROM res")
def alloc_calc_chain(spark, d):
    sources = ["click", "view"]
    out = control.CALCULATORS.get("chain")(_results(spark, d), _alloc(spark, d, sources), sources, 40, _SETTINGS)
    return _rounded(out, est_ms=6, ratio=9)


@query(f"WITH {_measured("('view')", False)} SELECT comp, k_now, k_opt AS k_new FROM res WHERE k_opt <> k_now")
def rebalance(spark, d):
    return control.rebalance(_results(spark, d), _alloc(spark, d, ["view"]), ["view"], _SETTINGS).select("comp", "k_now", "k_new")


@query("SELECT DISTINCT event_type AS comp, 3::BIGINT AS k_now, 5::BIGINT AS k_new FROM events WHERE event_type = 'signup'")
def rebalance_once(spark, d):
    return control.rebalance(_results(spark, d), _alloc(spark, d, ["view"]), ["view"], _SETTINGS, decision=control.once({"signup": 5}), elapsed=301.0).select("comp", "k_now", "k_new")


@query("SELECT greatest(2, ceil(sum(k) / 8))::BIGINT * 8 AS budget FROM (SELECT user_id, 1 + count(*) % 5 AS k FROM events GROUP BY user_id)")
def executor_budget(spark, d):
    """Users as components, of one to five executors."""
    alloc = table(spark, d, "events").groupBy(F.col("user_id").alias("comp")).agg((1 + F.count("*") % 5).alias("k"))
    return control.executor_budget(alloc, Scheduling(), 2)


@query("""WITH e AS (SELECT event_type AS component, user_id % 12 AS task, (event_id % 3)::VARCHAR AS source, (event_id % 2)::VARCHAR AS stream, count(value) FILTER (WHERE event_id % 7 <> 0) AS n, round(coalesce(sum(value) FILTER (WHERE event_id % 7 <> 0), 0), 2) AS total FROM events GROUP BY ALL)
SELECT component, source, stream, sum(n)::BIGINT AS cnt, round(sum(total), 2) AS total, count(*) AS tasks FROM e WHERE n > 0 GROUP BY ALL""")
def execute_streams(spark, d):
    """Executions by the source and the stream that they came from, out of metric lines; entries without a count are left out."""
    used = F.col("event_id") % 7 != 0
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("component"), (F.col("user_id") % 12).alias("task"), (F.col("event_id") % 3).alias("source"), (F.col("event_id") % 2).alias("stream"))
    rows = rows.agg(F.count(F.when(used, F.col("value"))).alias("n"), F.coalesce(F.sum(F.when(used, F.col("value"))), F.lit(0.0)).alias("total"))
    entry = F.struct(F.concat_ws(":", F.col("source").cast("string"), F.col("stream").cast("string")).alias("key"), F.concat(F.col("n").cast("string"), F.format_string(",%.2f,0", "total")).alias("value"))
    tasks = rows.groupBy("component", "task").agg(F.map_from_entries(F.collect_list(entry)).alias("execute"))
    lines = tasks.select(F.concat("component", F.lit(":"), F.col("task").cast("string"), F.lit("->"), F.to_json(F.struct("execute"))).alias("line"))
    out = loop.execute_moments(lines).groupBy("component", "source", "stream").agg(F.sum("cnt").alias("cnt"), F.round(F.sum("total"), 2).alias("total"), F.count("*").alias("tasks"))
    return out


# --- images -----------------------------------------------------------------------------

_POINTS = "SELECT s_nationkey AS g, s_acctbal::DOUBLE AS px, (s_suppkey * 37 % 101)::DOUBLE AS py FROM supplier"


@query(f"""WITH p AS ({_POINTS}), s AS (SELECT g, ceil(count(*) * 0.8) AS need FROM p GROUP BY g),
e AS (SELECT a.g, a.px AS x0, b.px AS x1 FROM p a JOIN p b ON a.g = b.g AND a.px <= b.px GROUP BY ALL),
v AS (SELECT a.g, a.py AS y0, b.py AS y1 FROM p a JOIN p b ON a.g = b.g AND a.py <= b.py GROUP BY ALL),
c AS (SELECT g, x0, x1, y0, y1 FROM e JOIN v USING (g) JOIN p USING (g) JOIN s USING (g) WHERE px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 GROUP BY ALL HAVING count(*) >= any_value(need))
SELECT g, round(x0, 6) AS x, round(y0, 6) AS y, round(x1 - x0, 6) AS width, round(y1 - y0, 6) AS height FROM c QUALIFY row_number() OVER (PARTITION BY g ORDER BY (x1 - x0) * (y1 - y0), x0, y0, x1, y1) = 1""")
def bounding_box(spark, d):
    points = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_acctbal").cast("double").alias("px"), (F.col("s_suppkey") * 37 % 101).cast("double").alias("py"))
    return _rounded(vision.boxes(points, ["g"], 0.8), x=6, y=6, width=6, height=6)


_LINES = "SELECT l_orderkey AS frame, l_linenumber AS patch, l_suppkey % 5 AS logo, l_partkey AS parent, l_shipdate AS seen FROM lineitem"


def _line_rows(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("patch"), (F.col("l_suppkey") % 5).alias("logo"), F.col("l_partkey").alias("parent"), F.col("l_shipdate").alias("at"))


def _three(spark, d):
    images = table(spark, d, "orders").filter(F.col("o_orderkey") % 3 != 0).select(F.col("o_orderkey").alias("frame"), F.col("o_orderpriority").alias("image"))
    rows = _line_rows(spark, d)
    updates = rows.select(F.col("frame").alias("host_frame"), (F.col("patch") % 3).alias("host_patch"), "at", "logo", "parent")
    return frames.three_way(images.unionByName(images), rows.select("frame", "patch"), updates)


@query(f"SELECT frame, patch, o_orderpriority AS image FROM ({_LINES}) JOIN orders ON frame = o_orderkey WHERE o_orderkey % 3 <> 0")
def three_way_patches(spark, d):
    return _three(spark, d)[0].select("frame", "patch", "image")


@query(f"""SELECT frame AS host_frame, patch % 3 AS host_patch, arg_min(logo, (seen, logo, parent)) AS logo, arg_min(parent, (seen, logo, parent)) AS parent, any_value(o_orderpriority) AS image
FROM ({_LINES}) JOIN orders ON frame = o_orderkey WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2""")
def three_way_updates(spark, d):
    return _three(spark, d)[1].select("host_frame", "host_patch", "logo", "parent", "image")


_TRIES = "SELECT l_orderkey AS patch, l_suppkey % 4 AS logo, l_linenumber AS template, CASE WHEN l_linenumber > 1 THEN (l_partkey % 10) END AS priority, CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS rect FROM lineitem"


@query(f"""SELECT patch, logo, coalesce(arg_min(template, (priority IS NOT NULL, -coalesce(priority, 0), template, rect)) FILTER (WHERE rect IS NOT NULL), -1)::BIGINT AS template,
coalesce(arg_min(rect, (priority IS NOT NULL, -coalesce(priority, 0), template, rect)) FILTER (WHERE rect IS NOT NULL), -1)::BIGINT AS rect FROM ({_TRIES}) GROUP BY ALL""")
def first_match(spark, d):
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    tries = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("patch"), (F.col("l_suppkey") % 4).alias("logo"), line.alias("template"), F.when(line > 1, part % 10).alias("priority"), F.when(part % 3 == 0, part).alias("rect"))
    return matching.first_match(tries).select("patch", "logo", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("template", "rect")])


@query("""WITH p AS (SELECT p_size AS logo, p_partkey AS template, p_partkey % 5 AS priority FROM part WHERE p_partkey % 2 = 0),
h AS (SELECT l_partkey AS template, count(*) AS hits FROM lineitem GROUP BY 1),
u AS (SELECT logo, template, priority + coalesce(hits, 0) AS priority FROM p LEFT JOIN h USING (template) UNION ALL SELECT p_size, p_partkey, 0 FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 <> 0)
SELECT logo, template, priority::BIGINT AS priority FROM u QUALIFY row_number() OVER (PARTITION BY logo ORDER BY priority DESC, template) <= 6""")
def template_update(spark, d):
    parts = table(spark, d, "part").select(F.col("p_size").alias("logo"), F.col("p_partkey").alias("template"))
    pool = parts.filter(F.col("template") % 2 == 0).withColumn("priority", F.col("template") % 5)
    hits = table(spark, d, "lineitem").select(F.col("l_partkey").alias("template")).join(parts, "template")
    return matching.update_pool(pool, hits, parts.filter(F.col("template") % 3 == 0), 6)


@query("SELECT o_orderkey AS frame, (o_orderkey // 7)::BIGINT AS sample_id FROM orders WHERE o_orderkey >= 100 AND o_orderkey % 7 = 0")
def frame_sample(spark, d):
    return frames.sample(table(spark, d, "orders").select(F.col("o_orderkey").alias("frame")), 7, 100)


# --- sources ------------------------------------------------------------------------------


def _placed(spark, d):
    return numbered(table(spark, d, "events").select("event_id"), ["event_id"], "place")


@query("""WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events), t AS (SELECT txid, sum(txid * 13 % 7 + 1) OVER (ORDER BY txid) AS upto, txid * 13 % 7 + 1 AS n FROM range(1, 100001) AS r(txid))
SELECT txid, any_value(n)::BIGINT AS n, count(*) AS records FROM e JOIN t ON place >= upto - n AND place < upto GROUP BY txid""")
def bounded_batches(spark, d):
    rows = readers.batches(_placed(spark, d), "place", 7)
    return rows.groupBy("txid").agg(F.count("*").alias("records")).select("txid", (F.col("txid") * 13 % 7 + 1).alias("n"), "records")


@query("SELECT event_id, txid, txid % 5 AS task FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS txid FROM events)")
def one_per_batch(spark, d):
    return readers.one_per_batch(_placed(spark, d), "place", 5).drop("place")


@query("SELECT event_id, ((place - 120) // 50)::BIGINT AS page FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events) WHERE place >= 120 AND place < 120 + 333")
def range_scan(spark, d):
    return readers.scan(_placed(spark, d), "place", 120, 333, 50).select("event_id", "page")


@query("SELECT conv_id, turn, length(text) * 10::BIGINT AS n FROM conversations")
def repeated_text(spark, d):
    return readers.repeated(table(spark, d, "conversations"), "text", 10).select("conv_id", "turn", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id, greatest(1, ceil(octet_length(encode(text)) / 1000.0))::BIGINT AS chunks, md5(text) AS whole FROM documents WHERE text IS NOT NULL")
def chunk_round_trip(spark, d):
    cut = readers.chunked(table(spark, d, "documents").filter("text is not null"), "doc_id", "text", 1000)
    whole = readers.joined_chunks(cut, "doc_id", "index", "text").select("doc_id", F.md5("text").alias("whole"))
    return cut.groupBy("doc_id").agg(F.count("*").alias("chunks")).join(whole, "doc_id")


@query("SELECT vec_id AS id, list_sum([x FOR x IN list_transform(embedding, lambda v: round(v * 100)::INT)])::BIGINT AS total, label AS image FROM embeddings")
def feature_index(spark, d):
    numbers = F.array_join(F.transform("embedding", lambda v: F.round(v * F.lit(100).cast("float")).cast("int").cast("string")), ",")
    lines = table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.concat(numbers, F.lit(" "), F.col("label").cast("string")).alias("line"))
    found = readers.feature_lines(lines.unionByName(lines.select(F.lit(-1).cast("long").alias("n"), F.lit("1,2 x").alias("line"))), 64)
    return found.select("id", F.aggregate("feat", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("images")[0].alias("image"))


@query("""SELECT stage, count(*) AS n, round(sum(ms), 3) AS total FROM (SELECT stage, least(-ln(1 - ('0x' || substr(md5(conv_id || '-' || turn || '~' || stage), 1, 8))::BIGINT / 4294967296.0) * mean, mean * 10) AS ms
FROM conversations, (VALUES (0, 1.0::DOUBLE), (1, 2.0::DOUBLE), (2, 3.0::DOUBLE), (3, 2.0::DOUBLE)) AS s(stage, mean)) GROUP BY stage""")
def simulated_stages(spark, d):
    rows, key, out = table(spark, d, "conversations").select("conv_id", "turn"), F.concat_ws("-", "conv_id", "turn"), None
    for i, mean in enumerate((1.0, 2.0, 3.0, 2.0)):
        stage = readers.service_times(rows, key, mean, i).select(F.lit(i).alias("stage"), "service_ms")
        out = stage if out is None else out.unionByName(stage)
    return out.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.sum("service_ms"), 3).alias("total"))


@query("SELECT event_type AS sig_type, epoch_ms(day) AS since_ms, coalesce(epoch_ms(lead(day) OVER (ORDER BY day, event_type)), -1) AS until_ms FROM (SELECT event_type, date_trunc('day', ts) AS day FROM events WHERE event_type IN ('error', 'signup') GROUP BY ALL)")
def control_signals(spark, d):
    days = table(spark, d, "events").filter("event_type in ('error', 'signup')").select("event_type", F.date_trunc("day", "ts").alias("day")).distinct()
    out = readers.signals(days, "event_type", "day")
    return out.select("sig_type", *[F.coalesce(F.unix_millis(F.col(c).cast("timestamp")), F.lit(-1)).alias(f"{c}_ms") for c in ("since", "until")])


@query("""WITH p AS (SELECT p_brand AS pattern, sum(CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) AS b FROM part GROUP BY 1)
SELECT pattern, b >= 20 AS appeared FROM p WHERE (a >= 20) <> (b >= 20)""")
def pattern_changes(spark, d):
    parts = table(spark, d, "part").select(F.col("p_brand").alias("pattern"), "p_partkey")
    shot = lambda n: parts.filter(F.col("p_partkey") % n == 0).groupBy("pattern").count().filter("count >= 20")
    return patterns.changes(shot(4), shot(3))


# --- streams ------------------------------------------------------------------------------


def _stream(spark, d, name):
    """A table as a stream; it is a folder of files, or one file in the folder of all tables."""
    rows, path = table(spark, d, name), f"{d}/{name}.parquet"
    if any(f.endswith(f"/{name}.parquet") for f in rows.inputFiles()):
        return spark.readStream.schema(rows.schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return streaming.read_folder(spark, path, rows.schema)


def _run(spark, stream, mode: str = "append"):
    """All that a stream gives, written as a table in the shared folder; for `complete`, what the last batch gave."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(stream.columns)


@query(f"SELECT word, count(*) AS cnt FROM ({_RAW.replace('conv_id, turn, ', '')}) WHERE word <> '' GROUP BY word")
def stream_word_count(spark, d):
    words = text.split_words(_stream(spark, d, "conversations").select("text"), clean=False)
    return _run(spark, words.groupBy("word").agg(F.count("*").alias("cnt")), "complete")


@query(f"SELECT epoch_ms(time_bucket(INTERVAL 1 hour, ts)) AS start_ms, event_type, {_MOMENTS} FROM events GROUP BY ALL")
def stream_moments(spark, d):
    out = _run(spark, streaming.windowed_moments(_stream(spark, d, "events"), "ts", "event_type", "value", "1 hour"), "complete")
    return _rounded(out.withColumn("start_ms", F.unix_millis("start")).drop("start"), total=2, sumsq=1)


@query("SELECT o_orderkey AS frame, l_linenumber AS rect FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def stream_join(spark, d):
    left = _stream(spark, d, "orders").select(F.col("o_orderkey").alias("frame"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"))
    right = _stream(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("rect"), F.timestamp_seconds(F.lit(1_700_000_010)).alias("ts"))
    return _run(spark, streaming.frame_join(left, right).select("frame", "rect"))


@query("""SELECT 'drs.alloc:' || event_type || '->{"k":' || count(*) || '}' AS value FROM events GROUP BY event_type""")
def report_lines(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("component")).agg(F.count("*").alias("k"))
    return state.to_report_lines(rows, "drs.alloc")


@query(f"SELECT comp, round({_T}, 9) AS t FROM (SELECT *, (floor(lam / mu) + 1)::BIGINT AS k FROM ({_NODES}))")
def least_sojourn(spark, d):
    low = queueing.minimum(F.col("lam"), F.col("mu"))
    return nodes(spark, d).select("comp", F.round(queueing.sojourn(F.col("lam"), F.col("mu"), low), 9).alias("t"))
