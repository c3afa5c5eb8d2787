"""All registered queries of the library's own operators, with their SQL twins.

Names follow the operators; every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ordering import numbered, tiles
from .operators import frames, matching, metrics, outliers, patterns, queueing, ranges, text
from .plans import packing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- words ----------------------------------------------------------------------

_WORDS = r"SELECT unnest(string_split_regex(lower(regexp_replace(text, '\p{P}|\p{S}', ' ', 'g')), '[ \t\n\r\f]+')) AS word FROM documents"
_RAW = r"SELECT conv_id, turn, unnest(string_split_regex(text, '[ \t\n\r\f]+')) AS word FROM conversations"


def _coin(key: str, salt: int, p: float) -> str:
    return f"('0x' || substr(md5(coalesce(({key})::VARCHAR, '') || ':{salt}'), 1, 8))::BIGINT < {int(p * (1 << 32))}"


@query(f"SELECT word, count(*) AS cnt FROM ({_WORDS}) WHERE word <> '' GROUP BY word")
def word_count(spark, d):
    return text.word_count(table(spark, d, "documents"))


@query(f"SELECT count(DISTINCT word) AS n_words FROM ({_WORDS}) WHERE word <> ''")
def distinct_words(spark, d):
    return text.distinct_words(table(spark, d, "documents"))


@query(f"SELECT word, count(*) AS cnt FROM ({_RAW}) WHERE word <> '' GROUP BY word")
def word_split_raw(spark, d):
    words = text.split_words(table(spark, d, "conversations").select("conv_id", "text"), clean=False)
    return words.groupBy("word").agg(F.count("*").alias("cnt"))


@query(f"SELECT conv_id, turn, word || '!!' AS word, count(*) AS cnt FROM ({_RAW}) WHERE word <> '' GROUP BY ALL")
def word_bang(spark, d):
    words = text.bang(text.split_words(table(spark, d, "conversations").select("conv_id", "turn", "text"), clean=False))
    return words.groupBy("conv_id", "turn", "word").agg(F.count("*").alias("cnt"))


@query(f"""
WITH c AS (SELECT *, {_coin("conv_id", 0, 0.3)} AS heads FROM conversations),
u AS (SELECT 'P' AS path, conv_id, text FROM c WHERE heads UNION ALL SELECT 'NotP', conv_id, text FROM c WHERE NOT heads)
SELECT path, word || '!!' AS word, count(*) AS cnt FROM (SELECT path, unnest(string_split_regex(text, '[ \\t\\n\\r\\f]+')) AS word FROM u) WHERE word <> '' GROUP BY ALL""")
def two_path_union(spark, d):
    paths = text.two_paths(table(spark, d, "conversations"), "conv_id", 0.3)
    union = paths["P"].select(F.lit("P").alias("path"), "text").unionByName(paths["NotP"].select(F.lit("NotP").alias("path"), "text"))
    return text.bang(text.split_words(union, clean=False)).groupBy("path", "word").agg(F.count("*").alias("cnt"))


@query(f"SELECT conv_id, turn, CASE {' '.join(f'WHEN NOT {_coin("concat(conv_id, chr(45), turn)", i, 0.4)} THEN {i}' for i in range(1, 6))} ELSE 6 END::BIGINT AS passes FROM conversations")
def loop_passes(spark, d):
    key = F.concat("conv_id", F.lit("-"), "turn")
    return table(spark, d, "conversations").select("conv_id", "turn", text.loop_passes(key, 0.4, 6).alias("passes"))


@query(r"""
SELECT word, sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS cnt FROM (
SELECT doc_id, unnest(string_split_regex(lower(regexp_replace(text, '\p{P}|\p{S}', ' ', 'g')), '[ \t\n\r\f]+')) AS word FROM documents)
WHERE word <> '' GROUP BY word HAVING sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END) <> 0""")
def signed_records(spark, d):
    lines = table(spark, d, "documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-"), "text").alias("text"))
    return text.signed_word_count(lines)


# --- telemetry ------------------------------------------------------------------

_AXIS = [10.0, 20.0, 50.0, 100.0]
_MOMENTS = "count(value) AS cnt, round(sum(value), 2) AS total, round(sum(value * value), 1) AS sumsq"
_DERIVED = "CASE WHEN cnt > 0 THEN round(total / cnt, 6) ELSE 0 END AS avg, CASE WHEN cnt > 0 THEN round(sumsq / cnt - (total / cnt) ** 2, 4) ELSE 0 END AS var, CASE WHEN cnt > 0 AND total <> 0 THEN round(sumsq / cnt / (total / cnt) ** 2 - 1, 6) ELSE 0 END AS scv"


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(r"""SELECT event_type AS component, user_id AS task, (epoch_us(ts) // 1000) AS millis, props AS data FROM events
WHERE regexp_matches(event_type || ':' || user_id || ':' || (epoch_us(ts) // 1000) || '->' || props, '^([^:]+):(\d+)(?::(\d+))?->(\{.*\})$')""")
def metric_parse(spark, d):
    return metrics.parse_metric_lines(metrics.metric_lines(table(spark, d, "events")))


@query("""
SELECT CASE event_type WHEN 'click' THEN 'emit' ELSE event_type END AS name, count(*) AS cnt FROM events
WHERE event_type IN (SELECT DISTINCT event_type FROM events) AND event_type IN ('click', 'view') AND props IS NOT NULL AND props <> '' AND props <> '{}' GROUP BY ALL""")
def metric_whitelist(spark, d):
    names = spark.createDataFrame([("click", "emit"), ("view", None)], "name string, alias string")
    rows = table(spark, d, "events").select(F.col("event_type").alias("name"), F.concat(F.lit("u"), "user_id").alias("component"), F.col("props").alias("value"))
    return metrics.whitelist(rows, names).groupBy("name").agg(F.count("*").alias("cnt"))


@query(f"SELECT event_type, {_MOMENTS} FROM events GROUP BY event_type")
def cmv(spark, d):
    return _rounded(table(spark, d, "events").groupBy("event_type").agg(*metrics.moments(F.col("value"))), total=2, sumsq=1)


@query(f"""SELECT event_type, cnt, round(total, 2) AS total, round(sumsq, 1) AS sumsq, {_DERIVED} FROM (
SELECT event_type, count(value) AS cnt, sum(value) AS total, sum(value * value) AS sumsq FROM events GROUP BY event_type)""")
def cmv_merge(spark, d):
    parts = table(spark, d, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 hour")).agg(*metrics.moments(F.col("value")))
    return _rounded(metrics.derived(metrics.merge(parts, "event_type")), total=2, sumsq=1, avg=6, var=4, scv=6)


@query(f"SELECT event_type, len(list_filter({_AXIS}, lambda x: x < value))::BIGINT AS bucket, count(*) AS cnt FROM events WHERE value IS NOT NULL GROUP BY ALL")
def latency_hist(spark, d):
    return metrics.latency_histogram(table(spark, d, "events"), "event_type", "value", _AXIS)


@query(f"SELECT event_type, {_MOMENTS}, count(*) FILTER (WHERE value > 100) AS missed FROM events GROUP BY event_type")
def qos_miss(spark, d):
    return _rounded(metrics.misses(table(spark, d, "events"), "event_type", "value", 100.0), total=2, sumsq=1)


@query("SELECT event_id, user_id FROM events QUALIFY (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 20 = 0")
def systematic_sample(spark, d):
    return metrics.systematic_sample(table(spark, d, "events"), "user_id", ["ts", "event_id"], 0.05).select("event_id", "user_id")


_QUEUE = "SELECT event_type, count(*) AS total_count, sum(user_id % 50)::BIGINT AS total_len, count(*) FILTER (WHERE event_id % 3 = 0) AS samples, 3600000 AS duration_ms FROM events GROUP BY event_type, date_trunc('hour', ts)"


@query(f"""SELECT event_type, sum(total_count)::BIGINT AS total_count, CASE WHEN sum(samples) > 0 THEN round(sum(total_len) / sum(samples), 6) ELSE 0 END AS avg_len,
round(sum(total_count) * 1000.0 / sum(duration_ms), 9) AS arrival_rate FROM ({_QUEUE}) GROUP BY event_type""")
def queue_rates(spark, d):
    hourly = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count("*").alias("total_count"), F.sum(F.col("user_id") % 50).alias("total_len"), F.count(F.when(F.col("event_id") % 3 == 0, 1)).alias("samples"), F.lit(3600000).alias("duration_ms"))
    return _rounded(metrics.queue_rates(hourly, "event_type"), avg_len=6, arrival_rate=9)


_HOURLY = "SELECT event_type, date_trunc('hour', ts) AS hour, count(value) AS cnt, sum(value) AS total, sum(value * value) AS sumsq FROM events GROUP BY ALL"


@query(f"""SELECT event_type, epoch_ms(hour) AS hour_ms, sum(cnt) OVER w::BIGINT AS cnt, round(sum(total) OVER w, 2) AS total, round(sum(sumsq) OVER w, 1) AS sumsq
FROM ({_HOURLY}) WINDOW w AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY hour) >= 4""")
def history_window(spark, d):
    hourly = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(*metrics.moments(F.col("value")))
    hourly = hourly.withColumn("hour_ms", F.unix_millis(F.col("hour").cast("timestamp"))).drop("hour")
    return _rounded(metrics.history(hourly, "event_type", "hour_ms", 4), total=2, sumsq=1)


@query("SELECT event_type || ':' || lpad(user_id::VARCHAR, 6, '0') AS key, count(*) AS cnt, round(sum(value), 2) AS cost, arg_max(value, (ts, event_id)) AS last_size FROM events GROUP BY 1")
def exec_analyzer(spark, d):
    key = F.concat("event_type", F.lit(":"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    return _rounded(metrics.execution_stats(table(spark, d, "events"), key, "value", "value", ["ts", "event_id"]), cost=2)


@query("""
WITH t AS (SELECT event_type AS component, (user_id % 12)::INT AS task, count(value) AS cnt, sum(value) AS total, sum(value * value) AS sumsq, count(*) * 10 AS duration FROM events GROUP BY ALL)
SELECT component, (task // 4)::INT AS executor, sum(cnt)::BIGINT AS cnt, round(sum(total), 2) AS total, round(sum(sumsq), 1) AS sumsq,
sum(CASE WHEN task % 4 = 0 THEN duration ELSE 0 END)::BIGINT AS duration FROM t GROUP BY ALL""")
def executor_rollup(spark, d):
    tasks = table(spark, d, "events").groupBy(F.col("event_type").alias("component"), (F.col("user_id") % 12).cast("int").alias("task")).agg(*metrics.moments(F.col("value")), (F.count("*") * 10).alias("duration"))
    executors = tasks.select("component").distinct().select("component", F.explode(F.array(*[F.struct(F.lit(i).alias("executor"), F.lit(4 * i).alias("start_task"), F.lit(4 * i + 3).alias("end_task")) for i in range(3)])).alias("e")).select("component", "e.*")
    return _rounded(metrics.executor_rollup(tasks, executors), total=2, sumsq=1)


@query("""
WITH s AS (SELECT date_trunc('day', o_orderdate) AS day, count(*) AS load FROM orders GROUP BY 1),
b AS (SELECT day, ((load > 4)::INT + (load > 6)::INT + (load > 8)::INT)::BIGINT AS st FROM s),
p AS (SELECT lag(st) OVER (ORDER BY day) AS from_state, st AS to_state FROM b),
c AS (SELECT from_state, to_state, count(*) AS n FROM p WHERE from_state IS NOT NULL GROUP BY ALL)
SELECT from_state, to_state, n, round(n / sum(n) OVER (PARTITION BY from_state), 9) AS p FROM c""")
def transition_matrix(spark, d):
    days = table(spark, d, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("day")).agg(F.count("*").alias("load"))
    return _rounded(metrics.transitions(days, "day", "load", [4.0, 6.0, 8.0]), p=9)


# --- queueing -------------------------------------------------------------------

# service rates are set by type so that every node needs a few servers
_NODES = "SELECT event_type AS comp, count(*) / 100.0::DOUBLE AS lam, 3.0::DOUBLE + length(event_type) AS mu, 1.0::DOUBLE + 0.1 * length(event_type) AS ratio FROM events GROUP BY event_type"
_ERLANG = "list_reduce(list_prepend(1.0::DOUBLE, range(1, k + 1)::DOUBLE[]), lambda b, i: lam / mu * b / (i + lam / mu * b))"
_T = f"(CASE WHEN lam / (mu * k) < 1 THEN {_ERLANG} / (1 - lam / (mu * k) * (1 - {_ERLANG})) * (lam / (mu * k)) / ((1 - lam / (mu * k)) * lam) + 1 / mu END)"
_GAINS = f"""n AS ({_NODES}), m AS (SELECT *, (floor(lam / mu) + 1)::BIGINT AS low FROM n),
k AS (SELECT *, unnest(range(low, low + 201)) AS k FROM m), t AS (SELECT *, {_T} * ratio AS t FROM k),
g AS (SELECT comp, k, low, lag(t) OVER (PARTITION BY comp ORDER BY k) - t AS gain FROM t),
r AS (SELECT comp, k, gain, row_number() OVER (ORDER BY gain DESC, comp, k) AS place FROM g WHERE k > low),
need AS (SELECT sum(low) AS need, sum(t) AS start_ FROM t WHERE k = low)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("event_type").cast("double")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("c")).select(F.col("event_type").alias("comp"), (F.col("c") / 100.0).alias("lam"), (3.0 + n).alias("mu"), (1.0 + 0.1 * n).alias("ratio"))


@query(f"""SELECT comp, k, round(lam / (mu * k), 9) AS rho, round({_T}, 9) AS t, CASE WHEN mu * k > lam THEN round(1 / (mu * k - lam), 9) END AS t_single,
(floor(lam / mu) + 1)::BIGINT AS k_min FROM (SELECT *, unnest(range(1, 161)) AS k FROM ({_NODES}))""")
def erlang_table(spark, d):
    lam, mu, k = F.col("lam"), F.col("mu"), F.col("k")
    rows = nodes(spark, d).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(160).cast("long"))).alias("k"))
    return rows.select("comp", "k", F.round(queueing.utilisation(lam, mu, k), 9).alias("rho"), F.round(queueing.sojourn(lam, mu, k), 9).alias("t"), F.round(queueing.single_server(lam, mu, k), 9).alias("t_single"), queueing.minimum(lam, mu).alias("k_min"))


@query(f"SELECT bool_and(t IS NOT NULL) AS stable, round(sum(t * ratio), 9) AS latency, round(sum(t), 9) AS chain_latency FROM (SELECT *, {_T} AS t FROM (SELECT *, (floor(lam / mu) + 2)::BIGINT AS k FROM ({_NODES})))")
def e2e_latency(spark, d):
    n = nodes(spark, d)
    alloc = n.select("comp", (queueing.minimum(F.col("lam"), F.col("mu")) + 1).alias("k"))
    chain = queueing.network_latency(n, alloc, chain=True).select(F.round("latency", 9).alias("chain_latency"))
    return _rounded(queueing.network_latency(n, alloc), latency=9).crossJoin(chain)


@query(f"""WITH {_GAINS}, x AS (SELECT comp, count(*) AS extra FROM r, need WHERE place <= 200 - need GROUP BY comp)
SELECT comp, CASE WHEN need <= 200 THEN low + coalesce(extra, 0) END::BIGINT AS k FROM m LEFT JOIN x USING (comp), need""")
def suggest_alloc(spark, d):
    return queueing.suggest(nodes(spark, d), 200)


_LEAST = """c AS (SELECT place, sum(gain) OVER (ORDER BY place) AS saved FROM r UNION ALL SELECT 0, 0),
f AS (SELECT min(place) AS n FROM c, need WHERE start_ - saved <= 1.5 AND need + place <= 200 AND (SELECT sum(ratio / mu) FROM m) < 1.5),
x AS (SELECT comp, count(*) AS extra FROM r, f WHERE place <= n GROUP BY comp)"""


@query(f"""WITH {_GAINS}, {_LEAST}
SELECT comp, CASE WHEN n IS NOT NULL THEN low + coalesce(extra, 0) END::BIGINT AS k, CASE WHEN n IS NOT NULL THEN 'FEASIBLE' ELSE 'INFEASIBLE' END AS status FROM m LEFT JOIN x USING (comp), f""")
def min_req_alloc(spark, d):
    return queueing.least_for(nodes(spark, d), 1.5, 200)


@query(f"""WITH {_GAINS}, {_LEAST}, o AS (SELECT comp, count(*) AS extra FROM r, need WHERE place <= 100 - need GROUP BY comp),
e AS (SELECT sum(t) AS est FROM t WHERE k = low + 1)
SELECT comp, low + 1 AS k_now, CASE WHEN n IS NOT NULL THEN low + coalesce(x.extra, 0) END::BIGINT AS k_min, CASE WHEN need <= 100 THEN low + coalesce(o.extra, 0) END::BIGINT AS k_opt,
CASE WHEN n IS NOT NULL THEN 'FEASIBLE' ELSE 'INFEASIBLE' END AS status, round(est * 1000, 6) AS est_ms, 1.0::DOUBLE AS ratio FROM m LEFT JOIN x USING (comp) LEFT JOIN o USING (comp), f, need, e""")
def check_optimized(spark, d):
    n = nodes(spark, d)
    alloc = n.select("comp", (queueing.minimum(F.col("lam"), F.col("mu")) + 1).alias("k"))
    return _rounded(queueing.check_optimised(n, alloc, 1.0, 1500.0, 100), est_ms=6)


@query(f"SELECT ceil(sum(low) / 8)::BIGINT AS workers, sum(low)::BIGINT AS executors FROM (SELECT floor(lam / mu) + 1 AS low FROM ({_NODES}))")
def worker_count(spark, d):
    return queueing.workers(nodes(spark, d).select("comp", queueing.minimum(F.col("lam"), F.col("mu")).alias("k")), 8)


# --- outliers, matching -----------------------------------------------------------

_VECTORS = outliers.unit_vectors(4, 64)
_PROJECTED = " UNION ALL ".join(f"SELECT vec_id AS id, {i} AS pid, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ({v}::DOUBLE[])[i])) AS pv FROM embeddings" for i, v in enumerate(_VECTORS))
_COUNTED = f"SELECT id, pid, pv, count(*) OVER (PARTITION BY pid ORDER BY pv RANGE BETWEEN 0.05 PRECEDING AND 0.05 FOLLOWING) - 1 AS n FROM ({_PROJECTED})"


def _objects(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query(f"SELECT id, pid, round(pv, 6) AS pv FROM ({_PROJECTED})")
def random_projection(spark, d):
    return _rounded(outliers.project(_objects(spark, d), _VECTORS), pv=6)


@query(f"SELECT id, pid, n FROM ({_COUNTED})")
def neighbour_count(spark, d):
    return outliers.neighbours(outliers.project(_objects(spark, d), _VECTORS), 0.05).select("id", "pid", "n")


@query(f"SELECT id, bool_or(n < 30) AS is_outlier FROM ({_COUNTED}) GROUP BY id HAVING count(DISTINCT pid) = 4")
def outlier_set(spark, d):
    return outliers.outliers(outliers.neighbours(outliers.project(_objects(spark, d), _VECTORS), 0.05), 30, 4)


_L2 = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)))"


def _features(spark, d, image: str = "label"):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias(image), F.col("embedding").alias("feat"))


def _sides(spark, d):
    """Two images: the features of even and of odd labels."""
    return [_features(spark, d).filter(F.col("label") % 2 == k) for k in (0, 1)]


_COUNTS = f"SELECT a.label AS frame, b.label AS image, count(*) AS freq FROM embeddings a, embeddings b WHERE {_L2} < 1.3 GROUP BY ALL"


@query(_COUNTS)
def match_threshold(spark, d):
    return matching.near_counts(_features(spark, d, "frame"), None, 1.3)


@query(f"""WITH c AS ({_COUNTS}), s AS (SELECT label AS frame, count(*) AS n FROM embeddings GROUP BY 1)
SELECT frame, string_agg(image::VARCHAR, ',' ORDER BY image) AS images FROM c JOIN s USING (frame) WHERE freq / n > 0.5 GROUP BY frame""")
def match_images(spark, d):
    q = _features(spark, d, "frame")
    return matching.matched_images(matching.near_counts(q, None, 1.3), q, 0.5)


def _nearest(q: int) -> str:
    return f"""SELECT id, near[1] AS near, d[1] AS d1, d[2] AS d2 FROM (SELECT id, list(j ORDER BY d, j) AS near, list(d ORDER BY d, j) AS d FROM (
SELECT a.vec_id AS id, b.vec_id AS j, round({_L2}, 6) AS d FROM embeddings a, embeddings b WHERE a.label % 2 = {q} AND b.label % 2 = {1 - q}) GROUP BY id)"""


@query(f"WITH n AS ({_nearest(0)}), g AS (SELECT * FROM n WHERE d1 < 0.98 * d2) SELECT id, near, d1, d2 FROM g WHERE d1 <= (SELECT min(d1) * 3 + max(d1) / 12 FROM g)")
def knn2_ratio(spark, d):
    a, b = _sides(spark, d)
    return matching.ratio_test(matching.two_nearest(a, b), 0.98)


@query(f"WITH f AS ({_nearest(0)}), b AS ({_nearest(1)}) SELECT f.id, f.near FROM f JOIN b ON f.near = b.id AND b.near = f.id")
def mutual_matches(spark, d):
    a, b = _sides(spark, d)
    return matching.mutual(matching.two_nearest(a, b), matching.two_nearest(b, a))


_QUAD = {"x": ["l_quantity", "l_quantity + 40", "l_quantity + 42 - l_linenumber * 8", "l_quantity + l_tax * 200"], "y": ["0.0", "l_discount * 100", "30.0 + l_linenumber", "28.0"]}


@query("""
WITH q AS (SELECT l_orderkey, l_linenumber, """ + ", ".join(f"({e})::DOUBLE AS {c}{i}" for c, es in _QUAD.items() for i, e in enumerate(es)) + """ FROM lineitem),
s AS (SELECT *, (x0-x1)**2+(y0-y1)**2 AS a, (x2-x3)**2+(y2-y3)**2 AS b, (x1-x2)**2+(y1-y2)**2 AS c, (x3-x0)**2+(y3-y0)**2 AS e,
greatest(x0,x1,x2,x3)-least(x0,x1,x2,x3) AS w, greatest(y0,y1,y2,y3)-least(y0,y1,y2,y3) AS h,
abs(x0*y1-x1*y0+x1*y2-x2*y1+x2*y3-x3*y2+x3*y0-x0*y3) AS area2,
(x1-x0)*(y2-y1)-(y1-y0)*(x2-x1) AS t0, (x2-x1)*(y3-y2)-(y2-y1)*(x3-x2) AS t1, (x3-x2)*(y0-y3)-(y3-y2)*(x0-x3) AS t2, (x0-x3)*(y1-y0)-(y0-y3)*(x1-x0) AS t3 FROM q)
SELECT l_orderkey, l_linenumber, b > 0 AND a <= 3*b AND 3*a >= b AND e > 0 AND c <= 3*e AND 3*c >= e AND w >= 10 AND h >= 10 AND w <= 80 AND h <= 80
AND area2 >= w*h/2 AND (least(t0,t1,t2,t3) > 0.01 OR greatest(t0,t1,t2,t3) < -0.01) AS ok FROM s""")
def quad_check(spark, d):
    corner = {c: [F.expr(e).cast("double") for e in es] for c, es in _QUAD.items()}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", matching.quadrilateral_ok(corner["x"], corner["y"], F.lit(40.0), F.lit(40.0)).alias("ok"))


@query("SELECT l_suppkey AS logo, l_orderkey AS template, l_linenumber AS line, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS place FROM lineitem QUALIFY place <= 4")
def template_topk(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("logo"), F.col("l_orderkey").alias("template"), F.col("l_linenumber").alias("line"), "l_quantity", F.struct("l_orderkey", "l_linenumber").alias("tie"))
    return matching.template_pool(rows, "logo", "l_quantity", "tie", 4).select("logo", "template", "line", "place")


# --- patterns ---------------------------------------------------------------------

_BASKETS = """w AS (SELECT row_number() OVER (ORDER BY p_type) - 1 AS id, p_type FROM (SELECT DISTINCT p_type FROM part)),
b AS (SELECT l_orderkey AS o, l_orderkey % 5 <> 0 AS is_add, list_sort(list_distinct(list(id::INT))) AS ids FROM lineitem JOIN part ON l_partkey = p_partkey JOIN w USING (p_type) GROUP BY ALL),
s AS (SELECT is_add, list_filter(ids, lambda x, i: (m & (1::BIGINT << (i - 1)::BIGINT)) > 0) AS p FROM (SELECT *, unnest(range(1, (1::BIGINT << len(ids)::BIGINT))) AS m FROM b)),
f AS (SELECT p, sum(CASE WHEN is_add THEN 1 ELSE -1 END)::BIGINT AS cnt FROM s GROUP BY p HAVING sum(CASE WHEN is_add THEN 1 ELSE -1 END) >= 20)"""
_JOINED = "array_to_string(p, ',')"


def _baskets(spark, d):
    words = patterns.dictionary(table(spark, d, "part"), "p_type")
    parts = table(spark, d, "part").join(words, F.col("p_type") == F.col("word")).select("p_partkey", "id")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return words, items.select("l_orderkey", (F.col("l_orderkey") % 5 != 0).alias("is_add"), "id")


def _frequent(spark, d):
    return patterns.mine(_baskets(spark, d)[1], "l_orderkey", "is_add", "id", 20)


def _named(df):
    return df.withColumn("pattern", F.array_join(F.transform("pattern", lambda x: x.cast("string")), ","))


@query(f"WITH {_BASKETS} SELECT len(p)::BIGINT AS n_items, is_add, count(*) AS cnt, count(DISTINCT p) AS n_patterns FROM s GROUP BY ALL")
def subset_patterns(spark, d):
    p = patterns.subsets(_baskets(spark, d)[1], "l_orderkey", "is_add", "id")
    return p.groupBy(F.size("pattern").cast("long").alias("n_items"), "is_add").agg(F.count("*").alias("cnt"), F.countDistinct("pattern").alias("n_patterns"))


@query(f"WITH {_BASKETS} SELECT {_JOINED} AS pattern, cnt FROM f")
def frequent_patterns(spark, d):
    return _named(_frequent(spark, d))


@query(f"WITH {_BASKETS} SELECT {_JOINED} AS pattern, cnt FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE len(g.p) > len(f.p) AND list_has_all(g.p, f.p))")
def maximal_patterns(spark, d):
    return _named(patterns.maximal(_frequent(spark, d)))


@query(f"WITH {_BASKETS} SELECT string_agg(p_type, ',' ORDER BY id) AS words, cnt FROM (SELECT p, cnt, unnest(p) AS id FROM f) JOIN w USING (id) GROUP BY p, cnt")
def pattern_report(spark, d):
    return patterns.report(_frequent(spark, d), patterns.dictionary(table(spark, d, "part"), "p_type"))


@query(f"""WITH {_BASKETS} SELECT {_JOINED} AS pattern,
abs(list_reduce(list_prepend(1::BIGINT, p::BIGINT[]), lambda h, e: (((h * 31 + e + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648)) % 16 AS bucket FROM f""")
def pattern_bucket(spark, d):
    found = _frequent(spark, d)
    return _named(found.select("pattern", text.pattern_bucket(F.col("pattern"), 16).alias("bucket")))


@query(f"""WITH {_BASKETS}, g AS (SELECT abs(list_reduce(list_prepend(1::BIGINT, p::BIGINT[]), lambda h, e: (((h * 31 + e + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648)) % 16 AS bucket FROM f)
SELECT bucket, bucket::INT AS task, count(*) AS cnt FROM g GROUP BY ALL""")
def direct_grouping(spark, d):
    """Patterns sent to the task that their bucket names."""
    found = _frequent(spark, d).select("pattern", text.pattern_bucket(F.col("pattern"), 16).alias("bucket"))
    sent = text.sent_to(found, "bucket", 16).withColumn("task", F.spark_partition_id())
    return sent.groupBy("bucket", "task").agg(F.count("*").alias("cnt"))


@query("""WITH a AS (SELECT p_partkey AS part, p_partkey * 10 AS lo, p_partkey * 10 + p_size - 1 AS hi FROM part), b AS (SELECT p_partkey AS tile, p_partkey * 64 AS f, p_partkey * 64 + 63 AS l FROM part)
SELECT part, tile, least(hi, l) - greatest(lo, f) + 1 AS shared FROM a JOIN b ON lo <= l AND f <= hi""")
def range_overlap(spark, d):
    """Ranges of as many numbers as a part's size, against tiles of 64."""
    key = F.col("p_partkey")
    sized = table(spark, d, "part").select(key.alias("part"), (key * 10).alias("lo"), (key * 10 + F.col("p_size") - 1).alias("hi"), F.lit(0).alias("one"))
    tiled = table(spark, d, "part").select(key.alias("tile"), (key * 64).alias("f"), (key * 64 + 63).alias("l"), F.lit(0).alias("one"))
    both = ranges.overlapping(sized, tiled, ["one"], ("lo", "hi", "f", "l"))
    return both.select("part", "tile", (F.least("hi", "l") - F.greatest("lo", "f") + 1).alias("shared"))


# --- frames -----------------------------------------------------------------------

_GRID = "SELECT o_orderkey AS frame, x.x::INT AS x, y.y::INT AS y, 160 AS w, 120 AS h, 49 AS patch_count FROM orders, range(0, 481, 80) AS x(x), range(0, 361, 60) AS y(y)"
_FOUND = f"SELECT frame, (x / 80)::BIGINT % 3 AS logo, patch_count, CASE WHEN (frame + x + y) % 7 = 0 THEN x * 1000 + y END AS rect FROM ({_GRID}) WHERE (frame * 31 + x * 7 + y) % 997 <> 0"


def _frames(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("frame"))


def _detected(spark, d):
    p = frames.patches(_frames(spark, d)).filter((F.col("frame") * 31 + F.col("x") * 7 + F.col("y")) % 997 != 0)
    logo = (F.col("x") / 80).cast("long") % 3
    per = F.when(logo == 0, 21).otherwise(14)  # seven columns: 0, 3, 6 are of logo 0
    return p.select("frame", logo.alias("logo"), per.alias("patch_count"), F.when((F.col("frame") + F.col("x") + F.col("y")) % 7 == 0, F.col("x") * 1000 + F.col("y")).alias("rect"))


_DONE = f"SELECT frame, logo, count(rect) AS n_rects FROM ({_FOUND}) GROUP BY frame, logo HAVING count(*) = max(CASE WHEN logo = 0 THEN 21 ELSE 14 END)"


@query(f"SELECT x, y, w, h, patch_count, count(*) AS frames FROM ({_GRID}) GROUP BY ALL")
def patch_grid(spark, d):
    return frames.patches(_frames(spark, d)).groupBy("x", "y", "w", "h", "patch_count").agg(F.count("*").alias("frames"))


@query(f"SELECT frame + k AS frame, logo, n_rects FROM ({_DONE}), range(0, 2) AS r(k)")
def patch_complete(spark, d):
    return frames.complete(_detected(spark, d), 2).select("frame", "logo", "n_rects")


@query(f"SELECT frame, logo, {list(frames.COLOURS)}[logo % 7 + 1] AS colour, n_rects FROM ({_DONE}) JOIN (SELECT o_orderkey AS frame FROM orders) USING (frame)")
def frame_overlay(spark, d):
    return frames.overlays(_frames(spark, d), frames.complete(_detected(spark, d)).select("frame", "logo", "n_rects"))


@query("""
WITH a AS (SELECT o_orderkey AS frame, row_number() OVER (ORDER BY o_orderkey + (o_orderkey * 7919) % 9, o_orderkey) AS pos FROM orders),
p AS (SELECT frame, pos, max(frame) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING) AS passed FROM a)
SELECT frame, pos AS emitted_at FROM p WHERE passed IS NULL OR frame > passed""")
def frame_reorder(spark, d):
    arrivals = numbered(_frames(spark, d), [F.col("frame") + (F.col("frame") * 7919) % 9, "frame"], "at")
    return frames.reorder(arrivals.select("frame", (F.col("at") + 1).alias("at")), 4)


# --- layouts ----------------------------------------------------------------------

_LOADS = "SELECT l_suppkey AS task, count(*) AS load, sum(l_quantity) AS size FROM lineitem GROUP BY 1"


def _loads(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("task")).agg(F.count("*").alias("load"), F.sum("l_quantity").alias("size"))


def _tiled(spark, d, **parts: int):
    loads = _loads(spark, d)
    placed = numbered(loads, ["task"], "_i").crossJoin(F.broadcast(loads.agg(F.count("*").alias("_n"))))
    return placed.select("task", "load", "size", *[tiles(F.col("_i"), F.col("_n"), n).alias(c) for c, n in parts.items()])


@query(f"""SELECT max(load) AS most, round(max(load) / avg(load), 9) AS imbalance, min(load) AS least, round(stddev_pop(load), 6) AS dev FROM (
SELECT part, sum(load)::BIGINT AS load FROM (SELECT load, ntile(8) OVER (ORDER BY task) AS part FROM ({_LOADS})) GROUP BY part)""")
def pack_variance(spark, d):
    packs = _tiled(spark, d, part=8).groupBy("part").agg(F.sum("load").alias("load"))
    return packs.agg(F.max("load").alias("most"), F.round(F.max("load") / F.avg("load"), 9).alias("imbalance"), F.min("load").alias("least"), F.round(F.stddev_pop("load"), 6).alias("dev"))


@query(f"""SELECT a, b, round(sum(size), 2) AS stays FROM (SELECT size, ntile(6) OVER (ORDER BY task) AS a, ntile(8) OVER (ORDER BY task) AS b FROM ({_LOADS})) GROUP BY a, b""")
def pack_overlap(spark, d):
    both = _tiled(spark, d, a=6, b=8)
    return both.groupBy("a", "b").agg(F.round(F.sum("size"), 2).alias("stays"))


#: Suppliers are planned in four scenarios, each of every fourth task: 25 tasks each at the scale of the tests.
SCENARIOS = 4


def _scenarios(spark, d, run, schema):
    loads = _loads(spark, d).withColumn("scenario", F.col("task") % SCENARIOS)

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("task")
        rows = run(group["load"].astype(float).tolist(), group["size"].astype(float).tolist())
        return pd.DataFrame([(int(group["scenario"].iloc[0]), *r) for r in rows], columns=["scenario", *[c.split()[0] for c in schema.split(", ")]])

    return loads.groupBy("scenario").applyInPandas(plan, f"scenario long, {schema}")


def _parts(loads, parts=3):
    return max(1, min(parts, len(loads)))


# tasks of a scenario by place i, with the load and state before them; all layouts of three ranges [0, x), [x, y), [y, n);
# a scenario of fewer tasks than three has one range less
_TASKS = f"""t AS (SELECT task % {SCENARIOS} AS scenario, task, load, size, row_number() OVER (PARTITION BY task % {SCENARIOS} ORDER BY task) - 1 AS i,
count(*) OVER (PARTITION BY task % {SCENARIOS}) AS n FROM ({_LOADS})),
e AS (SELECT scenario, n, i AS pos, coalesce(sum(load) OVER w, 0) AS l, coalesce(sum(size) OVER w, 0) AS s FROM t WINDOW w AS (PARTITION BY scenario ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  UNION ALL SELECT scenario, max(n), max(n), sum(load), sum(size) FROM t GROUP BY scenario),
z AS (SELECT scenario, l AS total, s AS state FROM e WHERE pos = n),
y AS (SELECT a.scenario, a.n, least(a.n, 3) AS k, a.pos AS x, b.pos AS y, a.l AS lx, b.l AS ly, a.s AS sx, b.s AS sy, total, state FROM e a JOIN e b USING (scenario) JOIN z USING (scenario)
  WHERE CASE WHEN a.n >= 3 THEN 0 < a.pos AND a.pos < b.pos AND b.pos < a.n WHEN a.n = 2 THEN a.pos = 1 AND b.pos = 2 ELSE a.pos = 1 AND b.pos = 1 END)"""


@query(f"""WITH {_TASKS}
SELECT scenario::BIGINT AS scenario, round(min((lx - total / k) ** 2 + CASE WHEN k > 1 THEN (ly - lx - total / k) ** 2 ELSE 0 END + CASE WHEN k > 2 THEN (total - ly - total / k) ** 2 ELSE 0 END), 6) AS cost FROM y GROUP BY scenario""")
def pack_balanced(spark, d):
    def run(w, s):
        sums = [sum(w[a:b]) for a, b in packing.ranges(packing.balanced(w, _parts(w)))]
        return [(round(sum((x - sum(w) / len(sums)) ** 2 for x in sums), 6),)]

    return _scenarios(spark, d, run, "cost double")


def _overlap(old: tuple[str, str], new: tuple[str, str]) -> str:
    """State that range old shares with range new, both given by their state before and after."""
    return f"greatest(0, least({old[1]}, {new[1]}) - greatest({old[0]}, {new[0]}))"


# the old layout has two even ranges (one, of a scenario of a single or two tasks), cut at state h
_OLD = f"""h AS (SELECT y.*, CASE WHEN y.n > 2 THEN e.s ELSE state END AS h FROM y JOIN e ON y.scenario = e.scenario AND e.pos = CASE WHEN y.n > 2 THEN (y.n + 1) // 2 ELSE y.n END),
m AS (SELECT *, {", ".join(f"{_overlap(o, r)} AS o{i}{j}" for i, o in enumerate((("0", "h"), ("h", "state"))) for j, r in enumerate((("0", "sx"), ("sx", "sy"), ("sy", "state"))))} FROM h),
g AS (SELECT *, greatest({", ".join(f"o0{a} + o1{b}" for a in range(3) for b in range(3) if a != b)}) AS stays FROM m)"""


@query(f"""WITH {_TASKS}, {_OLD}, cl AS (SELECT scenario, i, n, sum(least(load, total / least(n, 3) * 1.5)) OVER (PARTITION BY scenario ORDER BY i) AS upto, total / least(n, 3) * 1.5 AS cap FROM t JOIN z USING (scenario)),
f AS (SELECT g.*, a.upto AS cx, b.upto AS cy, c.upto AS cn, a.cap FROM g JOIN cl a ON g.scenario = a.scenario AND a.i = g.x - 1 JOIN cl b ON g.scenario = b.scenario AND b.i = g.y - 1 JOIN cl c ON g.scenario = c.scenario AND c.i = g.n - 1)
SELECT scenario::BIGINT AS scenario, round(max(stays) FILTER (WHERE cx <= cap + 1e-9 AND cy - cx <= cap + 1e-9 AND cn - cy <= cap + 1e-9), 4) AS gain FROM f GROUP BY scenario""")
def pack_dp(spark, d):
    def run(w, s):
        old = packing.even(len(w), max(1, _parts(w) - 1))
        pack, gain = packing.least_move([(old, 1.0)], w, s, _parts(w), 1.5)
        return [(round(gain, 4) if pack else None,)]

    return _scenarios(spark, d, run, "gain double")


@query(f"""WITH {_TASKS}, {_OLD} SELECT scenario::BIGINT AS scenario, round(state - stays, 4) AS moved FROM g
WHERE x = CASE WHEN n >= 3 THEN n // 3 + (n % 3 > 0)::INT ELSE 1 END AND y = CASE WHEN n >= 3 THEN 2 * (n // 3) + least(n % 3, 2) ELSE n END""")
def match_max(spark, d):
    def run(w, s):
        return [(round(packing.moved(packing.even(len(w), max(1, _parts(w) - 1)), packing.even(len(w), _parts(w)), s), 4),)]

    return _scenarios(spark, d, run, "moved double")


def _bins(spark, d, run, old, new):
    """scenario, task, part of a plan from `old` to `new` bins of consecutive tasks; scenarios of fewer tasks than bins keep one bin."""
    loads = _loads(spark, d).withColumn("scenario", F.col("task") % SCENARIOS)

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("task")
        tasks, w, s = group["task"].tolist(), group["load"].astype(float).tolist(), group["size"].astype(float).tolist()
        bins = [list(range(a, b)) for a, b in packing.ranges(packing.even(len(w), old))]
        bins = run(bins, w, s, new) if len(w) >= max(old, new) else [list(range(len(w)))]
        return pd.DataFrame([(int(group["scenario"].iloc[0]), tasks[t], i) for i, b in enumerate(bins) for t in b], columns=["scenario", "task", "part"])

    return loads.groupBy("scenario").applyInPandas(plan, "scenario long, task long, part long")


@query(f"""WITH {_TASKS}, b AS (SELECT *, (i >= (n + 1) // 2)::BIGINT AS old, row_number() OVER (PARTITION BY scenario, i >= (n + 1) // 2 ORDER BY size, task) AS r FROM t)
SELECT scenario::BIGINT AS scenario, task, CASE WHEN n < 3 THEN 0 WHEN r <= n // 3 // 2 + (old < n // 3 % 2)::INT THEN 2 ELSE old END::BIGINT AS part FROM b""")
def plan_ch(spark, d):
    return _bins(spark, d, lambda bins, w, s, n: packing.rehash(bins, s, n), 2, 3)


@query(f"""WITH {_TASKS}, b AS (SELECT *, CASE WHEN i < n // 3 + (n % 3 > 0)::INT THEN 0 WHEN i < 2 * (n // 3) + least(n % 3, 2) THEN 1 ELSE 2 END::BIGINT AS old FROM t),
v AS (SELECT scenario, arg_min(old, (s, old)) AS gone FROM (SELECT scenario, old, round(sum(size), 4) AS s FROM b GROUP BY ALL) GROUP BY scenario),
q AS (SELECT *, row_number() OVER (PARTITION BY scenario, old ORDER BY task) AS r, count(*) OVER (PARTITION BY scenario, old) AS c FROM b JOIN v USING (scenario))
SELECT scenario::BIGINT AS scenario, task, CASE WHEN n < 3 THEN 0 WHEN old = gone THEN (r > (c + 1) // 2)::INT ELSE old - (old > gone)::INT END::BIGINT AS part FROM q""")
def plan_ch_shrink(spark, d):
    return _bins(spark, d, lambda bins, w, s, n: packing.rehash(bins, s, n), 3, 2)


# no move from the heaviest to the lightest bin narrows their gap any more; all tasks are still there
@query(f"WITH {_TASKS} SELECT scenario::BIGINT AS scenario, count(*) AS n_tasks, sum(load)::DOUBLE AS load, least(max(n), 4)::BIGINT AS bins, true AS settled FROM t GROUP BY scenario")
def plan_flux(spark, d):
    def run(w, s):
        bins = packing.flux([list(range(a, b)) for a, b in packing.ranges(packing.even(len(w), _parts(w)))], w, _parts(w, 4))
        sums = sorted((sum(w[t] for t in b), b) for b in bins)
        gap = sums[-1][0] - sums[0][0]
        settled = all(abs(gap - 2 * w[t]) >= gap for t in sums[-1][1])
        return [(sum(map(len, bins)), sum(w[t] for b in bins for t in b), len(bins), settled)]

    return _scenarios(spark, d, run, "n_tasks long, load double, bins long, settled boolean")
