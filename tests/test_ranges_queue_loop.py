"""Range joins, pruning by pivots, direct grouping, the queue, committed lines and the optimisation loop against plain Python."""

import json
import os
import random

import pytest
from headwater.config import Scheduling
from headwater.operators import matching, queueing, ranges, text
from headwater.sources import queue
from headwater.streaming.loop import Loop, execute_moments, executor_ranges
from pyspark.sql import functions as F

# --- ranges -------------------------------------------------------------------------------


def test_overlapping_ranges(spark):
    rng = random.Random(1)
    make = lambda n: [(rng.choice("ab"), i, (s := rng.randint(-300, 300)), s + rng.choice([0, 1, 3, 17, 64, 500, -2])) for i in range(n)]
    a, b = make(120), make(90)
    left, right = spark.createDataFrame(a, "k string, x int, s long, e long"), spark.createDataFrame(b, "k string, y int, f long, l long")
    got = sorted((r["x"], r["y"]) for r in ranges.overlapping(left, right, ["k"], ("s", "e", "f", "l")).collect())
    want = sorted((x, y) for k, x, s, e in a for m, y, f, t in b if k == m and s <= e and f <= t and s <= t and f <= e)
    assert got == want


def test_ranges_of_a_billion_tasks(spark):
    n = 10**9
    executors = spark.createDataFrame([("c", i, i * n, i * n + n - 1) for i in range(4)] + [("d", 0, 0, None)], "component string, executor int, start_task long, end_task long")
    tasks = spark.createDataFrame([("c", 0), ("c", n - 1), ("c", n), ("c", 4 * n - 1), ("c", 4 * n), ("d", 5), ("c", None)], "component string, task long")
    got = sorted((r["task"], r["executor"]) for r in ranges.within(tasks, "task", executors, ["component"], ("start_task", "end_task")).collect())
    assert got == [(0, 0), (n - 1, 0), (n, 1), (4 * n - 1, 3)]
    both = ranges.overlapping(executors.filter("end_task is not null"), executors.select("component", F.col("executor").alias("o"), (F.col("start_task") - 5).alias("f"), (F.col("end_task") - 5).alias("l")), ["component"], ("start_task", "end_task", "f", "l"))
    assert sorted((r["executor"], r["o"]) for r in both.collect()) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 3), (3, 3)]


# --- pivots -------------------------------------------------------------------------------


def test_pivots_lose_no_match(spark):
    rng = random.Random(2)
    centres = [[rng.uniform(-20, 20) for _ in range(4)] for _ in range(12)]
    rows = [(i, i % 5, [c + rng.gauss(0, 0.5) for c in centres[i % 12]]) for i in range(400)] + [(400 + i, 1, [0.0] * 4) for i in range(150)]
    q = spark.createDataFrame(rows, "id long, frame int, feat array<double>")
    x = q.withColumnRenamed("frame", "image")
    plain = lambda df: sorted(map(tuple, df.select("frame", "image", "freq").collect()))
    assert plain(matching.near_counts(q, x, 1.0, block=32)) == plain(matching.match_counts(q, x, 1.0))
    a, b, pairs = matching.near_blocks(q, x, 1.0, block=32)
    every, kept = a.select("_q").distinct().count() * b.select("_i").distinct().count(), pairs.count()
    print(f"pairs of blocks skipped: {1 - kept / every:.2f} of {every}")
    assert kept < 0.5 * every
    none = x.filter("id < 0")
    assert not matching.near_counts(q, none, 1.0).count() and not matching.near_counts(none.withColumnRenamed("image", "frame"), x, 1.0).count()


def test_rows_lie_in_the_partition_of_their_bucket(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("bucket")).unionByName(spark.range(3).select(F.lit(None).cast("long").alias("bucket")))
    got = text.sent_to(rows, "bucket", 5).select("bucket", F.spark_partition_id().alias("p")).collect()
    assert len(got) == 503 and all(r["p"] == (r["bucket"] or 0) % 5 for r in got)


# --- queue --------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_ranges_of_a_file_hold_each_line_once(tmp_path, size):
    lines = [("x" * (i % 23)) + ("é" if i % 3 else "") for i in range(200)]
    (tmp_path / "a").write_text("\n".join(lines) + "\nnot yet who")
    (tmp_path / "b").write_text("no line yet")
    (tmp_path / "_hidden").write_text("no\n")
    reader = queue.QueueReader(str(tmp_path), size)
    end = reader.latestOffset()
    assert set(end) == {"a"}
    assert [t for p in reader.partitions({}, end) for (t,) in reader.read(p)] == lines
    with open(tmp_path / "a", "a") as f:
        f.write("le\nlast\n")
    more = reader.latestOffset()
    assert [t for p in reader.partitions(end, more) for (t,) in reader.read(p)] == ["not yet whole", "last"]
    assert [t for p in reader.partitions({}, end) for (t,) in reader.read(p)] == lines  # again after a failure


def test_lines_are_committed_once(spark, tmp_path):
    os.mkdir(tmp_path / "q")
    run = lambda: queue.to_lines(queue.queue(spark, f"{tmp_path}/q", 40), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    for i in range(3):
        (tmp_path / "q" / f"f{i}").write_text("".join(f"{i}-{j}\n" for j in range(30)))
        run()
    (tmp_path / "out" / "part-of-a-lost-task.jsonl").write_text('{"text": "twice"}\n')
    got = sorted(json.loads(r["value"])["text"] for r in queue.committed(spark, f"{tmp_path}/out").collect())
    assert got == sorted(f"{i}-{j}" for i in range(3) for j in range(30))
    manifests = [json.load(open(tmp_path / "out" / f)) for f in os.listdir(tmp_path / "out") if f.startswith("_manifest")]
    assert sorted(m["batch"] for m in manifests) == [0, 1, 2] and all(sum(x["records"] for x in m["files"]) == 30 for m in manifests)


# --- the loop -----------------------------------------------------------------------------


def line(component, task, served, recv, send, duration, source=False):
    n, total = served
    key = {"complete-latency": {"default": f"{n},{total},0"}} if source else {"execute": {"src:default": f"{n},{total},0", "src:other": "0,0,0"}}
    q = lambda k: {"totalCount": k, "sampleCount": k, "totalQueueLen": 0}
    return (f"{component}:{task}->{json.dumps(key | {'send-queue': q(send), 'recv-queue': q(recv), 'duration': duration})}",)


def test_execute_metric_by_source_and_stream(spark):
    rows = [("b:3->" + json.dumps({"execute": {"src:one": "2,5.5,20", "src:two": "0,0,0", "plain": "1,2,4", "src:bad": "x"}}),), ("b:x->{}",), ("c:1->{}",)]
    got = execute_moments(spark.createDataFrame(rows, "line string")).collect()
    assert sorted(map(tuple, got), key=str) == [("b", 3, "src", "one", 2, 5.5, 20.0), ("b", 3, None, "plain", 1, 2.0, 4.0)]


def test_even_executor_ranges(spark):
    got = executor_ranges(spark.createDataFrame([("a", 3), ("b", 20)], "comp string, k long"), 10).collect()
    assert sorted((r["start_task"], r["end_task"]) for r in got if r["component"] == "a") == [(0, 2), (3, 5), (6, 9)]
    assert sorted((r["start_task"], r["end_task"]) for r in got if r["component"] == "b") == [(i, i) for i in range(10)]


def interval(busy):
    """Lines of a second: source s, 4 tasks each of a and b; a record takes 10 ms at a and 20 ms at b."""
    rows = [line("s", t, (50, 50 * 100.0), 0, 100, 1000, True) for t in range(4)]
    for c, ms in (("a", 10.0), ("b", 20.0)):
        rows += [line(c, t, (busy, busy * ms), busy, busy, 1000) for t in range(4)]
    return rows


def test_loop_from_lines_to_moves(spark, tmp_path):
    alloc = spark.createDataFrame([("s", 1), ("a", 1), ("b", 1)], "comp string, k long")
    loop = Loop(str(tmp_path), alloc, ["s"], 4, Scheduling(qos_ms=2000.0, allowed=12))
    want, k = {}, {"a": 1, "b": 1}
    for i, busy in enumerate((50, 60, 60, 90, 90)):
        # task reports of a component add up, its first task's duration is an executor's
        spark.createDataFrame(interval(busy), "line string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        loop.run(spark.readStream.schema("line string").parquet(f"{tmp_path}/in")).awaitTermination()
        if i in want.get("skip", ()):
            continue
        # arrivals a second of a component: all its tasks' records over its executors' seconds, times executors
        nodes = spark.createDataFrame([(c, 4.0 * busy / k[c] * k[c], 1000.0 / ms, 4.0 * busy / k[c] * k[c] / (400.0 / 1 / 2)) for c, ms in (("a", 10.0), ("b", 20.0))], "comp string, lam double, mu double, ratio double")
        best = {r["comp"]: r["k"] for r in queueing.suggest(nodes, 12 - 1).collect()}
        best = {c: min(best[c] if best[c] is not None else k[c], 4) for c in k}  # no more than tasks
        want[i] = {c: (k[c], best[c]) for c in k if best[c] != k[c]}
        if want[i]:
            k, want["skip"] = best, {i + 1}
    got = {}
    for r in loop.moves(spark).collect():
        got.setdefault(r["step"], {})[r["comp"]] = (r["k_now"], r["k_new"])
    want.pop("skip")
    assert got == {i: w for i, w in want.items() if w}
    assert 0 in got and 1 not in got  # the interval across the change is discarded
    history = spark.read.parquet(f"{tmp_path}/history/version=2")
    assert not history.count()


def test_a_batch_that_runs_again_writes_the_same(spark, tmp_path):
    alloc = spark.createDataFrame([("s", 1), ("a", 1), ("b", 1)], "comp string, k long")
    loop = Loop(str(tmp_path), alloc, ["s"], 4, Scheduling(qos_ms=2000.0, allowed=12))
    lines = spark.createDataFrame(interval(50), "line string")
    loop.step(lines, 0)
    once = sorted(map(tuple, loop.moves(spark).collect()))
    loop.step(lines, 0)
    assert sorted(map(tuple, loop.moves(spark).collect())) == once and once


# --- settings and crops -------------------------------------------------------------------


def test_settings_from_files(tmp_path):
    from headwater.config import Settings

    (tmp_path / "a.json").write_text('{"qos": {"ms": 700}, "history.size": 3, "name": "x"}')
    settings = Settings.load(f"{tmp_path}/a.json")
    assert Scheduling.of(settings).qos_ms == 700 and Scheduling.of(settings).history == 3 and settings.need_text("name") == "x"
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("qos:\n  ms: 1500\nexecutors.allowed: 9\n")
    assert Scheduling.of(Settings.load(f"{tmp_path}/a.yaml")).qos_ms == 1500 and Scheduling.of(Settings.load(f"{tmp_path}/a.yaml")).allowed == 9
    (tmp_path / "b.yaml").write_text("")
    assert not len(Settings.load(f"{tmp_path}/b.yaml"))
    (tmp_path / "c.json").write_text("[1]")
    with pytest.raises(ValueError):
        Settings.load(f"{tmp_path}/c.json")


def test_crop_as_a_column(spark):
    from headwater.operators import frames

    image = bytes(range(30))
    rects = [(0, 0, 6, 5), (1, 2, 3, 2), (5, 4, 1, 1), (5, 4, 2, 1), (-1, 0, 2, 2), (0, 0, 0, 1)]
    df = spark.createDataFrame([((5, 6, 0, bytearray(image)), *r) for r in rects], "mat struct<rows:int,cols:int,type:int,data:binary>, x int, y int, w int, h int")
    got = [r[0] for r in df.select(frames.crop(F.col("mat"), F.col("x"), F.col("y"), F.col("w"), F.col("h"))).collect()]
    for (x, y, w, h), g in zip(rects, got, strict=True):
        if w < 1 or x < 0 or x + w > 6:
            assert g is None
        else:
            assert bytes(g["data"]) == b"".join(image[r * 6 + x : r * 6 + x + w] for r in range(y, y + h)) and (g["rows"], g["cols"]) == (h, w)
