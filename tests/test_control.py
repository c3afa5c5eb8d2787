"""Control loop, settings, image matching, sources and stateful streams: golden values, brute force, streams against batches."""

import json
import random

import numpy as np
import pytest
from headwater.config import Matching, Registry, Scheduling, Settings
from headwater.functions.ordering import numbered, running, tiles
from headwater.operators import control, frames, matching, metrics, outliers, queueing, vision
from headwater.plans import packing
from headwater.sources import generators, readers
from headwater.streaming import queries as streaming
from headwater.streaming import state
from pyspark.sql import functions as F


def test_running_values_over_ranges(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2, 7]), rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long, w double").repartition(7)
    total, weight, high = 0, 0.0, None
    for r in sorted(running(df, ["id"], {"before": "v", "weight": "w"}, {"high": "v"}).collect(), key=lambda r: r["id"]):
        assert (r["before"], r["high"]) == (total, high) and r["weight"] == pytest.approx(weight)
        total, weight = total + (r["v"] or 0), weight + r["w"]
        high = max((x for x in (high, r["v"]) if x is not None), default=None)
    assert running(df.limit(0), ["id"], {"before": "v"}).count() == 0
    placed = numbered(df, [F.col("w").desc()], "place").collect()
    assert [r["id"] for r in sorted(placed, key=lambda r: r["place"])] == [i for i, _, _ in sorted(rows, key=lambda r: -r[2])]


def test_tiles_match_ntile(spark):
    for n, k in ((10, 4), (3, 5), (8, 8), (1, 1), (100, 7)):
        got = [r["t"] for r in spark.range(n).select(tiles(F.col("id"), F.lit(n), k).alias("t")).collect()]
        sizes = [n // k + (i < n % k) for i in range(k)]
        assert got == [i + 1 for i, s in enumerate(sizes) for _ in range(s)]


def test_frames_are_reordered_like_one_by_one(spark):
    rng = random.Random(6)
    order = sorted(range(300), key=lambda f: f + rng.uniform(0, 12))
    want, waiting, passed = [], [], -1
    for at, f in enumerate(order):
        waiting.append(f)
        passed = max(waiting[:-4], default=-1) if len(waiting) > 4 else -1
        if f > passed:
            want.append((f, at))
    df = spark.createDataFrame(list(zip(order, range(300), strict=True)), "frame long, at long").repartition(5)
    assert sorted((r["frame"], r["emitted_at"]) for r in frames.reorder(df, 4).collect()) == sorted(want)


def test_neighbours_on_a_dense_projection(spark):
    rows = [(i, 0, 0.5) for i in range(300)] + [(300 + i, 0, i / 10) for i in range(20)] + [(i, 1, float(i)) for i in range(5)]
    got = {(r["id"], r["pid"]): r["n"] for r in outliers.neighbours(spark.createDataFrame(rows, "id long, pid int, pv double"), 0.25).collect()}
    assert got == {(i, p): sum(q == p and j != i and v - 0.25 <= w <= v + 0.25 for j, q, w in rows) for i, p, v in rows}


def test_plans_in_one_session_do_not_disturb_each_other(spark):
    a = outliers.neighbours(spark.createDataFrame([(1, 0, 0.0), (2, 0, 0.1)], "id long, pid int, pv double"), 1.0)
    b = outliers.neighbours(spark.createDataFrame([(1, 0, 0.0), (2, 0, 9.0)], "id long, pid int, pv double"), 1.0)
    assert {r["n"] for r in a.collect()} == {1} and {r["n"] for r in b.collect()} == {0}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("_")]


# --- settings ---------------------------------------------------------------------------


def test_typed_settings():
    s = Settings({"a": 3, "b": "x", "c": True, "d": 2.5})
    assert (s.integer("a", 1), s.integer("b", 1), s.integer("c", 7), s.number("d", 0.0), s.flag("c", False), s.flag("a", False), s.text("b", "y"), s.text("a", "y")) == (3, 1, 7, 2.5, True, False, "x", "y")
    assert s.need_integer("a") == 3 and s.need_text("b") == "x"
    for bad in (lambda: s.need_number("b"), lambda: s.need_text("zz")):
        with pytest.raises(KeyError):
            bad()
    assert Scheduling.of(Settings({"qos.ms": 900, "history.size": "no"})) == Scheduling(qos_ms=900.0)
    r = Registry("plan")
    r.add("x")(1)
    with pytest.raises(ValueError, match="exists"):
        r.add("x")(2)
    with pytest.raises(KeyError, match="no plan named y"):
        r.get("y")
    assert {"general", "chain"} <= set(control.CALCULATORS.known) and {"optimum", "never", "keep"} <= set(control.DECISIONS.known)


# --- control loop --------------------------------------------------------------------------

CHAIN = [("split", 8.0, 9.639, 1.0), ("counter", 8.008, 4.855, 1.0)]


def test_check_scales_the_model_by_what_it_underestimates(spark):
    chain = spark.createDataFrame(CHAIN, "comp string, lam double, mu double, ratio double")
    alloc = spark.createDataFrame([("split", 4), ("counter", 2)], "comp string, k long")
    got = queueing.check_optimised(chain, alloc, 765.9786516853933, 1500.0, 6).collect()
    assert [r["ratio"] for r in got] == pytest.approx([1.0239194811808836] * 2, rel=1e-12)
    assert {r["comp"]: (r["k_now"], r["k_min"], r["k_opt"], r["status"]) for r in got} == {"split": (4, 1, 2, "FEASIBLE"), "counter": (2, 2, 4, "FEASIBLE")}
    unstable = spark.createDataFrame([("split", 1), ("counter", 1)], "comp string, k long")
    assert {r["est_ms"] for r in queueing.check_optimised(chain, unstable, 100.0, 1500.0, 6).collect()} == {None}


def test_queue_reports_without_arrivals_do_not_count(spark):
    rows = [("a", 0, 0, 9, 9, 10, 2, 6, 100), ("a", 1, 4, 2, 8, 20, 4, 4, 999), ("a", 2, 5, 1, 1, 0, 5, 5, 70)]
    tasks = spark.createDataFrame(rows, "component string, task int, send_total long, send_samples long, send_len long, recv_total long, recv_samples long, recv_len long, duration long")
    executors = spark.createDataFrame([("a", 0, 0, 1), ("a", 1, 2, 2)], "component string, executor int, start_task int, end_task int")
    got = {r["executor"]: r for r in control.queue_lengths_and_rates(control.queue_rollup(tasks, executors)).collect()}
    assert (got[0]["send_total"], got[0]["send_avg"], got[0]["recv_avg"], got[0]["duration"]) == (4, 4.0, pytest.approx(10 / 6), 100)
    assert (got[0]["arrival_rate"], got[0]["departure_rate"]) == (300.0, 40.0)
    assert (got[1]["recv_total"], got[1]["recv_avg"], got[1]["arrival_rate"]) == (0, 0.0, 0.0)
    known = metrics.queue_rates(spark.createDataFrame([("detector", 55416, 6088758, 2769, 1000)], "comp string, total_count long, total_len long, samples long, duration_ms long"), "comp").first()
    assert known["avg_len"] == pytest.approx(2198.9014084507044)


@pytest.fixture(scope="module")
def loop(spark):
    rng = random.Random(5)
    rows = []
    for t in range(5):
        for c, k in (("src", 1), ("split", 2), ("count", 2)):
            for e in range(k):
                n = rng.randint(80, 120)
                rows.append((t, c, e, n, n * 90.0, 2000, 1000, 100_000))
    results = spark.createDataFrame(rows, "interval int, component string, executor int, cnt long, total double, send_total long, recv_total long, duration long")
    return rows, results, spark.createDataFrame([("src", 1), ("split", 2), ("count", 2)], "comp string, k long")


def test_nodes_from_measurements(loop):
    rows, results, alloc = loop
    merged = control.last_intervals(results, 3)
    source = control.source_node(merged, alloc, ["src"], 0.5)
    got = source.first()
    own = [r for r in rows if r[1] == "src" and r[0] >= 2]
    assert got["real_ms"] == pytest.approx(90.0) and got["leave_rate"] == pytest.approx(2000 / 100 / 2)
    assert got["complete_rate"] == pytest.approx(sum(r[3] for r in own) * 1000 / (300_000 * 0.5))
    nodes = {r["comp"]: r for r in control.service_nodes(merged, alloc, ["src"], source).collect()}
    assert nodes["split"]["lam"] == pytest.approx(20.0) and nodes["split"]["mu"] == pytest.approx(1000 / 90) and nodes["split"]["ratio"] == pytest.approx(2.0)
    assert {r["ratio"] for r in control.service_nodes(merged, alloc, ["src"], source, chain=True).collect()} == {1.0}
    assert control.last_intervals(results, 6).count() == 0 and control.last_intervals(results, 6, ignore=1).count() == 3


def test_decisions(spark, loop):
    _, results, alloc = loop
    now = {"src": 1, "split": 2, "count": 2}
    step = lambda **how: {r["comp"]: r["k_new"] for r in control.rebalance(results, alloc, ["src"], Scheduling(history=3, allowed=9), **how).collect()}
    assert step() == {"split": 4, "count": 4} and step(calculator="chain") == {"split": 4, "count": 4}
    assert step(decision="never") == {} and step(decision="keep") == {}
    plan = control.once({"split": 7})
    assert step(decision=plan, elapsed=10) == {} and step(decision=plan, elapsed=300) == {"split": 7}
    drifted = {**now, **step(decision=control.drift(3))}
    assert all(abs(drifted[c] - now[c]) <= 1 and drifted[c] >= 1 for c in now)
    # too little history: no change
    assert {r["comp"] for r in control.rebalance(results, alloc, ["src"], Scheduling(history=9, allowed=9)).collect()} == set()
    budget = lambda **s: control.executor_budget(alloc, Scheduling(**s), 9 if s.get("allowed") else 1).first()["budget"]
    assert (budget(), budget(per_worker=2), budget(allowed=5)) == (8, 6, 5)
    assert control.executor_budget(alloc.filter("k < 0"), Scheduling(), 2).first()["budget"] == 16
    half = lambda n: control.workers_by_half(spark.createDataFrame([("a", n)], "comp string, k long"), 8).first()["workers"]
    assert [half(n) for n in (8, 12, 13, 16)] == [1, 1, 2, 2]


def test_least_chain_without_a_limit(spark):
    nodes = spark.createDataFrame([("a", 30.0, 1.0, 1.0), ("b", 40.0, 1.0, 1.0)], "comp string, lam double, mu double, ratio double")
    t = lambda lam, k: queueing.sojourn(F.lit(lam), F.lit(1.0), F.lit(k))
    got = {r["comp"]: r["k"] for r in queueing.least_for(nodes, 2.05, None, chain=True).collect()}
    at = lambda a, b: spark.range(1).select((t(30.0, a) + t(40.0, b)).alias("t")).first()["t"]
    assert at(got["a"], got["b"]) <= 2.05 and sum(got.values()) > 72
    assert min(at(got["a"] - 1, got["b"]), at(got["a"], got["b"] - 1)) > 2.05


# --- planners ----------------------------------------------------------------------------------


def test_rehash_moves_as_little_as_it_must():
    sizes = [5.0, 1.0, 4.0, 2.0, 3.0, 9.0, 7.0]
    assert packing.rehash([[0, 1, 2, 3], [4, 5, 6]], sizes, 3) == [[0, 2, 3], [5, 6], [1, 4]]
    assert packing.rehash([[0, 1], [2, 3, 4], [5, 6]], sizes, 2) == [[0, 2, 3, 4], [1, 5, 6]]
    with pytest.raises(ValueError, match="must change"):
        packing.rehash([[0]], sizes, 1)


def test_flux_changes_the_number_of_bins():
    loads = [4.0, 1.0, 3.0, 2.0, 2.0, 6.0]
    grown = packing.flux([[0, 1, 2], [3, 4, 5]], loads, 3)
    assert sorted(t for b in grown for t in b) == list(range(6)) and max(sum(loads[t] for t in b) for b in grown) <= 7
    assert sorted(t for b in packing.flux([[0, 1], [2, 3], [4, 5]], loads, 2) for t in b) == list(range(6))
    assert packing.flux([[0], [1], [2, 3]], [9.0, 9.0, 9.0, 9.0], 2) == [[0, 2], [1, 3]]


def test_layouts_of_several_states_settle():
    loads, sizes = [100.0] * 12, [100.0] * 12
    got = packing.settled_layouts({0: 2, 1: 3, 2: 4}, {(0, 1): 0.6, (1, 0): 0.5, (1, 2): 0.5, (2, 1): 1.0, (0, 2): 0.4}, loads, sizes, 1.3)
    assert {k: len(p) for k, (p, _) in got.items()} == {0: 2, 1: 3, 2: 4}
    assert all(sum(p) == 12 and max(p) * 100 <= 1200 / len(p) * 1.3 + 1e-9 and g > 0 for p, g in got.values())
    options = packing.packs(loads, 3, 520.0)
    best, value = packing.cheapest_pack(options, [0.0] * len(options), packing.even(12, 4), sizes, 0.5)
    assert value == min(packing.moved(packing.even(12, 4), p, sizes) for p in options) and options[best] in options


# --- images --------------------------------------------------------------------------------------


def test_homography_survives_outliers():
    rng = np.random.default_rng(3)
    h = np.array([[1.1, 0.08, 20], [-0.05, 0.95, 12], [1e-4, -5e-5, 1]])
    src = rng.uniform(0, 100, (40, 2))
    dst = vision.project(h, src)
    dst[:12] += rng.uniform(20, 60, (12, 2))
    got, inside = vision.homography(src, dst)
    assert got == pytest.approx(h, abs=1e-6) and (np.flatnonzero(inside) >= 12).all() and inside.sum() == 28
    assert vision.homography(src[:3], dst[:3])[0] is None


def test_smallest_box_by_all_edges():
    rng = np.random.default_rng(9)
    for n, share in ((1, 0.9), (6, 0.5), (9, 0.9), (8, 1.0)):
        p = rng.integers(0, 9, (n, 2)).astype(float)
        need = int(np.ceil(round(n * share, 9)))
        best = min(((r - x) * (b - y), x, y, r, b) for x in p[:, 0] for r in p[:, 0] for y in p[:, 1] for b in p[:, 1] if ((p >= (x, y)) & (p <= (r, b))).all(axis=1).sum() >= need)
        assert vision.smallest_box(p, share) == (best[1], best[2], best[3] - best[1], best[4] - best[2])


def test_regular_quadrilaterals_match_the_column_form(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        w, h, j = rng.uniform(5, 90), rng.uniform(5, 90), rng.choice([1, 12, 60])
        rows.append([c + rng.uniform(0, j) for c in (0, 0, w, 0, w, h, 0, h)])
    names = [f"{a}{i}" for i in range(4) for a in "xy"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    ok = matching.quadrilateral_ok([F.col(f"x{i}") for i in range(4)], [F.col(f"y{i}") for i in range(4)], F.lit(40.0), F.lit(40.0))
    got = [r["ok"] for r in df.select(ok.alias("ok")).collect()]
    assert got == [vision.regular(np.array(r).reshape(4, 2), 40.0, 40.0) for r in rows] and 0 < sum(got) < 300


def test_logo_is_found_where_it_lies(spark):
    rng = np.random.default_rng(5)
    features, spots = rng.normal(size=(60, 16)), rng.uniform(5, 95, (60, 2))
    h = np.array([[1.2, 0.1, 30.0], [-0.08, 1.1, 40.0], [0, 0, 1]])
    logos = [(1, i, features[i].tolist(), *map(float, spots[i]), 100.0, 100.0) for i in range(40)]
    logos += [(2, 100 + i, rng.normal(size=16).tolist(), *map(float, rng.uniform(0, 100, 2)), 100.0, 100.0) for i in range(40)]
    there = vision.project(h, spots[:40])
    regions = [(7, 200 + i, (features[i] + rng.normal(size=16) * 0.01).tolist(), *map(float, there[i]), 10.0, 20.0, 200.0, 200.0) for i in range(40)]
    regions += [(7, 300 + i, rng.normal(size=16).tolist(), *map(float, rng.uniform(0, 200, 2)), 10.0, 20.0, 200.0, 200.0) for i in range(30)]
    logos = spark.createDataFrame(logos, "logo int, id long, feat array<double>, px double, py double, width double, height double")
    regions = spark.createDataFrame(regions, "region int, id long, feat array<double>, px double, py double, x double, y double, width double, height double")
    got = {(r["logo"], r["region"]): r for r in vision.match_images(logos, regions).collect()}
    x, y, w, height = got[1, 7]["rect"]
    assert got[1, 7]["n_matches"] >= 30
    corners = vision.project(h, np.array([[0.0, 0], [99, 0], [99, 99], [0, 99]]))
    assert abs(x - 10 - corners[:, 0].min()) < 15 and abs(y - 20 - corners[:, 1].min()) < 15 and w > 90 and height > 80
    assert (2, 7) not in got or got[2, 7]["rect"] is None
    assert vision.locate(there[:5], there[:5], (9, 9), (0, 0, 9, 9), Matching()) is None


def test_blocks_give_all_neighbours(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4)).round(1)
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, image int, feat array<double>")
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 6)
    got = {r["id"]: (r["near"], r["d1"], r["d2"]) for r in matching.two_nearest(df.filter("id < 20"), df.filter("id >= 20")).collect()}
    for i in range(20):
        order = sorted((d[i, j], j) for j in range(20, 50))
        assert got[i] == (order[0][1], pytest.approx(order[0][0]), pytest.approx(order[1][0]))
    counts = {(r["frame"], r["image"]): r["freq"] for r in matching.in_blocks(df.withColumnRenamed("image", "frame"), df, lambda q, i: matching.pd.DataFrame([(0, 0, len(q) * len(i))], columns=["frame", "image", "freq"]), "frame int, image int, freq long", 7).groupBy("frame", "image").agg(F.sum("freq").alias("freq")).collect()}
    assert counts == {(0, 0): 2500}
    assert matching.two_nearest(df.limit(0), df).count() == 0


def test_features_by_a_given_function(spark):
    rows = [(1, (2, 2, 0, bytes([1, 2, 3, 4]))), (2, None), (3, (1, 1, 0, b"\x07"))]
    df = spark.createDataFrame(rows, "frame int, image struct<rows:int,cols:int,type:int,data:binary>")

    def features(data, n, m):
        if len(data) < 2:
            raise ValueError("too small")
        return [[float(b) for b in data[i * m : i * m + m]] for i in range(n)]

    got = {r["frame"]: (r["n"], r["feat"]) for r in vision.extract(df, features).collect()}
    assert got == {1: (2, [[1.0, 2.0], [3.0, 4.0]]), 2: (0, []), 3: (0, [])}
    assert vision.crop(3, 4, bytes(range(12)), 1, 1, 2, 2) == bytes([5, 6, 9, 10])


# --- sources -----------------------------------------------------------------------------------------


def test_image_files_and_raw_frames(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.bin").write_bytes(bytes([i, i]))
    got = {r["frame_id"]: bytes(r["img_bytes"]) for r in readers.images(spark, str(tmp_path), "*.bin").collect()}
    assert got == {f"s-00-{i + 1}": bytes([i, i]) for i in range(3)}
    mats = spark.createDataFrame([(i, (2, 2, 0, bytes([i, 2, 3, 4]))) for i in range(6)], "frame long, mat struct<rows:int,cols:int,type:int,data:binary>")
    raw, sampled = readers.raw_frames(mats, 2, 3, width=4, height=2)
    assert {r["frame"]: bytes(r["mat"]["data"]) for r in raw.collect()}[5] == bytes([5, 5, 2, 2, 3, 3, 4, 4])
    assert [(r["frame"], r["sample_id"]) for r in sampled.collect()] == [(3, 1)]


def test_bounded_iterables():
    assert list(readers.first_rows(iter(range(9)), 3)) == [0, 1, 2] and list(readers.first_rows([1], 3)) == [1]
    ticks = iter(range(9))
    assert list(readers.until("abcdef", lambda: next(ticks), 3)) == ["a", "b", "c"]


def test_gaps_and_arrivals(spark):
    df = spark.range(4000).withColumn("s", F.lit("x"))
    for law, low, mean in (("fixed", 0.0, 50.0), ("poisson", 0.0, 50.0), ("uniform", 10.0, np.log(2) * 100)):
        rows = generators.arrivals(df.coalesce(1), "id", law, 3, 20.0, "s", *([low] if low else [])) if not low else df.coalesce(1).withColumn("at_ms", F.sum(generators.gaps(law, 3, 20.0, low)).over(metrics.Window.partitionBy("s").orderBy("id")))
        last = rows.agg(F.max("at_ms")).first()[0]
        assert last / 4000 == pytest.approx(mean, rel=0.06)
    with pytest.raises(ValueError, match="other"):
        generators.gaps("other", 1, 1.0)


# --- streams -----------------------------------------------------------------------------------------


def written(spark, stream, folder, batches, schema):
    """Runs a stream over batches that come one after the other."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream(streaming.read_folder(spark, f"{folder}/in", spark.read.schema(schema).parquet(f"{folder}/in").schema, 100)).awaitTermination()
    return f"{folder}/out"


def test_reports_as_a_sink(spark, tmp_path):
    run = lambda df: state.to_reports(df, "task", f"{tmp_path}/out", f"{tmp_path}/c")
    out = written(spark, run, str(tmp_path), [[("a", 1)], [("b", 2)]], "component string, k int")
    lines = sorted(r["value"] for r in spark.read.text(f"{out}/*").collect())
    assert lines == ['task:a->{"k":1}', 'task:b->{"k":2}'] and json.loads(lines[0].split("->")[1]) == {"k": 1}


def test_repeated_updates(spark, tmp_path):
    once = lambda df: state.distinct_updates(df.select("k", F.timestamp_seconds("s").alias("ts")), ["k"], "ts").writeStream.format("parquet").option("path", f"{tmp_path}/u/out").option("checkpointLocation", f"{tmp_path}/u/c").trigger(availableNow=True).start()
    out = written(spark, once, f"{tmp_path}/u", [[(1, 100), (1, 101)], [(1, 102), (2, 103)]], "k int, s long")
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_listener_sees_batches(spark, tmp_path):
    seen = []
    listener = state.ProgressListener(seen.append)
    spark.streams.addListener(listener)
    spark.range(5).write.parquet(f"{tmp_path}/in")
    state.to_console(streaming.read_folder(spark, f"{tmp_path}/in", spark.range(1).schema)).awaitTermination()
    for _ in range(100):
        if any(x["event"] == "terminated" for x in seen):
            break
        __import__("time").sleep(0.1)
    spark.streams.removeListener(listener)
    assert {"started", "terminated"} <= {x["event"] for x in seen} and sum(x.get("rows", 0) for x in seen) == 5
