"""Golden values and properties of models and planners; streams against batches."""

import random
from itertools import permutations

import pytest
from headwater.operators import frames, metrics, outliers, patterns, queueing
from headwater.plans import packing
from headwater.sources import generators
from headwater.streaming import queries as streaming
from pyspark.sql import functions as F

CHAIN = [("split", 8.0, 9.639, 1.0), ("counter", 8.008, 4.855, 1.0)]
NODES = "comp string, lam double, mu double, ratio double"


@pytest.fixture(scope="module")
def chain(spark):
    return spark.createDataFrame(CHAIN, NODES)


def alloc(df):
    return {r["comp"]: r["k"] for r in df.collect()}


def test_golden_latency(spark, chain):
    got = queueing.network_latency(chain, spark.createDataFrame([("split", 4), ("counter", 2)], "comp string, k long")).first()
    assert got["stable"] and got["latency"] == pytest.approx(0.7480848501895796, rel=1e-12)
    t = spark.range(1).select(queueing.sojourn(F.lit(120.0), F.lit(10.0), F.lit(13)).alias("t")).first()["t"]
    assert t == pytest.approx(0.1704387655797709, rel=1e-12)


def test_golden_allocations(spark, chain):
    assert alloc(queueing.suggest(chain, 6)) == {"split": 2, "counter": 4}
    assert alloc(queueing.suggest(chain, 2)) == {"split": None, "counter": None}
    assert alloc(queueing.least_for(chain, 1.5, 12)) == {"split": 1, "counter": 2}
    assert {r["status"] for r in queueing.least_for(chain, 0.2, 12).collect()} == {"INFEASIBLE"}
    unstable = queueing.network_latency(chain, spark.createDataFrame([("split", 1), ("counter", 1)], "comp string, k long")).first()
    assert not unstable["stable"] and unstable["latency"] is None


def test_suggest_equals_the_greedy_loop(spark):
    rng = random.Random(8)
    rows = [(f"n{i}", rng.uniform(1, 30), rng.uniform(2, 9), rng.uniform(0.5, 2)) for i in range(6)]

    def t(lam, mu, k):
        a, b = lam / mu, 1.0
        for i in range(1, k + 1):
            b = a * b / (i + a * b)
        rho = a / k
        return b / (1 - rho * (1 - b)) * rho / ((1 - rho) * lam) + 1 / mu

    k = {c: int(lam / mu) + 1 for c, lam, mu, _ in rows}
    total = sum(k.values()) + 15
    for _ in range(15):
        best = max(rows, key=lambda r: (t(r[1], r[2], k[r[0]]) - t(r[1], r[2], k[r[0]] + 1)) * r[3])
        k[best[0]] += 1
    assert alloc(queueing.suggest(spark.createDataFrame(rows, NODES), total)) == k


def test_moments(spark):
    df = spark.createDataFrame([(2086, 60635.0, 3382707.0), (0, 0.0, 0.0)], "cnt long, total double, sumsq double")
    got = [r.asDict() for r in metrics.derived(df).collect()]
    assert (got[0]["avg"], got[0]["var"], got[0]["scv"]) == pytest.approx((29.06759348034516, 776.6986909488356, 0.9192516489184115))
    assert (got[1]["avg"], got[1]["var"], got[1]["scv"]) == (0, 0, 0)


def test_boundary_goes_to_the_lower_bucket(spark):
    df = spark.createDataFrame([("a", v) for v in (5.0, 10.0, 10.5, 100.0, 101.0)], "k string, v double")
    got = {r["bucket"]: r["cnt"] for r in metrics.latency_histogram(df, "k", "v", [10.0, 100.0]).collect()}
    assert got == {0: 2, 1: 2, 2: 1}


def test_planners():
    rng = random.Random(2)
    for _ in range(30):
        n, parts = rng.randint(4, 8), rng.randint(2, 4)
        loads, sizes = [rng.randint(1, 9) for _ in range(n)], [float(rng.randint(1, 9)) for _ in range(n)]
        mean = sum(loads) / parts
        cost = lambda p: sum((sum(loads[a:b]) - mean) ** 2 for a, b in packing.ranges(p))  # noqa: B023, E731
        assert cost(packing.balanced(loads, parts)) == pytest.approx(min(map(cost, packing.packs(loads, parts, 1e9))))
        w = [[rng.randint(0, 9) for _ in range(4)] for _ in range(3)]
        best = max(sum(w[i][j] for i, j in enumerate(p)) for p in permutations(range(4), 3))
        assert packing.best_matching(w)[0] == best
        old = packing.even(n, parts)
        cap = packing.load_cap(loads, parts, 1.6)
        fits = packing.packs([min(x, cap) for x in loads], parts, cap + 1e-9)  # a load counts as the cap at most
        pack, gain = packing.least_move([(old, 1.0)], loads, sizes, parts, 1.6)
        if fits:
            assert gain == pytest.approx(max(sum(sizes) - packing.moved(old, p, sizes) for p in fits))
            assert pack in fits
        else:
            assert pack is None
        bins = [list(range(a, b)) for a, b in packing.ranges(old)]
        for moved in (packing.rehash(bins, loads, parts + 1), packing.rehash(bins, loads, parts - 1), packing.flux(bins, loads)):
            assert sorted(t for b in moved for t in b) == list(range(n))


def test_patches_of_a_frame(spark):
    assert frames.grid(640, 480) == (160, 120, 80, 60)
    assert frames.patches(spark.range(1)).count() == 49


def test_neighbours_by_cells(spark):
    rng = random.Random(1)
    rows = [(i, p, rng.gauss(0, 1)) for i in range(200) for p in range(2)]
    got = {(r["id"], r["pid"]): r["n"] for r in outliers.neighbours(spark.createDataFrame(rows, "id long, pid int, pv double"), 0.1).collect()}
    assert got == {(i, p): sum(q == p and j != i and abs(v - w) <= 0.1 for j, q, w in rows) for i, p, v in rows}


def test_large_baskets_fail_loudly(spark):
    df = spark.createDataFrame([(1, True, i) for i in range(20)], "b int, a boolean, i int")
    with pytest.raises(Exception, match="more than 16"):
        patterns.subsets(df, "b", "a", "i").count()


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    source.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = streaming.read_folder(spark, f"{tmp_path}/in", source.schema)
    query = streaming.running_word_count(stream).writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = source.select(F.explode(F.split(F.lower(F.regexp_replace("text", r"\p{P}|\p{S}", " ")), r"[ \t\n\r\f]+")).alias("w")).filter("w <> ''").groupBy("w").count()
    assert {(r["word"], r["cnt"]) for r in spark.table("wc").collect()} == {(r["w"], r["count"]) for r in want.collect()}


def test_sources(spark):
    assert generators.sentences(spark, 10).count() == 10
    objects = generators.parse_objects(spark.createDataFrame([("7|100|1.5,-2",), ("bad",)], "line string"), 5).collect()
    assert [(r["id"], r["vector"], r["time"]) for r in objects] == [(2, [1.5, -2.0], 100)]
    replay = generators.timed_replay(spark.createDataFrame([("3@hi",)], "line string"), 2.0).first()
    assert (replay["at_ms"], replay["text"]) == (1500.0, "hi")


def test_feature_index_rounds_as_single_precision(spark, tmp_path):
    from headwater import catalog, catalog_control  # noqa: F401

    vectors = [(1, [0.005, 0.015, -0.005, *[0.0] * 61], 7)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["feature_index"](spark, str(tmp_path)).collect()
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert [(r["id"], r["total"], r["image"]) for r in got] == con.sql(catalog.ORACLE_SQL["feature_index"]).fetchall()


def test_box_without_width_begins_at_the_first_point():
    import numpy as np
    from headwater.operators import vision

    assert vision.smallest_box(np.array([[0.0, 0.0], [0.0, 5.0], [0.0, 6.0]]), 0.6) == (0.0, 0.0, 0.0, 5.0)
    assert vision.smallest_box(np.array([[0.0, 0.0], [3.0, 2.0], [5.0, 2.0], [6.0, 2.0]]), 0.5) == (0.0, 2.0, 5.0, 0.0)


def test_box_of_many_points_in_time():
    import time

    import numpy as np
    from headwater.operators import vision

    points = np.column_stack([np.random.default_rng(1).uniform(-999, 9999, 20_000).round(2), np.arange(20_000) * 37 % 101]).astype(float)
    start = time.monotonic()
    x, y, width, height = vision.smallest_box(points, 0.8)
    inside = (points[:, 0] >= x) & (points[:, 0] <= x + width) & (points[:, 1] >= y) & (points[:, 1] <= y + height)
    assert time.monotonic() - start < 20 and inside.sum() >= 16_000


def test_layouts_of_many_tasks_in_time():
    import random
    import time

    from headwater.plans import packing

    rng, start = random.Random(2), time.monotonic()
    loads, sizes = [float(rng.randint(500, 700)) for _ in range(20_000)], [float(rng.randint(1, 9)) for _ in range(20_000)]
    pack = packing.balanced(loads, 3)
    assert max(abs(sum(loads[a:b]) - sum(loads) / 3) for a, b in packing.ranges(pack)) <= 700
    kept, gain = packing.least_move([(packing.even(20_000, 2), 1.0)], loads, sizes, 3, 1.5)
    assert round(sum(sizes) - packing.moved(packing.even(20_000, 2), kept, sizes), 6) == round(gain, 6)
    assert time.monotonic() - start < 20


def test_layouts_equal_all_splits():
    import random

    from headwater.plans import packing

    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 10)
        parts, loads, sizes = rng.randint(1, min(n, 4)), [float(rng.choice([0, 1, 2, 7])) for _ in range(n)], [float(rng.randint(0, 9)) for _ in range(n)]
        cost = lambda p, loads=loads: sum((sum(loads[a:b]) - sum(loads) / len(p)) ** 2 for a, b in packing.ranges(p))
        assert abs(cost(packing.balanced(loads, parts)) - min(map(cost, packing.packs(loads, parts, 1e9)))) < 1e-9
        old = packing.even(n, rng.randint(1, n))
        fits = packing.packs([min(x, packing.load_cap(loads, parts, 1.5)) for x in loads], parts, packing.load_cap(loads, parts, 1.5) + 1e-9)
        pack, gain = packing.least_move([(old, 1.0)], loads, sizes, parts, 1.5)
        assert (pack is None) == (not fits) and (not fits or gain <= sum(sizes) - min(packing.moved(old, p, sizes) for p in fits) + 1e-9)
