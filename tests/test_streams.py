"""Stateful streams over several unordered files, batches and restarts against plain Python, and pattern mining against all subsets."""

import random
from itertools import combinations

import pytest
from headwater.operators import patterns
from headwater.streaming import state, stateful
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def rocksdb(spark):
    stateful.use_rocksdb(spark)


def replayed(spark, folder, batches, schema, stream):
    """What a stream gives over batches of several files each, started anew from its checkpoint for every batch; and its queries."""
    out, queries = [], []
    for rows in batches:
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(f"{folder}/in")
        made = stream(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        query = made.writeStream.foreachBatch(lambda b, n: out.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{folder}/c").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        queries.append(query)
    return out, queries


def test_maximal_patterns_change_with_each_batch(spark, tmp_path):
    rng, counts, before, want, batches = random.Random(1), {}, set(), [], []
    for step in range(4):
        rows = []
        for _ in range(25):
            items, add = sorted(rng.sample(range(6), rng.randint(1, 4))), rng.random() < 0.7
            for k in range(1, len(items) + 1):
                for c in combinations(items, k):
                    rows.append((list(c), add, step))
                    counts[c] = counts.get(c, 0) + (1 if add else -1)
        batches.append(rows)
        frequent = {c for c, n in counts.items() if n >= 4}
        after = {c for c in frequent if not any(set(c) < set(e) for e in frequent)}
        want += [(step, c, True) for c in after - before] + [(step, c, False) for c in before - after]
        before = after
    got, _ = replayed(spark, str(tmp_path), batches, "pattern array<int>, is_add boolean, step long", lambda s: stateful.maximal_changes(s, 4))
    assert sorted((a, tuple(b), c) for a, b, c in got) == sorted(want)
    assert any(not x[2] for x in want)


def test_outliers_by_latest_values(spark, tmp_path):
    rng, batches, latest, last, want = random.Random(2), [], {}, {}, []
    for step in range(4):
        rows = [(step, i, p, round(rng.gauss(0, 1), 3)) for i in range(40) if step == 0 or rng.random() < 0.3 for p in range(2)]
        if step == 1:
            rows.append((step, 99, 0, 0.0))  # never on the other projection
        batches.append(rows)
        latest.update({(i, p): v for _, i, p, v in rows})
        for i in sorted({i for i, _ in latest} - {99}):
            now = any(sum(q == p and j != i and v - 0.3 <= latest[i, p] <= v + 0.3 for (j, q), v in latest.items()) < 3 for p in range(2))
            if last.get(i) != now:
                last[i] = now
                want.append((step, i, now))
    got, _ = replayed(spark, str(tmp_path), batches, "time long, id long, pid int, pv double", lambda s: stateful.outlier_changes(s, 0.3, 3, 2))
    assert sorted(got) == sorted(want)


def test_frames_ascend_over_all_batches(spark, tmp_path):
    rng = random.Random(3)
    rows, want = [], []
    for video in "ab":
        frames = list(range(50))
        for i in range(0, 45, 3):
            j = i + rng.randint(0, 4)
            frames[i], frames[j] = frames[j], frames[i]
        rows.append([(video, f, i) for i, f in enumerate(frames)])
        want.append(sorted(f for i, f in enumerate(frames) if i < 3 or f > max(frames[: i - 2])))
    batches = [[r for v in rows for r in v[a:b]] for a, b in ((0, 10), (10, 11), (11, 40), (40, 50))] + [[("a", None, 99), ("b", None, 99)]]
    got, _ = replayed(spark, str(tmp_path), batches, "video string, frame long, at long", lambda s: stateful.in_order(s, 3))
    assert [[f for v, f, _ in got if v == video] for video in "ab"] == want and min(map(len, want)) < 50


def test_a_frame_older_than_one_written_is_dropped(spark, tmp_path):
    got, _ = replayed(spark, str(tmp_path), [[("v", 1, 0), ("v", 2, 1), ("v", 5, 2)], [("v", 3, 3), ("v", 4, 4), ("v", 6, 5), ("v", None, 6)]], "video string, frame long, at long", lambda s: stateful.in_order(s, 1))
    assert [f for _, f, _ in got] == [1, 2, 5, 6]


def test_frames_as_a_sink(spark, tmp_path):
    schema = "video string, frame long, at long"
    for rows in ([("v", 3, 0), ("v", 1, 1), ("v", 2, 2), ("v", 5, 3)], [("v", 4, 4), ("v", 0, 5), ("v", None, 6)]):
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        state.to_frames(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c", 2).awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("batch", "frame").collect()]
    assert sorted(f for _, f in got) == [1, 2, 3, 4, 5] or sorted(f for _, f in got) == [1, 3, 4, 5]
    assert max(f for b, f in got if b == 0) < min(f for b, f in got if b > 0)


def idle(rows, keep):
    seen, out = {}, []
    for p, add, at in sorted(rows, key=lambda r: r[2]):
        n, last = seen.get(p, (0, None))
        n = (0 if last is None or at - last > keep else n) + (1 if add else -1)
        seen[p] = n, at
        out.append((p, n, at))
    return sorted(out)


def test_idle_patterns_in_unordered_files(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"p{rng.randint(0, 3)}", rng.random() < 0.7, i * 1000 + rng.randint(0, 900)) for i in range(200) if i % 40 < 20 or rng.random() < 0.5]
    mixed = rows[:]
    rng.shuffle(mixed)
    stream = lambda s: stateful.idle_patterns(s.select("pattern", "is_add", F.timestamp_millis("at").alias("ts")), 3000, "300 seconds")
    got, queries = replayed(spark, str(tmp_path), [mixed[:30], mixed[30:80], mixed[80:], [("end", True, 10**9)]], "pattern string, is_add boolean, at long", stream)
    assert sorted(g for g in got if g[0] != "end") == idle(rows, 3000)
    assert not any(map(stateful.late_rows, queries))


def test_late_records_are_counted(spark, tmp_path):
    batches = [[("a", True, 100_000)], [("a", True, 500_000)], [("a", True, 100_500), ("a", True, 501_000)], [("end", True, 10**9)]]
    stream = lambda s: stateful.idle_patterns(s.select("pattern", "is_add", F.timestamp_millis("at").alias("ts")), 3000, "10 seconds")
    got, queries = replayed(spark, str(tmp_path), batches, "pattern string, is_add boolean, at long", stream)
    assert sorted(g for g in got if g[0] == "a") == [("a", 1, 100_000), ("a", 1, 500_000), ("a", 2, 501_000)]
    assert sum(map(stateful.late_rows, queries)) == 1


def test_the_newest_signal_of_all_batches(spark, tmp_path):
    schema = "sig_type string, at int"
    for rows, want in (([("a", 1), ("b", 5)], ("b", 5)), ([("c", 3)], ("b", 5)), ([("d", 7)], ("d", 7))):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        state.latest_signal(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
        assert [tuple(r) for r in state.current_signal(spark, f"{tmp_path}/out").collect()] == [want]


# --- mining -------------------------------------------------------------------------------


def plain(df):
    return sorted((tuple(r["pattern"]), r["cnt"]) for r in df.collect())


@pytest.mark.parametrize("threshold", [1, 2, 4])
def test_mining_equals_all_subsets(spark, threshold):
    rng = random.Random(threshold)
    rows = [(b, b % 4 != 0, i) for b in range(60) for i in rng.sample(range(8), rng.randint(1, 5)) for _ in range(1 + (b % 7 == 0))] + [(99, True, None)]
    baskets = spark.createDataFrame(rows, "k int, is_add boolean, item int")
    everything = patterns.frequent(patterns.subsets(baskets, "k", "is_add", "item"), threshold)
    mined = patterns.mine(baskets, "k", "is_add", "item", threshold)
    assert plain(mined) == plain(everything)
    found = [p for p, _ in plain(mined)]
    assert [p for p, _ in plain(patterns.maximal(mined))] == [p for p in found if not any(set(p) < set(q) for q in found)]


def test_a_basket_of_many_items(spark):
    rows = [(0, True, i) for i in range(200)] + [(b, True, i) for b in (1, 2) for i in (3, 7, 190)]
    got = patterns.mine(spark.createDataFrame(rows, "k int, is_add boolean, item int"), "k", "is_add", "item", 2)
    assert plain(got) == sorted([((3,), 3), ((7,), 3), ((190,), 3), ((3, 7), 3), ((3, 190), 3), ((7, 190), 3), ((3, 7, 190), 3)])


def test_a_larger_pattern_may_be_frequent_alone(spark):
    """After retractions a superset by two items is frequent, those between are not."""
    found = spark.createDataFrame([([1], 5), ([1, 2, 3], 4), ([4], 4)], "pattern array<int>, cnt long")
    assert [p for p, _ in plain(patterns.maximal(found))] == [(1, 2, 3), (4,)]


def test_an_empty_table_of_baskets(spark):
    assert not patterns.mine(spark.createDataFrame([], "k int, is_add boolean, item int"), "k", "is_add", "item", 2).count()


# --- state of a query, and the three-way join ---------------------------------------------


def test_counts_go_on_from_another_query_s_state(spark, tmp_path):
    """Counts read from a checkpoint seed a query with another number of partitions; the sizes are those of its tasks."""
    schema = "pattern array<int>, is_add boolean, step long"
    rng = random.Random(5)
    batches = [[([rng.randint(0, 9)], rng.random() < 0.8, step) for _ in range(60)] for step in range(4)]
    whole, _ = replayed(spark, f"{tmp_path}/whole", batches, schema, lambda s: stateful.crossings(s, 8))
    first, _ = replayed(spark, f"{tmp_path}/first", batches[:2], schema, lambda s: stateful.crossings(s, 8))
    counts = stateful.state_rows(spark, f"{tmp_path}/first/c", "count")
    want = {}
    for pattern, add, _ in batches[0] + batches[1]:
        want[pattern[0]] = want.get(pattern[0], 0) + (1 if add else -1)
    assert {r["pattern"][0]: r["n"] for r in counts.collect()} == {k: n for k, n in want.items() if n}
    sizes = {r["task"]: (r["entries"], r["bytes"]) for r in stateful.state_sizes(counts).collect()}
    assert sum(n for n, _ in sizes.values()) == counts.count() and all(b > 0 for _, b in sizes.values())
    counts.write.parquet(f"{tmp_path}/seed")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        seed = spark.read.parquet(f"{tmp_path}/seed")
        rest, _ = replayed(spark, f"{tmp_path}/rest", batches[2:], schema, lambda s: stateful.crossings(s, 8, seed))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    plain = lambda rows: sorted((tuple(p), c, s) for p, c, s in rows)
    assert plain(first) + plain(rest) == plain([r for r in whole if r[2] < 2]) + plain([r for r in whole if r[2] >= 2])


def test_three_streams_in_any_order(spark, tmp_path):
    from headwater.operators import frames

    rng = random.Random(6)
    images = [(f, f"i{f}") for f in range(20)] + [(3, "i0"), (4, "i4")]
    patches = [(rng.randint(0, 24), rng.randint(0, 3)) for _ in range(80)]
    updates = [(rng.randint(0, 24), rng.randint(0, 3), rng.randint(0, 50), rng.randint(0, 5), rng.randint(0, 9)) for _ in range(80)]
    a, b = frames.three_way(spark.createDataFrame(images, "frame long, image string"), spark.createDataFrame(patches, "frame long, patch long"), spark.createDataFrame(updates, "host_frame long, host_patch long, at long, logo long, parent long"))
    want = [("patch", r["frame"], r["patch"], r["image"], None, None) for r in a.collect()] + [("update", r["host_frame"], r["host_patch"], r["image"], r["logo"], r["parent"]) for r in b.collect()]
    rows = [("frame", f, None, i, None, None, None) for f, i in images] + [("patch", f, p, None, None, None, None) for f, p in patches] + [("update", f, p, None, at, lo, pa) for f, p, at, lo, pa in updates]
    rows = [(*r, 1000 + rng.randint(0, 50)) for r in rows]
    rng.shuffle(rows)
    batches = [rows[:60], rows[60:120], rows[120:], [("frame", -1, None, "", None, None, None, 10**7)]]
    schema = "kind string, frame long, patch long, image string, at long, logo long, parent long, s long"
    got, _ = replayed(spark, str(tmp_path), batches, schema, lambda s: stateful.three_way(s.withColumn("ts", F.timestamp_seconds("s")).drop("s"), 100_000, "1 minute"))
    assert sorted(got, key=str) == sorted(want, key=str)


def replay_pool(events, most):
    """A sequential replay of the pools."""
    pools, out = {}, []
    for logo, at, kind, template, value in sorted(events, key=lambda e: e[1:4]):
        pool = pools.setdefault(logo, [])
        if kind == "scan":
            pool.sort(key=lambda e: e[1], reverse=True)
            if len(pool) > most:
                out.append((logo, at, "evicted", *pool.pop(), True))
            out += [(logo, at, "tried", *e, True) for e in pool]
            continue
        found = False
        if kind == "add":
            found = len(pool) <= most
            if found:
                pool.append([template, 0])
        else:
            for e in pool:
                if e[0] == template and not found:
                    e[1], found = e[1] + value, True
        out.append((logo, at, kind, template, None, found))
    return sorted(out, key=str)


def test_template_pools_follow_a_replay(spark, tmp_path):
    rng = random.Random(7)
    events = [(f"logo{rng.randint(0, 2)}", at, rng.choice(["add", "hit", "hit", "scan"]), rng.randint(0, 9), rng.randint(0, 5)) for at in range(300)]
    got, _ = replayed(spark, str(tmp_path), [events[:100], events[100:110], events[110:]], "logo string, at long, kind string, template long, value long", lambda s: stateful.template_pool(s, 3))
    assert sorted(got, key=str) == replay_pool(events, 3)
    assert any(g[2] == "evicted" for g in got)


def test_the_query_of_template_pools_follows_a_replay(spark):
    from headwater import catalog, catalog_streams  # noqa: F401

    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity").collect()
    events = [(r[2] % 10, (at := r[0] * 8 + r[1]), ("add", "hit", "scan")[at % 3], r[3] % 20, int(r[4])) for r in lines]
    got = catalog.QUERIES["stream_templates"](spark, sf).select("logo", "at", "kind", "template", "priority", "done").collect()
    assert sorted(map(tuple, got), key=str) == replay_pool(events, 4)
