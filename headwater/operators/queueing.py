"""M/M/k queueing estimates and executor allocation as single plans.

A network is a table of nodes (comp, lam, mu, ratio), rates a second; an allocation
is (comp, k). Greedy allocation is one ranking: since the sojourn time is convex in
k, the R best marginal gains of all nodes are those the greedy loop would take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import staged


def utilisation(lam: Column, mu: Column, k: Column) -> Column:
    return F.when((mu > 0) & (k > 0), lam / (mu * k)).otherwise(F.lit(float("inf")))


def minimum(lam: Column, mu: Column) -> Column:
    """The fewest servers of a stable node."""
    return (F.floor(lam / mu) + 1).cast("long")


def sojourn(lam: Column, mu: Column, k: Column) -> Column:
    """Mean seconds in an M/M/k node; null if it isn't stable. Erlang B by its recursion, so k has no limit."""
    a = lam / mu
    b = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")), F.lit(1.0), lambda b, i: a * b / (i + a * b))
    rho = a / k
    wait = b / (1 - rho * (1 - b))
    return F.when((mu > 0) & (k > 0) & (rho < 1), wait * rho / ((1 - rho) * lam) + 1 / mu)


def single_server(lam: Column, mu: Column, k: Column) -> Column:
    return F.when(mu * k > lam, 1 / (mu * k - lam))


def network_latency(nodes: DataFrame, alloc: DataFrame, chain: bool = False) -> DataFrame:
    """One row: stable, latency in seconds (null if any node isn't stable)."""
    t = sojourn(F.col("lam"), F.col("mu"), F.col("k"))
    both = nodes.join(alloc, "comp").select(t.alias("t"), (F.lit(1.0) if chain else F.col("ratio")).alias("ratio"))
    stable = F.bool_and(F.col("t").isNotNull())
    return both.agg(stable.alias("stable"), F.when(stable, F.sum(F.col("t") * F.col("ratio"))).alias("latency"))


def ranked_gains(nodes: DataFrame, spare, chain: bool = False) -> DataFrame:
    """comp, k, gain, place: the marginal gain of each server beyond the minimum, best first.

    At most `spare` servers of each node matter (a number, or a table of one row), so the table
    has nodes * spare rows.
    """
    low = minimum(F.col("lam"), F.col("mu"))
    ratio = F.lit(1.0) if chain else F.col("ratio")
    wide = nodes.crossJoin(F.broadcast(_scalar(nodes, spare, "_spare")))
    steps = wide.select(*nodes.columns, F.explode(F.sequence(low, low + F.greatest(F.coalesce("_spare", F.lit(0)), F.lit(0)))).alias("k"), low.alias("k_min"))
    steps = steps.withColumn("t", sojourn(F.col("lam"), F.col("mu"), F.col("k")) * ratio)
    before = F.lag("t").over(Window.partitionBy("comp").orderBy("k"))
    gains = steps.withColumn("gain", before - F.col("t")).filter("k > k_min")
    return gains.select("comp", "k", "gain", F.row_number().over(Window.orderBy(F.desc("gain"), "comp", "k")).alias("place"))


def suggest(nodes: DataFrame, total, chain: bool = False, reach: int | None = None, gains: DataFrame | None = None) -> DataFrame:
    """comp, k: the best allocation of `total` servers; k is null where even the minimum doesn't fit.

    `total` may be a table of one row. `reach`: how many servers beyond its minimum a node can
    get, `total` by default. gains: those of ranked_gains(), if they are at hand.
    """
    low = minimum(F.col("lam"), F.col("mu"))
    needed = nodes.agg(F.sum(low).alias("need")).crossJoin(_scalar(nodes, total, "total"))
    spare = F.col("total") - F.col("need")
    gains = ranked_gains(nodes, total if reach is None else reach, chain) if gains is None else gains
    extra = gains.crossJoin(needed).filter(F.col("place") <= spare).groupBy("comp").agg(F.count("*").alias("extra"))
    return nodes.select("comp", low.alias("low")).join(extra, "comp", "left").crossJoin(needed).select("comp", F.when(spare >= 0, F.col("low") + F.coalesce("extra", F.lit(0))).cast("long").alias("k"))


def _scalar(nodes: DataFrame, value, name: str) -> DataFrame:
    """One row with a number, which may be given as a table of one row and column."""
    return value.toDF(name) if isinstance(value, DataFrame) else nodes.sparkSession.range(1).select(F.lit(value).alias(name))


def least_for(nodes: DataFrame, target: float, most, factor=1.0, chain: bool = False, reach: int | None = None, gains: DataFrame | None = None) -> DataFrame:
    """comp, k, status: the smallest allocation whose latency times factor is within target seconds.

    The latency after n gains is that of the minimum less their running sum. With `most`
    servers in all too few, or the sum of service times above the target, it is INFEASIBLE
    and k is null. `most` (None: no limit) and `factor` may be tables of one row. `reach`
    servers of each node beyond its minimum are tried, by default `most`. Without either, 200 are,
    and the answer is exact unless it needs more of one node.
    """
    low = minimum(F.col("lam"), F.col("mu"))
    ratio = F.lit(1.0) if chain else F.col("ratio")
    given = _scalar(nodes, factor, "factor").crossJoin(_scalar(nodes, (1 << 62) if most is None else most, "most"))
    base = nodes.agg(F.sum(low).alias("need"), F.sum(sojourn(F.col("lam"), F.col("mu"), low) * ratio).alias("start"), F.sum(ratio / F.col("mu")).alias("bound")).crossJoin(given)
    gains = ranked_gains(nodes, reach if reach is not None else 200 if most is None else most, chain) if gains is None else gains
    running = gains.select("comp", "place", F.sum("gain").over(Window.orderBy("place")).alias("saved"))
    tried = running.select("place", "saved").unionByName(nodes.sparkSession.createDataFrame([(0, 0.0)], "place int, saved double")).crossJoin(base)
    enough = (F.col("start") - F.col("saved")) * F.col("factor") <= target
    first = tried.filter(enough & (F.col("bound") * F.col("factor") < target) & (F.col("need") + F.col("place") <= F.col("most"))).agg(F.min("place").alias("n"))
    extra = running.crossJoin(first).filter("place <= n").groupBy("comp").agg(F.count("*").alias("extra"))
    out = nodes.select("comp", low.alias("low")).join(extra, "comp", "left").crossJoin(first)
    return out.select("comp", F.when(F.col("n").isNotNull(), F.col("low") + F.coalesce("extra", F.lit(0))).cast("long").alias("k"), F.when(F.col("n").isNotNull(), "FEASIBLE").otherwise("INFEASIBLE").alias("status"))


def check_optimised(nodes: DataFrame, alloc: DataFrame, real_ms, target_ms: float, most) -> DataFrame:
    """comp, k_now, k_min, k_opt, status, est_ms, ratio: the state of a network against its target.

    The model is scaled by how far it underestimates the real latency; the least allocation
    may use twice `most`. real_ms and most may be tables of one row. The nodes and their
    ranked gains, a few rows for each component, are written once, as both allocations use them.
    """
    nodes = staged(nodes)
    limit = _scalar(nodes, most, "most")
    gains = staged(ranked_gains(nodes, limit.select(F.col("most") * 2)))
    est = network_latency(nodes, alloc).select((F.col("latency") * 1000).alias("est_ms"))
    scaled = est.crossJoin(_scalar(nodes, real_ms, "real_ms"))
    scaled = scaled.select("est_ms", F.greatest(F.lit(1.0), F.coalesce(F.try_divide("real_ms", "est_ms"), F.lit(1.0))).alias("ratio"))
    least = least_for(nodes, target_ms / 1000, limit.select(F.col("most") * 2), scaled.select("ratio"), gains=gains)
    best = suggest(nodes, limit, gains=gains).withColumnRenamed("k", "k_opt")
    out = alloc.withColumnRenamed("k", "k_now").join(least.withColumnRenamed("k", "k_min"), "comp").join(best, "comp").crossJoin(scaled)
    return out.select("comp", F.col("k_now").cast("long").alias("k_now"), "k_min", "k_opt", "status", "est_ms", "ratio")


def workers(alloc: DataFrame, per_worker: int) -> DataFrame:
    return alloc.agg(F.ceil(F.sum("k") / per_worker).cast("long").alias("workers"), F.sum("k").cast("long").alias("executors"))


def moves(wanted: DataFrame, current: DataFrame) -> DataFrame:
    """comp, k_now, k_new of components whose allocation must change; none if nothing is wanted."""
    return wanted.withColumnRenamed("k", "k_new").join(current.withColumnRenamed("k", "k_now"), "comp", "full").filter(~F.col("k_new").eqNullSafe(F.col("k_now")))
