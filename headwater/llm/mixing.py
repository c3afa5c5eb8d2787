"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled (a hash of the id), and each document gets
a virtual finish time: the source's tokens up to it, divided by the source's
target. A source is queued up to `repeats` times, one pass after the other. All
queues together are sorted by finish time over ranges, a running sum over the
ranges finds where the total budget is spent, and the order is cut there. Since all
sources advance in proportion to their targets, each has about reached its own
where the budget ends.

A document is served whole or not at all in each pass, so its tokens count up to
its middle: it is served if the greater part of it lies before the cut. (Counted to
their ends, documents that are begun at the cut would all be left out, the sources
of few long documents would fall short by them, and the others would get the
rest.) A source misses its target by about half a document at most.

The order is a range sort written to the shared folder; one sum for each range
goes to the driver, and the range that holds the cut is sorted into ranges again
until it has few rows.

Targets: sources by code point, null last, weigh `weights` in turn and share the
budget; a target stops at `repeats` times the source's size and the excess is
shared anew by weight. The rate at which no excess is left is found by one running
sum over the sources in the order in which they fill up.

Defined cases: a null text has size 0 and is not taken; a null source is a source
of its own; repeated rows are served each; a null id is ordered as the empty
text; an empty table gives an empty result; other columns are ignored, and kept
whatever their names by sample_mixture().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked, running, shuffle_key, stage, word_count

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = "mix-1"
#: Rows among which the cut is looked for one by one.
FEW = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target from (source, size): shares of the total, capped and reshared."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1).cast("long"))
    numbered = running(sources, [F.col("source").asc_nulls_last()], {"_n": "_one"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    numbered = cut(numbered.select("source", "source_size", weight.alias("_w"), (F.lit(float(repeats)) * F.col("source_size")).alias("_cap")))
    total, weighed = numbered.agg(F.sum("source_size"), F.sum("_w")).first()
    if not total:
        return numbered.select("source", "source_size", F.lit(0.0).alias("target"))
    # sources fill up in the order of cap over weight; before each, what is left is shared at this rate
    filled = running(numbered.withColumn("_full_at", F.col("_cap") / F.col("_w")), [F.col("_full_at"), F.col("source").asc_nulls_last()], {"_spent": "_cap", "_gone": "_w"})
    rate = (F.lit(float(total)) - F.col("_spent")) / (F.lit(float(weighed)) - F.col("_gone"))
    rate = filled.select(rate.alias("rate"), "_full_at").filter("rate <= _full_at").agg(F.max("rate")).first()[0] or 0.0
    return numbered.select("source", "source_size", F.least("_cap", F.col("_w") * F.lit(max(rate, 0.0))).alias("target"))


def _order() -> list[Column]:
    return [F.col(c) for c in ("finish", "source", "_key", "_pass", "_id", "size", "_row")]


def _truncated(queued: DataFrame, budget: int) -> DataFrame:
    """The rows of the global order by finish time up to where the sizes add up to the budget."""
    spark = queued.sparkSession
    served, spent = [], 0
    while True:
        ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = queued.repartitionByRange(ranges, *_order()).sortWithinPartitions(*_order()).withColumn("_range", F.spark_partition_id())
        ordered = stage(ordered, "queue")
        sums = sorted(ordered.groupBy("_range").agg(F.sum("size"), F.count("*")).collect())
        cut_at, rows = None, 0
        for k, size, n in sums:
            if spent + size > budget:
                cut_at, rows = k, n
                break
            spent += size
        if cut_at is None:
            return _united([*served, ordered.drop("_range")])
        served.append(ordered.filter(F.col("_range") < cut_at).drop("_range"))
        queued = ordered.filter(F.col("_range") == cut_at).drop("_range")
        if rows <= FEW or len(sums) == 1:
            break
    last = running(queued, _order(), {"_spent": "size"})
    return _united([*served, last.filter(F.lit(spent) + F.col("_spent") + F.col("size") / 2 <= budget).drop("_spent")])


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, and the virtual finish time of the first pass."""
    key = shuffle_key(F.col("doc_id"), seed)
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("_key"))
    sizes = stage(sizes.withColumn("_row", F.monotonically_increasing_id()), "sizes")
    targets = cut(source_targets(sizes.select("source", "size"), weights, repeats))
    budget = targets.agg(F.sum("source_size")).first()[0] or 0  # the targets' sum, exactly
    before = ranked(sizes, ["source"], ["_key", "doc_id", "size"], "size", "before")
    targets = targets.withColumnRenamed("source", "_source")
    rows = before.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("finish", F.when(F.col("target") > 0, (F.col("before") + F.col("size") / 2) / F.col("target")))
    rows = stage(rows.drop("before"), "queues")
    passes = F.explode(F.array(*[F.lit(k) for k in range(repeats)])).alias("_pass")
    again = F.col("finish") + F.col("_pass") * F.col("source_size") / F.col("target")
    queued = rows.filter("size > 0 and target > 0").select(again.alias("finish"), "source", "_key", passes, F.col("doc_id").alias("_id"), "size", "_row")
    copies = _truncated(queued, budget).groupBy(F.col("_row").alias("_of")).agg(F.count("*").alias("_copies"))
    out = rows.join(copies, F.col("_row") == F.col("_of"), "left").withColumn("copies", F.coalesce("_copies", F.lit(0)).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "finish")


def sample_mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """The documents of the mixture, as often as each is served; documents not served are gone.

    Rows that share an id are served alike: each as often as the mean of them, rounded up.
    """
    copies = mix(docs, weights, repeats, seed).groupBy(F.col("doc_id").alias("__id")).agg(F.ceil(F.avg("copies")).cast("int").alias("__copies")).filter("__copies > 0")
    whole = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("__doc"), F.col("doc_id").alias("__of"))
    out = whole.join(copies, F.col("__of").eqNullSafe(F.col("__id")))
    return out.select("__doc", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__doc.*")
