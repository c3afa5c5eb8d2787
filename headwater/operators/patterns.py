"""Maximal frequent patterns over baskets that are added and removed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import numbered, staged

MOST = 16


def dictionary(words: DataFrame, column: str) -> DataFrame:
    """id, word in the order of the words."""
    return numbered(words.select(F.col(column).alias("word")).distinct(), ["word"], "id").select(F.col("id").cast("int").alias("id"), "word")


def subsets(baskets: DataFrame, key: str, is_add: str, item: str, most: int = MOST, keep: list[str] | None = None) -> DataFrame:
    """pattern, is_add and the columns of keep: every non-empty subset of each basket's distinct items, as a sorted array.

    A basket of more than `most` items raises an error: it has over 2**most subsets. To find
    frequent patterns only, mine() does without them.
    """
    keep = keep or []
    sets = baskets.groupBy(key, is_add, *keep).agg(F.array_sort(F.collect_set(item)).alias("_w"))
    n = F.size("_w")
    whole = F.when(n <= most, F.col("_w")).otherwise(F.raise_error(F.lit(f"a basket has more than {most} items")).cast("array<int>"))
    masks = F.sequence(F.lit(1), F.pow(F.lit(2.0), n).cast("int") - 1)
    sets = sets.select(F.col(is_add).alias("is_add"), *keep, whole.alias("_w")).filter(F.size("_w") > 0)
    return sets.select("is_add", *keep, F.explode(F.transform(masks, lambda m: F.filter("_w", lambda x, i: F.getbit(m.cast("long"), i) == 1))).alias("pattern"))


def frequent(patterns: DataFrame, threshold: int) -> DataFrame:
    counts = patterns.groupBy("pattern").agg(F.sum(F.when(F.col("is_add"), 1).otherwise(-1)).alias("cnt"))
    return counts.filter(F.col("cnt") >= threshold)


def mine(baskets: DataFrame, key: str, is_add: str, item: str, threshold: int) -> DataFrame:
    """pattern, cnt: what frequent() finds among all subsets, level by level over projected baskets.

    A basket is projected on a pattern that it holds: the pattern and the basket's items after its
    last one. A level adds one of these items. Only patterns that were added `threshold` times
    at least go on: retractions lower a count, but no larger pattern is added more often, so
    nothing is lost, and a basket of many items costs no more than the frequent patterns in it.
    A level is counted by one partial aggregation and written once.
    """
    items = baskets.select(F.col(key).alias("_k"), F.col(is_add).alias("is_add"), F.col(item).alias("_i")).filter("_i IS NOT NULL").distinct()
    added = F.count_if("is_add").alias("added")
    often = items.groupBy("_i").agg(added).filter(F.col("added") >= threshold).select("_i")
    rest = items.join(often, "_i", "left_semi").groupBy("_k", "is_add").agg(F.array_sort(F.collect_list("_i")).alias("rest"))
    none = F.array().cast(rest.schema["rest"].dataType)
    level, found = staged(rest.select("is_add", none.alias("pattern"), "rest")), []
    while True:
        longer = level.select("is_add", "pattern", "rest", F.posexplode("rest").alias("_p", "_x"))
        longer = longer.select("is_add", F.concat("pattern", F.array("_x")).alias("pattern"), F.slice("rest", F.col("_p") + 2, F.size("rest")).alias("rest"))
        counts = staged(longer.groupBy("pattern").agg(added, F.count("*").alias("n")).filter(F.col("added") >= threshold))
        found.append(counts.select("pattern", (2 * F.col("added") - F.col("n")).alias("cnt")).filter(F.col("cnt") >= threshold))
        if not counts.limit(1).count():
            return reduce(DataFrame.unionByName, found)
        level = staged(longer.join(counts.select("pattern"), "pattern", "left_semi").filter(F.size("rest") > 0))


def maximal(found: DataFrame) -> DataFrame:
    """Frequent patterns without a frequent proper superset, of whatever size: signed counts may rise as patterns grow.

    A join for containment: a superset holds the pattern's rarest item, so only the patterns with
    that item are looked at.
    """
    found = staged(found)
    items = found.select("pattern", F.explode("pattern").alias("_i"))
    rare = items.groupBy("_i").agg(F.count("*").alias("_n"))
    probe = items.join(rare, "_i").groupBy("pattern").agg(F.min_by("_i", F.struct("_n", "_i")).alias("_i"))
    larger = items.select(F.col("pattern").alias("_super"), "_i")
    inside = (F.size("_super") > F.size("pattern")) & (F.size(F.array_except("pattern", "_super")) == 0)
    covered = probe.join(larger, "_i").filter(inside).select("pattern").distinct()
    return found.join(covered, "pattern", "left_anti")


def report(found: DataFrame, words: DataFrame) -> DataFrame:
    """Patterns as words, comma-separated in the order of ids."""
    named = found.select("pattern", "cnt", F.explode("pattern").alias("id")).join(words, "id")
    return named.groupBy("pattern", "cnt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda s: s["word"]), ",").alias("words")).select("words", "cnt")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """pattern, appeared: the change log between two snapshots of maximal patterns."""
    new = after.select("pattern").join(before.select("pattern"), "pattern", "left_anti").withColumn("appeared", F.lit(True))
    gone = before.select("pattern").join(after.select("pattern"), "pattern", "left_anti").withColumn("appeared", F.lit(False))
    return new.unionByName(gone)
