"""Joins of ranges of whole numbers that overlap, without opening a range into its numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(first: Column, last: Column) -> Column:
    """The smallest power of two that isn't under the range's length: at this width a range lies in two cells at most."""
    return F.ceil(F.log2((last - first + 1).cast("double"))).cast("int")


def _cell(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at.cast("long"), level)


def _cells(first: Column, last: Column, level: Column) -> Column:
    low, high = _cell(first, level), _cell(last, level)
    return F.when(low == high, F.array(low)).otherwise(F.sequence(low, high))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], ranges: tuple[str, str, str, str]) -> DataFrame:
    """Pairs of rows with equal keys whose ranges share a number: the columns of left and right, keys once.

    ranges: first and last number of left's rows, first and last of right's; both ends belong to it, and rows
    whose first is after their last, or null, meet nothing. Columns other than keys have different names on both sides.

    A pair meets at the level of the longer of its ranges, where each covers a few cells of that width: the longer
    side is filed at its own level, the shorter one asks at each level that the other side has, up to 63
    whatever the lengths. So rows grow with the ranges, not with what they cover, and a
    pair counts in the cell of its first shared number alone.
    """
    lf, ll, rf, rl = ranges
    left = left.filter(F.col(lf) <= F.col(ll)).withColumn("_level", _level(F.col(lf), F.col(ll)))
    right = right.filter(F.col(rf) <= F.col(rl)).withColumn("_level", _level(F.col(rf), F.col(rl)))

    def meet(longer: DataFrame, shorter: DataFrame, own: tuple[str, str], asks: tuple[str, str], strictly: bool) -> DataFrame:
        filed = longer.withColumn("_at", F.col("_level")).withColumn("_cell", F.explode(_cells(*map(F.col, own), F.col("_level")))).drop("_level")
        levels = longer.agg(F.array_sort(F.collect_set("_level")).alias("_levels"))  # one row, 64 numbers at most
        asking = shorter.crossJoin(F.broadcast(levels)).withColumn("_at", F.explode(F.filter("_levels", lambda x: (x > F.col("_level")) if strictly else (x >= F.col("_level")))))
        asking = asking.withColumn("_cell", F.explode(_cells(*map(F.col, asks), F.col("_at")))).drop("_level", "_levels")
        pairs = filed.join(asking, [*keys, "_at", "_cell"])
        first, last = F.greatest(own[0], asks[0]), F.least(own[1], asks[1])
        return pairs.filter((first <= last) & (_cell(first, F.col("_at")) == F.col("_cell"))).drop("_at", "_cell")

    columns = [*keys, *[c for c in left.columns if c not in (*keys, "_level")], *[c for c in right.columns if c not in (*keys, "_level")]]
    return meet(left, right, (lf, ll), (rf, rl), False).select(columns).unionByName(meet(right, left, (rf, rl), (lf, ll), True).select(columns))


def within(points: DataFrame, at: str, ranges: DataFrame, keys: list[str], ends: tuple[str, str]) -> DataFrame:
    """Points with the ranges that hold them."""
    own = points.withColumns({"_from": F.col(at).cast("long"), "_to": F.col(at).cast("long")})
    wide = ranges.withColumns({e: F.col(e).cast("long") for e in ends})
    return overlapping(own, wide, keys, ("_from", "_to", *ends)).drop("_from", "_to")
