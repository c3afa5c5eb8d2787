"""Random-projection outliers: projected neighbours within a distance, united over projections."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import running


def unit_vectors(n: int, dim: int, seed: int = 7) -> list[list[float]]:
    """Gaussian directions of length 1."""
    rng = random.Random(seed)
    rows = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(n)]
    return [[round(x / sum(y * y for y in r) ** 0.5, 6) for x in r] for r in rows]


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def project(objects: DataFrame, vectors: list[list[float]], vector: str = "vector") -> DataFrame:
    """pid, pv for each object and direction; the directions are literals of the plan, no join."""
    spread = F.explode(F.array(*[F.struct(F.lit(i).alias("pid"), inner(F.col(vector), F.array(*map(F.lit, v))).alias("pv")) for i, v in enumerate(vectors)]))
    others = [c for c in objects.columns if c != vector]
    return objects.select(*others, spread.alias("_p")).select(*others, "_p.pid", "_p.pv")


def neighbours(projected: DataFrame, distance: float, key: str = "id") -> DataFrame:
    """pid, key, pv, n: others within `distance` (inclusive) on the projection; a key has one value on each.

    Values and the two ends of each value's window are sorted together over ranges; the
    number of values before an end is a running sum, so no task holds a projection or a
    dense part of it.
    """
    ends = ((0, -distance), (1, 0.0), (2, distance))  # a lower end comes before values equal to it, an upper one after
    spread = F.explode(F.array(*[F.struct(F.lit(k).alias("_kind"), (F.col("pv") + d).alias("_v"), F.lit(int(k == 1)).cast("long").alias("_one")) for k, d in ends])).alias("_e")
    points = projected.select(key, "pid", "pv", spread).select(key, "pid", "pv", "_e.*")
    counted = running(points, ["pid", "_v", "_kind"], {"_before": "_one"}).filter("_kind <> 1")
    at = lambda k: F.max(F.when(F.col("_kind") == k, F.col("_before")))
    return counted.groupBy(key, "pid", "pv").agg((at(2) - at(0) - 1).alias("n")).select(key, "pid", "pv", "n")


def latest(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def outliers(counted: DataFrame, least: int, projections: int, key: str = "id") -> DataFrame:
    """Objects that have fewer than `least` neighbours on some projection, once all projections are there."""
    flags = counted.groupBy(key).agg(F.bool_or(F.col("n") < least).alias("is_outlier"), F.countDistinct("pid").alias("_n"))
    return flags.filter(F.col("_n") == projections).select(key, "is_outlier")

