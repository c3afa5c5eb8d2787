"""Numbers and running aggregates in a global order, without putting the order into one task."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset and the master is local (tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(own or os.path.join(tempfile.gettempdir(), f"headwater-{uuid.uuid4().hex[:8]}"))
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, for small tables that a plan uses many times."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: list, sums: dict[str, str] | None = None, highs: dict[str, str] | None = None) -> DataFrame:
    """Adds the sum (`sums`: name to column) or the largest value (`highs`) of a column over all rows before this one in `order`.

    The rows are sorted over ranges and written to the shared folder; one row of totals for
    each range, as many as there are shuffle partitions, goes to the driver and back, and a
    task adds up one range. Rows that tie in `order` come in any order, the same for all sums.
    """
    sums, highs, spark = sums or {}, highs or {}, df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    path = f"{shared_dir(spark)}/ordered-{uuid.uuid4().hex}"
    ordered.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    ordered = spark.read.parquet(path)
    totals = ordered.groupBy("_range").agg(F.count("*"), *[F.sum(c) for c in sums.values()], *[F.max(c) for c in highs.values()])
    base, rows = [0 if df.schema[c].dataType.simpleString() != "double" else 0.0 for c in sums.values()] + [None] * len(highs), []
    for k, _, *own in sorted(totals.collect()):
        rows.append((k, *base))
        added = [b + (x or 0) for b, x in zip(base, own[: len(sums)], strict=False)]
        base = added + [max((x for x in pair if x is not None), default=None) for pair in zip(base[len(sums) :], own[len(sums) :], strict=True)]
    kinds = [f"`_base_{n}` {ordered.schema[c].dataType.simpleString()}" for n, c in (*sums.items(), *highs.items())]
    out = ordered.join(F.broadcast(spark.createDataFrame(rows, ", ".join(["_range int", *kinds]))), "_range")
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    made = {n: F.col(f"_base_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}
    made |= {n: F.greatest(F.col(f"_base_{n}"), F.max(c).over(inside)) for n, c in highs.items()}
    return out.select(*[f"`{c}`" for c in df.columns], *[c.alias(n) for n, c in made.items()])


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds the 0-based place of each row in a global order."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), order, {name: "_one"}).drop("_one")


def tiles(place: Column, rows: Column, n: int) -> Column:
    """1-based tile of n, as even as it goes, the first ones a row larger."""
    size, more = F.floor(rows / n), rows % n
    wide = more * (size + 1)
    return F.when(place < wide, F.floor(place / (size + 1))).otherwise(more + F.floor((place - wide) / F.greatest(size, F.lit(1)))).cast("long") + 1
