"""Sources: sentences, arrivals, batches and replays, all deterministic by seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines for load tests.
SENTENCES = (
    "a stream keeps no more than it must",
    "count what arrives and what leaves",
    "the slowest stage sets the pace",
    "three servers wait for one queue",
    "a late record is still a record",
    "balance the load before it hurts",
    "the window closes at the mark",
)


def sentences(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """sid, sentence: n uniform picks."""
    pick = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(SENTENCES))) + 1
    return spark.range(n).select(F.concat(F.lit("s-"), "id").alias("sid"), F.element_at(F.array(*map(F.lit, SENTENCES)), pick.cast("int")).alias("sentence"))


def stream_sentences(spark: SparkSession, per_second: int) -> DataFrame:
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    pick = F.pmod(F.xxhash64("value"), F.lit(len(SENTENCES))) + 1
    return rate.select("timestamp", F.concat(F.lit("s-"), "value").alias("sid"), F.element_at(F.array(*map(F.lit, SENTENCES)), pick.cast("int")).alias("sentence"))


def gaps(law: str, seed: int, rate: float, low: float = 0.0) -> Column:
    """Milliseconds between arrivals: fixed, poisson, or uniform in the rate between low and rate."""
    if law == "fixed":
        return F.lit(1000.0 / rate)
    if law == "poisson":
        return -F.log(1 - F.rand(seed)) * 1000.0 / rate
    if law == "uniform":
        return 1000.0 / (F.rand(seed) * (rate - low) + low)
    raise ValueError(law)


def arrivals(df: DataFrame, order: str, law: str, seed: int, rate: float, part: str) -> DataFrame:
    """Adds at_ms, the time of arrival of each record of a sender (`part`)."""
    return df.withColumn("at_ms", F.sum(gaps(law, seed, rate)).over(Window.partitionBy(part).orderBy(order)))


def batch_size(txid: Column, most: int) -> Column:
    """Size of a transaction's batch."""
    return txid * 13 % most + 1


def parse_objects(lines: DataFrame, count: int) -> DataFrame:
    """id, vector, time from n|ts|v1,v2,... lines; the id is n modulo count. Lines of another form are left out."""
    part = F.split("line", r"\|")
    ok = lines.filter(F.col("line").rlike(r"^\d+\|\d+\|[-0-9.eE,]+$"))
    return ok.select((part[0].cast("long") % count).alias("id"), F.transform(F.split(part[2], ","), lambda x: x.cast("double")).alias("vector"), part[1].cast("long").alias("time"))


def timed_replay(lines: DataFrame, speed: float) -> DataFrame:
    """at_ms, text from seconds@text lines, played `speed` times as fast."""
    sec = F.regexp_extract("line", r"^(\d+)@(.*)$", 1)
    return lines.filter(sec != "").select((sec.cast("long") * 1000 / speed).alias("at_ms"), F.regexp_extract("line", r"^(\d+)@(.*)$", 2).alias("text"))
