"""Shared helpers of the training-data operators.

Three things live here: access to the cluster's shared folder (staged tables,
which also cut lineage), byte kernels that let numpy work on the buffers of an
Arrow string column without making Python strings, and a distributed rank that
never puts a whole key into one task.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space: the complement of the contract's word class.
SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and the master is local (tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(own or os.path.join(tempfile.gettempdir(), f"headwater-{uuid.uuid4().hex[:8]}"))
    return sc.getCheckpointDir()


_SCOPES: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def staged_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the tables staged within it, and the paths added to what it gives, at its end, when their result must have been written."""
    own: list[str] = []
    _SCOPES.append(own)
    try:
        yield own
    finally:
        _SCOPES.remove(own)
        for path in own:
            _delete(spark, path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as parquet into the shared folder and read it back, which cuts its lineage durably."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing reads any more."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        _delete(df.sparkSession, f)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of steps whose results are written.

    The cleaner only sees what the driver's two collectors find unused, one after the other, and
    works in threads of its own: hence a second round and a short wait.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1.0)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for the small tables of a driver loop."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def made_schema(docs: DataFrame, others: list[str], made: str) -> StructType:
    """Some of docs' columns, whatever their names, then those of a list of names and types."""
    return StructType([*(docs.schema[c] for c in others), *StructType.fromDDL(made).fields])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def word_count(text: Column) -> Column:
    """Number of words, long; null counts 0. Splits once, no words are kept."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, GAP))).cast("long")


def shuffle_key(what: Column, seed: str) -> Column:
    """A uniform 60-bit number from the text of `what`; the same everywhere, also in other SQL engines."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(what.cast("string"), F.lit("")), F.lit(f"|{seed}"))), 1, 15), 16, 10).cast("long")


def ranked(df: DataFrame, keys: list[str], order: list[str], value: str | None, out: str, bits: int = 8) -> DataFrame:
    """Adds `out`: the sum of `value` (or the number of rows) before this row within keys, in `order`.

    order[0] must be a shuffle_key(). Its high bits split every key into 2**bits parts:
    sums by part are pre-aggregated, their running sums joined back, and one task orders
    only one part, so a key that holds a third of all rows still spreads over many.
    """
    amount = F.col(value) if value else F.lit(1)
    df = df.withColumn("_part", F.shiftright(F.col(order[0]), 60 - bits))
    sums = df.groupBy(*keys, "_part").agg(F.sum(amount).cast("long").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(sums, on)
        .withColumn(out, (F.col("_base") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).cast("long"))
        .drop("_part", "_p", "_base", *[f"_k{i}" for i in range(len(keys))])
    )


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds, for each (name, column) of sums, the column's sum over all rows before this one in `order`.

    A range sort; one row of totals for each range goes to the driver, as many as there
    are shuffle partitions, and one task adds up one range.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ordered = cut(ordered.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    totals = ordered.groupBy("_range").agg(*[F.sum(c).alias(c) for c in dict.fromkeys(sums.values())]).collect()
    kind = {c: df.schema[c].dataType.simpleString() for c in sums.values()}
    base, rows = {c: 0.0 if k == "double" else 0 for c, k in kind.items()}, []
    for r in sorted(totals, key=lambda r: r["_range"]):
        rows.append((r["_range"], *[base[c] for c in base]))
        base = {c: base[c] + (r[c] or 0) for c in base}
    before = F.broadcast(spark.createDataFrame(rows, ", ".join(["_range int", *[f"`_base_{c}` {k}" for c, k in kind.items()]])))
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = ordered.join(before, "_range")
    for name, c in sums.items():
        out = out.withColumn(name, F.col(f"_base_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_range", "_at", *[f"_base_{c}" for c in base])


# --- byte kernels -----------------------------------------------------------


class Slice:
    """Some rows of a batch: their texts' bytes end to end, and where each begins."""

    __slots__ = ("at", "first", "last", "raw")

    def __init__(self, first: int, last: int, raw: np.ndarray, at: np.ndarray):
        self.first, self.last, self.raw, self.at = first, last, raw, at

    @property
    def rows(self) -> int:
        return self.last - self.first


def slices(col: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[Slice]:
    """Runs of rows of about `limit` bytes, so that temporary arrays stay small; one longer text comes alone."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(col)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Slice(i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: A prime: two different texts of n bytes have one hash for n of this many bases at most.
PRIME = (1 << 61) - 1
_P, _P_BITS = np.uint64(PRIME), np.uint64(61)
_29, _30, _31, _32 = (np.uint64(x) for x in (29, 30, 31, 32))
_LOW29, _LOW30, _LOW31, _LOW32 = (np.uint64((1 << x) - 1) for x in (29, 30, 31, 32))


#: Numbers worked on at a time: temporary arrays of that size stay in a core's cache.
AT_ONCE = 1 << 13


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a1 * b0
    middle += a0 * b1
    a1 *= b1
    a1 += a1
    a0 *= b0
    a1 += a0
    a1 += middle >> _30
    middle &= _LOW30
    middle <<= _31
    a1 += middle
    return _reduced(a1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x mod PRIME, in place."""
    high = x >> _P_BITS
    x &= _P
    x += high
    x -= (x >= _P) * _P
    return x


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b mod PRIME, for numbers below it."""
    out = np.empty(len(a), np.uint64)
    b = np.broadcast_to(b, a.shape)
    for i in range(0, len(a), AT_ONCE):
        out[i : i + AT_ONCE] = _product(a[i : i + AT_ONCE], b[i : i + AT_ONCE])
    return out


class Roller:
    """Polynomial hash modulo a prime over random codes: any substring's hash from prefix sums.

    prefix[j] sums code[c_k] * base**-k for k < j, so (prefix[j] - prefix[i]) * base**i
    depends on the bytes of [i, j) alone.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.code = rng.permutation(np.arange(1, 1 << 16, dtype=np.uint64))[:256]  # of 16 bits, so that AT_ONCE products by half a power add up in a word
        self.base = int(rng.integers(1 << 40, PRIME))
        self.up = self.down = self.high = self.low = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << max(16, (n - 1).bit_length())
            for name, b in (("up", self.base), ("down", pow(self.base, -1, PRIME))):
                powers, made = np.ones(n, np.uint64), 1
                while made < n:
                    powers[made : 2 * made] = product(powers[:made], np.uint64(pow(b, made, PRIME)))
                    made *= 2
                setattr(self, name, powers)
            self.high, self.low = self.down >> _32, self.down & _LOW32

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw)
        self.grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        for i in range(0, n, AT_ONCE):
            code = self.code[raw[i : i + AT_ONCE]]
            high = np.cumsum(code * self.high[i : i + len(code)], dtype=np.uint64)
            code *= self.low[i : i + len(code)]
            low = np.cumsum(code, dtype=np.uint64)
            low += high >> _29  # high * 2**32, as 2**61 is 1
            high &= _LOW29
            high <<= _32
            low += high
            low += out[i]  # what all before add up to
            out[i + 1 : i + 1 + len(code)] = _reduced(low)
        return out

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """The prefix sums of codes below PRIME."""
        n = len(codes)
        self.grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        for i in range(0, n, AT_ONCE):
            terms = _product(codes[i : i + AT_ONCE], self.down[i : i + AT_ONCE][: len(codes[i : i + AT_ONCE])])
            high = np.cumsum(terms >> _31, dtype=np.uint64)
            terms &= _LOW31
            low = np.cumsum(terms, dtype=np.uint64)
            low += high >> _30
            high &= _LOW30
            high <<= _31
            low += high
            low += out[i]
            out[i + 1 : i + 1 + len(terms)] = _reduced(low)
        return out

    def spans(self, prefix: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.uint64)
        for k in range(0, len(i), AT_ONCE):
            a, b = i[k : k + AT_ONCE], j[k : k + AT_ONCE]
            x = prefix[b]
            x += _P - prefix[a]
            out[k : k + AT_ONCE] = mix(_product(_reduced(x), self.up[a]))
        return out


class Trigger:
    """The same modulo 2**64: cheaper, but there are texts that it confuses whatever its base.

    For choosing places by content, where equal hashes of different spans do no harm, and beside a Roller.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.code = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << max(16, (n - 1).bit_length())
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                powers = np.full(n, b & (1 << 64) - 1, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        self.grow(len(raw) + 1)
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.code[raw] * self.down[: len(raw)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return mix((prefix[j] - prefix[i]) * self.up[i])

    def rolling(self, raw: np.ndarray, width: int) -> np.ndarray:
        """The hashes of all spans of a width."""
        prefix = self.prefix(raw)
        return (prefix[width:] - prefix[:-width]) * self.up[: len(prefix) - width]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(s: Slice, gap: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a slice, and for each row where its words begin (rows + 1 entries).

    gap: for each byte, whether it parts words.
    """
    n = len(s.raw)
    ink = ~gap[s.raw]
    edge = np.zeros(n + 1, bool)
    edge[s.at] = True
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, ink
    now = np.append(ink, False)
    starts = np.flatnonzero(now & (~before | edge))
    ends = np.flatnonzero(before & (~now | edge))
    return starts, ends, np.searchsorted(starts, s.at)


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over [first[i], first[i+1]); empty runs give 0. values may have a second axis."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else values.dtype)
    np.cumsum(values, axis=0, out=total[1:], dtype=total.dtype)
    return total[first[1:]] - total[first[:-1]]
