"""Sources: folders, frames, signals, paged scans, chunked bytes, bounded batches and feature indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def images(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """frame_id, img_bytes of the files of a folder; the id counts them in the order of their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    names = files.select("path")
    from ..functions.ordering import numbered

    ids = numbered(names, ["path"], "_i").select("path", F.format_string("s-%02d-%d", F.lit(0), F.col("_i") + 1).alias("frame_id"))
    return files.select("path", F.col("content").alias("img_bytes")).join(ids, "path").select("frame_id", "img_bytes")


def raw_frames(frames: DataFrame, first: int, every: int, width: int = 640, height: int = 480) -> tuple[DataFrame, DataFrame]:
    """The raw stream and the sample stream of decoded frames: (frame, mat), (frame, mat, sample_id).

    Frames before `first` are passed over. Frames of another size than width x height are
    scaled by nearest neighbours; mat is struct<rows, cols, type, data> of one byte a pixel.
    """
    import numpy as np

    def scale(parts):
        for part in parts:
            part = part.copy()
            out = []
            for m in part["mat"]:
                a = np.frombuffer(bytes(m["data"]), np.uint8).reshape(m["rows"], m["cols"])
                if a.shape != (height, width):
                    a = a[np.arange(height) * a.shape[0] // height][:, np.arange(width) * a.shape[1] // width]
                out.append({"rows": height, "cols": width, "type": m["type"], "data": a.tobytes()})
            part["mat"] = out
            yield part

    raw = frames.select("frame", "mat").filter(F.col("frame") >= first).mapInPandas(scale, frames.select("frame", "mat").schema)
    return raw, raw.filter(F.col("frame") % every == 0).withColumn("sample_id", F.floor(F.col("frame") / every).cast("long"))


def signals(df: DataFrame, kind: str, at: str) -> DataFrame:
    """sig_type, since, until: each control signal with the time for which it holds."""
    from pyspark.sql import Window

    return df.select(F.col(kind).alias("sig_type"), F.col(at).alias("since"), F.lead(at).over(Window.orderBy(at, kind)).alias("until"))


def repeated(df: DataFrame, text: str, times: int = 1000) -> DataFrame:
    """Records whose text is repeated, for load tests."""
    return df.withColumn(text, F.repeat(text, F.lit(times)))


def batches(df: DataFrame, place: str, most: int) -> DataFrame:
    """Adds txid, the transaction of a record by its 0-based place: transaction t >= 1 holds t * 13 % most + 1 records.

    The sizes repeat every `most` transactions, so a place is looked up in one cycle of them.
    """
    sizes = [t * 13 % most + 1 for t in range(1, most + 1)]
    ends = [sum(sizes[: i + 1]) for i in range(most)]
    cycle, inside = F.floor(F.col(place) / ends[-1]), F.col(place) % ends[-1]
    before = F.aggregate(F.array(*map(F.lit, ends)), F.lit(0), lambda n, e: n + F.when(e <= inside, 1).otherwise(0))
    return df.withColumn("txid", (cycle * most + before + 1).cast("long"))


def one_per_batch(df: DataFrame, place: str, tasks: int) -> DataFrame:
    """txid and the task that gets its single record: the place counts transactions from 1, dealt in turn."""
    txid = F.col(place) + 1
    return df.withColumn("txid", txid.cast("long")).withColumn("task", (txid % tasks).cast("long"))


def scan(df: DataFrame, place: str, start: int, most: int, page: int = 500) -> DataFrame:
    """Records [start, start + most) of a numbered table, left where they are, with the page that each is read in."""
    own = df.filter((F.col(place) >= start) & (F.col(place) < start + most))
    return own.withColumn("page", F.floor((F.col(place) - start) / page).cast("long"))


def joined_chunks(chunks: DataFrame, key: str, index: str, data: str) -> DataFrame:
    """key, data: byte strings put together from their chunks in the order of the index."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(data).alias("d")))), lambda s: s["d"])
    whole = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    return chunks.groupBy(key).agg(whole.alias(data))


def chunked(df: DataFrame, key: str, data: str, size: int = 1 << 20) -> DataFrame:
    """key, index, data: byte strings cut into chunks."""
    last = F.greatest(F.floor((F.octet_length(data) - 1) / size), F.lit(0))
    out = df.select(key, F.col(data).cast("binary").alias("_d"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("index"))
    return out.select(key, "index", F.substring("_d", (F.col("index") * size + 1).cast("int"), F.lit(size)).alias(data))


def feature_lines(lines: DataFrame, dim: int = 128) -> DataFrame:
    """id, feat, images of `f1,...,fn img1,img2,...` lines, id: the line's number; lines of another form are left out.

    lines: n (number), line. A worker of several takes the lines with n % pieces = its own.
    """
    part = F.split("line", " ")
    number = r"-?\d+"
    ok = lines.filter(F.col("line").rlike(rf"^{number}(?:,{number}){{{dim - 1}}} {number}(?:,{number})*$"))
    ints = lambda c, kind: F.transform(F.split(c, ","), lambda x: x.cast(kind))
    return ok.select(F.col("n").alias("id"), ints(part[0], "short").alias("feat"), ints(part[1], "int").alias("images"))


def first_rows(rows: Iterable, most: int) -> Iterator:
    """The first `most` items of an iterable; no more are drawn."""
    it = iter(rows)
    for _ in range(most):
        try:
            yield next(it)
        except StopIteration:
            return


def until(rows: Iterable, clock: Callable[[], float], deadline: float) -> Iterator:
    """Items of an iterable as long as the clock is before the deadline."""
    for x in rows:
        if clock() >= deadline:
            return
        yield x


def service_times(df: DataFrame, key: Column, mean_ms: float, salt: int, most: float = 10.0) -> DataFrame:
    """Adds service_ms, exponential with this mean and cut at `most` times it, drawn by key: what a simulated stage would take."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"~{salt}"))), 1, 8), 16, 10).cast("double")
    return df.withColumn("service_ms", F.least(-F.log(1 - bits / 4294967296.0) * mean_ms, F.lit(mean_ms * most)))


__all__ = ["batches", "chunked", "feature_lines", "first_rows", "images", "joined_chunks", "one_per_batch", "raw_frames", "repeated", "scan", "service_times", "signals", "until"]
