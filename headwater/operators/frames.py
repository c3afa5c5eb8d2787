"""Frame grids: patches, completion by count, overlays and reordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import running

#: Colours of overlays by logo, in the order in which results are expected.
COLOURS = ("magenta", "yellow", "cyan", "blue", "green", "red", "black")


def grid(width: int, height: int, share: float = 0.25, step: float = 0.5) -> tuple[int, int, int, int]:
    """Patch width and height and the steps between patches."""
    half = lambda v: int(v + 0.5)
    w, h = half(share * width), half(share * height)
    return w, h, half(step * w), half(step * h)


def patches(frames: DataFrame, width: int = 640, height: int = 480) -> DataFrame:
    """A row x, y, w, h for each patch of each frame, with the number of patches of the frame."""
    w, h, dx, dy = grid(width, height)
    xs, ys = list(range(0, width - w + 1, dx)), list(range(0, height - h + 1, dy))
    out = frames.select("*", F.explode(F.array(*map(F.lit, xs))).alias("x")).select("*", F.explode(F.array(*map(F.lit, ys))).alias("y"))
    return out.select("*", F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(len(xs) * len(ys)).alias("patch_count"))


def complete(detected: DataFrame, every: int = 1) -> DataFrame:
    """frame, logo, n_rects of samples whose patches have all come, repeated for the `every` frames that follow.

    detected: frame, logo, patch_count, rect (null where nothing was found).
    """
    got = detected.groupBy("frame", "logo").agg(F.count("*").alias("n"), F.max("patch_count").alias("want"), F.count("rect").alias("n_rects"), F.array_sort(F.collect_list("rect")).alias("rects"))
    done = got.filter("n = want")
    return done.select(F.explode(F.sequence(F.col("frame"), F.col("frame") + every - 1)).alias("frame"), "logo", "n_rects", "rects")


def overlays(frames: DataFrame, found: DataFrame) -> DataFrame:
    """frame, logo, colour, n_rects for frames that are there."""
    colours = F.array(*map(F.lit, COLOURS))
    return frames.select("frame").join(found, "frame").select("frame", "logo", F.element_at(colours, (F.col("logo") % len(COLOURS) + 1).cast("int")).alias("colour"), "n_rects")


def reorder(arrivals: DataFrame, patience: int) -> DataFrame:
    """frame, emitted_at of frames in ascending order; a frame that comes over `patience` places late is dropped.

    arrivals: frame, at (place of arrival, without gaps). A frame is passed over once a later
    one has waited `patience` arrivals; it is late if it comes after that. The largest frame
    so far is a running maximum over ranges of arrivals, looked up `patience` places back.
    """
    passed = running(arrivals, ["at"], highs={"_high": "frame"}).select((F.col("at") + patience - 1).alias("at"), F.col("_high").alias("passed"))
    late = arrivals.join(passed, "at", "left")
    return late.filter("passed IS NULL OR frame > passed").select("frame", F.col("at").alias("emitted_at"))


def sample(frames: DataFrame, every: int, first: int = 0) -> DataFrame:
    """Frames from `first` on that go to the sample stream, with sample_id, their running number."""
    kept = frames.filter((F.col("frame") >= first) & (F.col("frame") % every == 0))
    return kept.withColumn("sample_id", F.floor(F.col("frame") / every).cast("long"))


def three_way(frames: DataFrame, patches: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patches and template updates with the frames they belong to, in whatever order the three came.

    frames: frame, image; patches: frame, patch and more; updates: host_frame, host_patch,
    at, logo, parent and more. The first of repeated frames counts, and the first update of
    a host patch. Gives (patches with image, updates with image); what has no frame yet is
    left out.
    """
    image = frames.groupBy("frame").agg(F.min("image").alias("image"))
    rest = [c for c in updates.columns if c not in ("host_frame", "host_patch", "at")]
    first = updates.groupBy("host_frame", "host_patch").agg(F.min_by(F.struct("at", *rest), F.struct("at", *rest)).alias("_u")).select("host_frame", "host_patch", "_u.*")
    return patches.join(image, "frame"), first.join(image.withColumnRenamed("frame", "host_frame"), "host_frame")


def crop(mat: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """The part of an image, struct<rows, cols, type, data> of one byte a pixel, that lies in a rectangle; null if the rectangle isn't wholly inside."""
    row = lambda r: F.hex(F.substring(mat["data"], r * mat["cols"] + x + 1, width))
    data = F.unhex(F.array_join(F.transform(F.sequence(y, y + height - 1), row), ""))
    inside = (x >= 0) & (y >= 0) & (width > 0) & (height > 0) & (x + width <= mat["cols"]) & (y + height <= mat["rows"])
    return F.when(inside, F.struct(height.cast("int").alias("rows"), width.cast("int").alias("cols"), mat["type"].alias("type"), data.alias("data")))
