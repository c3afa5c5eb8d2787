"""Multi-party perspective rotation of conversations, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and all others as named users. Each rendering carries
the spans of characters to train on: the speaker's own words and end marks.

A rendering comes in parts of `turns` turns, counted within the conversation, so
the longest conversation never meets in one row or task. All turns are sorted over
ranges by (conversation, turn, role, text). A turn's place in its conversation is
its place in its range plus the turns of the conversation in earlier ranges; only
conversations that cross the edge of a range have such, so a few rows for each range
are all that is joined. A conversation meets its speakers in groups of SHARE parts.

Template of a turn: `<|im_start|>assistant\\n` or `<|im_start|>user name=...\\n`,
the text, `<|im_end|>\\n`. Where a text holds the template's own marks, their
first `|` is doubled, so a rendering can be parsed back.

Defined cases: null text renders as empty; a turn whose role is null is spoken
by `unknown`; null turn numbers come last; ties in the turn number go by role,
then text, and repeated rows are turns of their own; a null conv_id is a
conversation of its own; an empty text renders as empty; a very long text stays
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

TURNS = 64
UNKNOWN = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Parts of a conversation that meet its speakers in one task.
SHARE = 16


def numbered(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with n, the 0-based place in the conversation."""
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "text"]
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    rows = stage(rows.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "turns")
    sizes = rows.groupBy("conv_id", "_range").agg(F.count("*").alias("_size"))
    # conversations in several ranges: each crosses an edge, so there are at most two rows for each range
    several = sizes.groupBy("conv_id").agg(F.count("*").alias("_k"), F.array_sort(F.collect_list(F.struct("_range", "_size"))).alias("_own")).filter("_k > 1")
    before = lambda s, i: F.aggregate(F.slice("_own", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["_size"])
    several = several.select(F.col("conv_id").alias("_conv"), F.explode(F.transform("_own", lambda s, i: F.struct(s["_range"].alias("_of"), before(s, i).alias("_before")))).alias("_s")).select("_conv", "_s.*")
    inside = F.row_number().over(Window.partitionBy("_range", "conv_id").orderBy("_at")) - 1
    out = rows.withColumn("_inside", inside).join(F.broadcast(several), (F.col("_range") == F.col("_of")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return out.select("conv_id", "turn", "role", "text", (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("long").alias("n"))


def rotate(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """conv_id, perspective, part, n_turns, rendered, mask array<struct<first, last>> in characters, n_masked."""
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(UNKNOWN)).alias("role"),
        F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|im_"), F.lit("<||im_")).alias("text"),
    )
    parts = numbered(rows).groupBy("conv_id", F.floor(F.col("n") / turns).cast("long").alias("part"))
    parts = parts.agg(F.array_sort(F.collect_list(F.struct("n", "role", "text"))).alias("turns")).withColumn("_share", F.floor(F.col("part") / SHARE))
    shares = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.floor((F.count("*") - 1) / (turns * SHARE)).alias("_last"))
    speakers = rows.select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    speakers = speakers.join(shares, F.col("_conv").eqNullSafe(F.col("_c"))).select("_conv", "perspective", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("_of"))
    out = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_share") == F.col("_of")))
    own = lambda t: t["role"] == F.col("perspective")
    head = lambda t: F.when(own(t), F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), t["role"], F.lit("\n")))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(f"{CLOSE}\n")).alias("body"), own(t).alias("own")))
    out = out.select("conv_id", "perspective", "part", pieces.alias("_p"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("mask"))
    walk = F.aggregate(
        "_p",
        start,
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"])).cast("long").alias("at"),
            F.when(p["own"], F.concat(a["mask"], F.array(F.struct((a["at"] + F.length(p["head"])).cast("long").alias("first"), (a["at"] + F.length(p["head"]) + F.length(p["body"])).cast("long").alias("last"))))).otherwise(a["mask"]).alias("mask"),
        ),
        lambda a: a["mask"],
    )
    rendered = F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"])), "")
    out = out.select("conv_id", "perspective", "part", F.size("_p").cast("long").alias("n_turns"), rendered.alias("rendered"), walk.alias("mask"))
    return out.withColumn("n_masked", F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m["last"] - m["first"]))
