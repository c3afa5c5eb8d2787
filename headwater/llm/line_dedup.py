"""Removal of repeated runs of lines by content-defined chunks, in DataFrame functions only.

A rolling hash over the hashes of a line and the one before it ends a chunk where
it falls into one class of DIVISOR, so an inserted or deleted line moves no
boundary but its own. Chunks of at least two lines are counted by hash over all
documents with partial sums. Of a chunk that repeats, the occurrence in the
smallest (doc_id, place) stays; the others go if their bytes equal those of the
one that stays.

Only chunks whose hash repeats bring their bytes to the comparison, and texts
move once, to be written anew. The rows of the most frequent chunks, a number of
fixed size, are dealt over many tasks by salt, and what they are joined with is
repeated for each salt.

Defined cases: a null text stays null and has no chunk; blank lines belong to
chunks, but a chunk needs `least` lines that are not blank to be removed; rows
that share id and text are one document and are treated alike; a null id comes
after all others; an empty table gives an empty result; other columns are kept
as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIVISOR = 4
LEAST = 2
#: Multiplier and modulus of the rolling hash.
FACTOR, MODULUS = 1_000_003, 2_147_483_647
LAST_ID = 9223372036854775807


#: Most frequent chunks, whose rows are spread over SPREAD tasks each. The rest have less than one in HOT of all rows.
HOT, SPREAD = 1000, 64


def _uid() -> Column:
    """Two independent hashes of a row's id and text."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", "doc_id").alias("b")).alias("uid")


def _key(chunk: Column) -> Column:
    """112 bits or more of a chunk; equality of bytes is tested after."""
    return F.struct(F.xxhash64(chunk).alias("a"), (F.crc32(chunk.cast("binary")) * (1 << 31) + F.length(chunk)).alias("b")).alias("key")


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def with_chunks(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """docs with _chunks: the text's chunks in order, each an array of lines."""
    out = docs.withColumn("_lines", F.split("text", "\n", -1))
    out = out.withColumn("_hash", F.transform("_lines", lambda x: line_hash(x)))
    ends = lambda i: (F.coalesce(F.get("_hash", i - 1), F.lit(0)) * FACTOR + F.get("_hash", i)) % MODULUS % divisor == 0
    n = F.size("_lines")
    out = out.withColumn("_ends", F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: ends(i) | (i == n - 1)))
    from_ = lambda k: F.coalesce(F.get("_ends", k - 1) + 1, F.lit(0))
    chunks = F.transform("_ends", lambda e, k: F.slice("_lines", from_(k) + 1, e - from_(k) + 1))
    return out.withColumn("_chunks", F.when(F.col("text").isNotNull(), chunks)).drop("_lines", "_hash", "_ends")


def _candidates(docs: DataFrame, divisor: int, least: int) -> DataFrame:
    """(doc_id, uid, place, chunk) of every chunk with enough lines."""
    rows = with_chunks(docs.select("doc_id", _uid(), "text"), divisor)
    # outer: a plain explode gets a filter on the array's size, which is pushed into, and spells out, the steps above
    rows = rows.select("doc_id", "uid", F.posexplode_outer("_chunks").alias("place", "lines"))
    full = F.size(F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))) >= least
    return rows.filter(full).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), "uid", "place", F.array_join("lines", "\n").alias("chunk"))


def repeated_chunks(docs: DataFrame, texts: DataFrame, divisor: int = DIVISOR, least: int = LEAST) -> DataFrame:
    """(uid, place) of every occurrence that goes; texts: docs with uid, partitioned by it."""
    found = _candidates(docs, divisor, least).select("doc_id", "uid", "place", _key(F.col("chunk")))
    order = F.struct("doc_id", "uid", "place")
    stays = found.groupBy("key").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).filter("first <> last").select("key", "first", "n")
    # of fixed size, so it can be sent to all
    hot = stays.orderBy(F.desc("n"), "key").limit(HOT).select(F.col("key").alias("_hot"))
    spread = lambda df: df.join(F.broadcast(hot), F.col("key") == F.col("_hot"), "left").withColumn("_parts", F.when(F.col("_hot").isNull(), 1).otherwise(SPREAD)).drop("_hot")
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("salt")
    own = F.pmod(F.xxhash64("uid"), F.col("_parts")).cast("int").alias("salt")
    again = spread(found).select("uid", "place", order.alias("_at"), "key", own, "_parts").join(spread(stays).select("key", "first", every), ["key", "salt"])
    again = again.select("uid", F.struct("place", "key", "salt", "_parts", (F.col("_at") == F.col("first")).alias("stays")).alias("_c"))
    again = again.groupBy(F.col("uid").alias("_uid")).agg(F.collect_set("_c").alias("_wanted"))
    # only chunks whose hash repeats bring their bytes
    rows = with_chunks(texts.join(again, F.col("uid") == F.col("_uid")), divisor)
    wanted = lambda c: F.struct(*[c[n].alias(n) for n in ("place", "key", "salt", "_parts", "stays")], F.array_join(F.get("_chunks", c["place"]), "\n").alias("chunk"))
    rows = rows.select("uid", F.explode_outer(F.transform("_wanted", wanted)).alias("c")).select("uid", "c.*")
    kept = rows.filter("stays").select("key", "_parts", F.col("chunk").alias("bytes")).dropDuplicates(["key"]).select("key", "bytes", every)
    return rows.filter("not stays").join(kept, ["key", "salt"]).filter(F.col("chunk") == F.col("bytes")).select("uid", "place")


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR, least: int = LEAST) -> DataFrame:
    """docs with the repeated chunks cut out of text, and n_chunks, n_removed (chunks)."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # the other columns ride in a struct, where their names can't clash with those made here
    riding = [F.struct(*[f"`{c}`" for c in rest]).alias("_rest")] if rest else []
    texts = docs.select("doc_id", "text", *riding, _uid()).repartition("uid")  # one exchange for the comparison and the result
    gone = repeated_chunks(docs, texts, divisor, least).groupBy(F.col("uid").alias("_uid")).agg(F.collect_set("place").alias("_gone"))
    out = texts.join(gone, F.col("uid") == F.col("_uid"), "left")
    out = with_chunks(out, divisor)
    left = F.filter("_chunks", lambda c, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(left), "\n"))
    made = F.struct(
        text.alias("text"),
        F.coalesce(F.size("_chunks"), F.lit(0)).cast("long").alias("n_chunks"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
    # a caller's filter on these columns can't be pushed below a generator, where it would spell out all steps for every line
    out = out.select("doc_id", *["_rest" for _ in riding], F.explode_outer(F.array(made)).alias("_made"))
    columns = {"doc_id": F.col("doc_id"), "text": F.col("_made")["text"]}
    return out.select(*[columns.get(c, F.col("_rest")[c]).alias(c) for c in docs.columns], F.col("_made")["n_chunks"].alias("n_chunks"), F.col("_made")["n_removed"].alias("n_removed"))
