"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text: too few words, or too many words in 5-word windows
that the text holds twice. The method's own rule looks across documents: lines
are normalised (lower case, digits as 0, white space as one space) and hashed; a
line that more than `max_docs` distinct documents of a host hold is removed, and a
document that keeps less than `keep_percent` of its words is rejected as
depleted. Lines that the host repeats are thus navigation, notices and copies.

Texts are never shuffled: a document contributes one row for each distinct line
hash, counted by host with partial sums; a host that holds a third of all rows
spreads by line.

Defined cases: a null or empty text has no words and fails the base rules; lines
without a word are ignored; a null source is a host of its own; a null id counts
as a document of its own text; rows that share an id and a text are one
document for the counts and get a row each; an empty table gives an empty result;
other columns are ignored, and kept whatever their names by clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, stage

MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
MAX_DOCS = 20
KEEP_PERCENT = 30


def _words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def normal_line(line: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(line, GAP, " "), "[0-9]", "0")
    return F.trim(F.lower(spaced))


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; text stays."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_w", _words(text))
    out = out.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    gram = lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)])
    n = F.size("_w")
    out = out.withColumn("_g", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), gram)).otherwise(F.array().cast("array<bigint>")))
    # only texts that repeat a window need to know where
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    twice = lambda s, k: (s["g"] == F.get("_s", k - 1)["g"]) | (s["g"] == F.get("_s", k + 1)["g"])
    out = out.withColumn("_at", F.array_sort(F.transform(F.filter("_s", lambda s, k: F.coalesce(twice(s, k), F.lit(False))), lambda s: s["i"])))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end"))
    return out.select(
        *docs.columns,
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, GAP, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate("_at", zero, step, lambda a: a["n"]), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def line_counts(docs: DataFrame) -> DataFrame:
    """(uid, host, line, words) for each distinct normalised line of each document."""
    line = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: normal_line(x))
    lines = docs.select("uid", F.col("source").alias("host"), F.explode_outer(line).alias("_l")).filter("_l <> ''")
    lines = lines.select("uid", "host", F.xxhash64("_l").alias("line"), (F.length("_l") - F.length(F.replace("_l", F.lit(" "), F.lit(""))) + 1).cast("long").alias("w"))
    # a line's words once for each time it stands in the document; repeated rows of a document once
    return lines.groupBy("uid", "host", "line").agg(F.sum("w").alias("words"))


def _uid() -> Column:
    """Two independent hashes of a row's id, source and text."""
    return F.struct(F.xxhash64("doc_id", "source", "text").alias("a"), F.xxhash64("text", "source", "doc_id").alias("b")).alias("uid")


def common_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line, n_docs) of the normalised lines above the limit."""
    lines = line_counts(docs.select(_uid(), "source", "text"))
    return lines.groupBy("host", "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > max_docs)


def apply_rules(docs: DataFrame, max_docs: int = MAX_DOCS, keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """doc_id, the base counts, base_failed, n_common_words, kept."""
    docs = docs.select("doc_id", "source", "text")
    rows = docs.select("doc_id", _uid(), "text")
    base = base_counts(rows).drop("text")
    lines = stage(line_counts(docs.select(_uid(), "source", "text")), "lines")  # read twice
    copies = rows.groupBy("uid").count().filter("count > 1").select(F.col("uid").alias("_u"), F.col("count").alias("_copies"))
    common = lines.groupBy(F.col("host").alias("_host"), F.col("line").alias("_line")).agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > max_docs)
    lost = lines.join(common, (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host")))
    lost = lost.groupBy(F.col("uid").alias("_uid")).agg(F.sum("words").alias("_lost"))
    # words of a document that stands in several rows were summed over all of them
    lost = lost.join(copies, F.col("_uid") == F.col("_u"), "left").select("_uid", (F.col("_lost") / F.coalesce("_copies", F.lit(1))).cast("long").alias("n_common_words"))
    out = base.join(lost, F.col("uid") == F.col("_uid"), "left").withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("n_common_words")) < keep_percent * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_common_words")


def clean(docs: DataFrame, max_docs: int = MAX_DOCS, keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """The documents that pass, without their common lines; columns as given.

    A line is removed by the hash of its normal form; lines are looked up by document.
    """
    # the caller's columns ride in a struct, where their names can't clash with those made here
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_doc"), _uid())
    verdict = apply_rules(docs, max_docs, keep_percent)
    lines = line_counts(docs.select(_uid(), "source", "text"))
    common = common_lines(docs, max_docs).select(F.col("host").alias("_host"), F.col("line").alias("_line"))
    gone = lines.join(common, (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host"))).groupBy(F.col("uid").alias("_uid")).agg(F.collect_set("line").alias("_gone"))
    kept = verdict.filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    out = rows.join(kept, F.col("_doc")["doc_id"].eqNullSafe(F.col("_id")), "left_semi").join(gone, F.col("uid") == F.col("_uid"), "left")
    text = F.col("_doc")["text"]
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("_gone", F.xxhash64(normal_line(x)))), "\n")
    text = F.when(F.col("_gone").isNull(), text).otherwise(left)
    return out.select(*[(text if c == "text" else F.col("_doc")[c]).alias(c) for c in docs.columns])
