"""Word streams: splitting, marking, routing, signed records and running counts as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[ \t\n\r\f]+"


def split_words(df: DataFrame, text: str = "text", clean: bool = True) -> DataFrame:
    """A row for each word; clean drops punctuation and symbols and lowers the case, otherwise words stay as they are."""
    t = F.col(text)
    if clean:
        t = F.lower(F.regexp_replace(t, r"\p{P}|\p{S}", " "))
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.explode(F.split(t, BLANK)).alias("word")).filter("word <> ''")


def word_count(df: DataFrame, text: str = "text") -> DataFrame:
    return split_words(df.select(text), text).groupBy("word").agg(F.count("*").alias("cnt"))


def distinct_words(df: DataFrame, text: str = "text") -> DataFrame:
    return split_words(df.select(text), text).agg(F.countDistinct("word").alias("n_words"))


def bang(df: DataFrame) -> DataFrame:
    return df.withColumn("word", F.concat("word", F.lit("!!")))


def coin(key: Column, salt: int, p: float) -> Column:
    """A deterministic Bernoulli(p) draw by key; null keys draw as the empty text."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{salt}"))), 1, 8), 16, 10).cast("long")
    return bits < int(p * (1 << 32))


def two_paths(df: DataFrame, key: str, p: float) -> dict[str, DataFrame]:
    """Two named streams: P for heads, NotP for tails."""
    heads = coin(F.col(key), 0, p)
    return {"P": df.filter(heads), "NotP": df.filter(~heads)}


def loop_passes(key: Column, p: float, cap: int) -> Column:
    """How often a record goes through a loop that it re-enters with probability p, at most cap times."""
    passes: Column = F.lit(cap)
    for i in range(cap - 1, 0, -1):
        passes = F.when(~coin(key, i, p), F.lit(i)).otherwise(passes)
    return passes.cast("long")


def signed(df: DataFrame, text: str = "text") -> DataFrame:
    """sentence, is_add from text whose first character is + for an addition."""
    return df.select(*[c for c in df.columns if c != text], F.expr(f"substring({text}, 2)").alias("sentence"), (F.left(text, F.lit(1)) == "+").alias("is_add"))


def signed_word_count(df: DataFrame, text: str = "text") -> DataFrame:
    words = split_words(signed(df, text).select("is_add", "sentence"), "sentence")
    return words.groupBy("word").agg(F.sum(F.when(F.col("is_add"), 1).otherwise(-1)).alias("cnt")).filter("cnt <> 0")


def pattern_bucket(ids: Column, n: int) -> Column:
    """The bucket of an array of ids by a 32-bit polynomial hash (31 h + id, from 1), wrapped in 64-bit numbers."""
    wrap = lambda x: F.pmod(x + 2147483648, F.lit(4294967296)) - 2147483648
    return F.abs(F.aggregate(ids, F.lit(1).cast("long"), lambda h, e: wrap(h * 31 + e))) % n


def sent_to(df: DataFrame, bucket: str, tasks: int) -> DataFrame:
    """Direct grouping: each row lies in the partition of its bucket's number, modulo the tasks; a null bucket goes to the first."""
    return df.repartitionById(tasks, F.coalesce(F.pmod(F.col(bucket), F.lit(tasks)), F.lit(0)).cast("int"))
