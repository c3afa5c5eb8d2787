"""The corpus pipeline: language ID, line dedup, near dedup, source mixing, packing.

Each stage takes all that its predecessor kept. The first four return the columns
of documents, the last one the packed pieces.

Defined cases: language ID drops null texts and texts without a letter, so later
stages see none; line dedup drops documents of which only blank lines are left;
null ids, ties, repeated rows and very long texts are treated as each operator
states; an empty table gives an empty result. Columns beyond those of documents
are kept, whatever their names: documents ride through the stages in a struct.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.llm import language_id, line_dedup, minhash, mixing, packing
from headwater.llm.common import shared_dir, staged_scope


def _whole(docs: DataFrame, *apart: str):
    """The columns of docs in a struct, but for those that travel apart; without any, a number."""
    if not set(docs.columns) - set(apart):
        return F.lit(0).alias("__doc")
    return F.struct(*[f"`{c}`" for c in docs.columns if c not in apart]).alias("__doc")


def _back(out: DataFrame, docs: DataFrame, **apart) -> DataFrame:
    """The columns of docs out of the struct, some of them replaced."""
    return out.select(*[(apart[c] if c in apart else F.col("__doc")[c]).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept, with the language found in lang."""
    model = language_id.train(docs.select("lang", "text"))
    found = language_id.predict(docs.select(_whole(docs), "text"), model).filter(~F.col("rejected"))
    return _back(found, docs, lang=F.col("lang_pred"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that stand elsewhere; those with nothing left go."""
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", _whole(docs, "doc_id", "text")))
    same = F.col("n_removed") == 0
    out = out.filter(same | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(same, F.col("__doc")["n_chars"]).otherwise(F.length("text").cast("long"))
    return _back(out, docs, **new)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    kept = minhash.near_duplicates(docs, words=5, percent=80, lower=True).filter("kept").select(F.col("doc_id").alias("__id")).distinct()
    out = docs.select(_whole(docs), F.col("doc_id").alias("__of"))
    return _back(out.join(kept, F.col("__of").eqNullSafe(F.col("__id")), "left_semi"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, as often as it takes each."""
    return mixing.sample_mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_repeated_lines),
    ("near dedup", remove_near_duplicates),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Character models, near-duplicate components and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as parquet in the shared folder and read by the next.

    What a stage has staged, and its input, are removed once its output is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with staged_scope(spark) as done:
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
            docs = spark.read.parquet(f"{base}/{i}")
            if before is not None:
                done.append(before)
        before = f"{base}/{i}"
    return docs
