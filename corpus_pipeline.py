"""Corpus pipeline: toxicity, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of ``docs`` they were given.

Cases: documents of null or empty text are not toxic, no one's copies, hold no personal data, are
taken no times by the mix (they have no words), and so are not packed; a null source is a source of
its own; rows that repeat a ``doc_id``, or have none, are each judged by themselves; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayesloom.llm import minhash, mixing, packing, personal, queries, toxicity
from bayesloom.llm.common import cut_freed, if_few, with_row_key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under one half."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model, "_score").where("_score < 0.5").drop("_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity of 0.8 or more)."""
    rows = with_row_key(docs, "_row_key")
    found = minhash.near_duplicates(rows.select(F.col("_row_key").alias("doc_id"), "text"), width=5, percent=80)
    gone = cut_freed(found.where("not kept").select(F.col("doc_id").alias("_row_key")))
    return rows.join(if_few(gone), "_row_key", "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    clean = personal.redact(docs, personal.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    rows = with_row_key(docs, "_row_key")
    taken = mixing.mix(rows.select(F.col("_row_key").alias("doc_id"), "source", "text")).where("copies > 0")
    taken = taken.select(F.col("doc_id").alias("_row_key"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"))
    return rows.join(taken, "_row_key").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each at its place in a training sequence."""
    return packing.pack_documents(docs, queries.tokenizer_path(), capacity=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the models; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
