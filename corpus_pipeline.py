"""The corpus pipeline: stages over documents, each written as Parquet before the next one reads it.

All stages but the last return the columns of ``documents``. Rows under one id
go or stay together; a row without an id is never dropped, for no decision can
name it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphprop.llm import pii
from graphprop.llm.decontaminate import decontaminate
from graphprop.llm.near_dedup import NearDedup, near_duplicates
from graphprop.llm.packing import packed
from graphprop.llm.store import Scratch
from graphprop.llm.toxicity import toxicity


#: The stage links from 0.8; a pair at 0.8 shares none of the 31 bands of 4 once in 12 million.
NEAR = NearDedup(numerator=80, bands=31, rows=4)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without ``ids``, which are written first: the planner then knows their size and shuffles texts only if they are many."""
    ids = Scratch(docs.sparkSession).keep(ids.distinct(), "dropped")
    return docs.join(ids.select(F.col("doc_id").alias("_gone")), F.col("doc_id") == F.col("_gone"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    scores = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scores.where("predicted = 1").select("doc_id"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    found = near_duplicates(docs, NEAR).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    return _without(docs, found.where("not kept").select("doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth occurs in the benchmark go."""
    judged = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, judged.where("contaminated").select("doc_id"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in angle brackets; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048: one row for each piece of a document, with its place."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]

#: The toxicity stage is a trained model and the last one a search, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
