"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.llm.common import table
from ontoweave.llm.decontaminate import drop_leaking
from ontoweave.llm.packing import pack
from ontoweave.llm.quality import resample
from ontoweave.llm.secrets import redact_documents
from ontoweave.llm.shingles import similar_documents
from ontoweave.plans.storage import discard, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling towards the labelled good ones; the others go."""
    return resample(docs, table(spark, sf_dir, "labels"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that 5-word similarities of 0.8 or more connect the one with the smallest doc_id stays.

    Repeated rows of one doc_id count as one document; rows without doc_id are told apart by text and
    yield to any document with one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    surrogate = F.lit(1 << 62) + F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1))
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), surrogate))
    kept = similar_documents(keyed, id_col="_key").where("doc_id = component_id").select(F.col("doc_id").alias("_key"))
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; all documents stay."""
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces with their places in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicate", near_duplicate), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]

#: The stages hold a trained field, hashed models and a tokenizer, which SQL can't express; tests compare each stage's operator with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
