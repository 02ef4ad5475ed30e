"""The corpus pipeline: five filtering or encoding stages over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breathline.llm import decontaminate, exact_dedup, jaccard_join, pieces, toxicity
from breathline.llm.storage import materialise


def _reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score one half or more go; the labels of the held-out fifth are not used."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    model = toxicity.fit(docs.select(F.col("doc_id").alias("id"), "text"), labels.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0))
    return toxicity.keep_clean(docs, model)


def _drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.keep_first(docs, keep="max")


def _drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    return jaccard_join.keep_one(docs)


def _drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of what is left."""
    return pieces.encode(docs).select(F.col("id").alias("doc_id"), "ids", "lossless")


STAGES = [
    ("toxicity", _reject_toxic),
    ("exact_dedup", _drop_copies),
    ("jaccard_join", _drop_near_copies),
    ("decontamination", _drop_contaminated),
    ("pieces", _encode),
]

#: The kernel machine and the sampled pieces cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
