"""op6_jaccard_join: groups of documents linked by shingle similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from breathline.llm.jaccard_join import jaccard_groups


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
