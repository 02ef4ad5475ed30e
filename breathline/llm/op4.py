"""op4_url_filter: a verdict on every page's url."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from breathline.llm.url_filter import judge

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES).select("page_id", "host", "path", "rule", "verdict")
