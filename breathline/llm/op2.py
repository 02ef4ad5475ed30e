"""op2_exact_dedup: exact copies among the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from breathline.llm.exact_dedup import exact_groups

SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS txt FROM documents),
g AS (SELECT txt, max(doc_id) AS keep_id, count(*) AS group_size, sha256(txt) AS text_sha256 FROM t GROUP BY txt)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       t.doc_id = g.keep_id AS kept, g.text_sha256
FROM t JOIN g ON t.txt = g.txt
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")
