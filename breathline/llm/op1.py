"""op1_warc: write the pages to WARC archives and read every record back through the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from breathline.llm.storage import new_path
from breathline.llm.warc import read_records, write_archives

SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT body, max(page_id) AS keeper FROM p GROUP BY body),
d AS (SELECT body, list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', substr(sha1(body), i::BIGINT, 1)) - 1) AS nib,
             keeper FROM g),
b AS (SELECT body, keeper, array_to_string(list_transform(nib, lambda n: ((n // 8) % 2)::VARCHAR || ((n // 4) % 2)::VARCHAR || ((n // 2) % 2)::VARCHAR || (n % 2)::VARCHAR), '') AS bits FROM d),
e AS (SELECT body, keeper, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + 16 * substr(bits, 5 * k + 1, 1)::INT + 8 * substr(bits, 5 * k + 2, 1)::INT + 4 * substr(bits, 5 * k + 3, 1)::INT
          + 2 * substr(bits, 5 * k + 4, 1)::INT + substr(bits, 5 * k + 5, 1)::INT, 1)), '') AS payload_digest FROM b)
SELECT p.page_id, CAST(strlen(p.body) AS BIGINT) AS payload_bytes, e.payload_digest,
       CASE WHEN p.page_id = e.keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = e.keeper THEN NULL ELSE e.keeper END AS refers_to
FROM p JOIN e ON p.body = e.body
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write_archives(pages, new_path(spark, "warc"))
    return read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
