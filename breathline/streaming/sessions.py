"""Streaming forms: gap sessions and the per-second envelope, under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_stream(stream: DataFrame, keys: list[str], ts: str = "ts", limit: str = "4 hours", late: str = "4 hours") -> DataFrame:
    """Rows and bounds of each session once the watermark has passed it; keyed by its start, as numbers need a global order."""
    at = F.col(ts).cast("timestamp")
    rows = stream.withColumn("__at", at).withWatermark("__at", late)
    got = rows.groupBy(*keys, F.session_window("__at", limit).alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("__at").alias("start"), F.max("__at").alias("end"))
    return got.drop("w")


def envelope_stream(stream: DataFrame, keys: list[str], value: str, ts: str = "ts", late: str = "1 minute", least: int = 10) -> DataFrame:
    """Population deviation per second; null below ``least`` rows."""
    rows = stream.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", late)
    got = rows.groupBy(*keys, F.window("__at", "1 second").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(value).alias("sd"))
    return got.select(*keys, F.col("w.start").alias("second"), F.when(F.col("n") >= least, F.col("sd")).alias("activity"))
