"""Gap-based sessions and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessionize(df: DataFrame, keys: list[str], ts: str = "ts", tie: str = "seq", limit_hours: float = 4) -> DataFrame:
    """Add ``session_id``, from 1 per key: a gap strictly above the limit starts a new session."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    opens = F.coalesce(gap > int(limit_hours * 3_600_000_000), F.lit(False)).cast("long")
    return df.withColumn("__opens", opens).withColumn("session_id", F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("__opens")


def session_summary(sessions: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Rows, first and last time and duration in seconds of each session."""
    out = sessions.groupBy(*keys, "session_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.withColumn("duration_s", (micros("end") - micros("start")) / 1e6)


def sampling_period(df: DataFrame, keys: list[str], ts: str = "ts", tie: str = "seq") -> DataFrame:
    """The exact median of the positive steps in seconds; null without any."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    step = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1e6
    return df.withColumn("__step", step).groupBy(*keys).agg(F.percentile(F.when(F.col("__step") > 0, F.col("__step")), F.lit(0.5)).alias("period_s"))
