"""Sessions of a recording's CSV, raw or segmented."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breathline.operators.sessions import sampling_period, sessionize
from breathline.sources.tables import read_recording

#: The rate that a session without a positive step is given.
DEFAULT_HZ = 25.0


@dataclass
class Night:
    """One session's channel: ``samples`` has session_id, ts, seq and value."""

    samples: DataFrame
    session_id: int
    channel: str
    measured_period_s: float
    sample_rate_hz: float


def has_sessions(spark: SparkSession, path: str) -> bool:
    """Whether the header names a session_id."""
    return "session_id" in [c.strip() for c in spark.read.csv(path, header=True).columns]


def check_sorted(df: DataFrame, ts: str = "timestamp", tie: str = "seq") -> DataFrame:
    """``df`` if its times never fall in file order, else ValueError. Compares neighbours within
    and between the partitions of a range by ``tie``, so no task sees more than its share."""
    parts = df.select(ts, tie).repartitionByRange(tie).sortWithinPartitions(tie).withColumn("__p", F.spark_partition_id())
    inside = parts.withColumn("__before", F.lag(ts).over(Window.partitionBy("__p").orderBy(tie)))
    by = inside.groupBy("__p").agg(F.count_if(F.col(ts) < F.col("__before")).alias("bad"), F.min_by(ts, tie).alias("first"), F.max_by(ts, tie).alias("last"), F.min(tie).alias("at"))
    between = by.withColumn("__before", F.lag("last").over(Window.orderBy("at")))  # one row per partition
    if between.filter((F.col("bad") > 0) | (F.col("first") < F.col("__before"))).limit(1).count():
        raise ValueError("timestamps are not in order: clean and segment the recording first")
    return df


def read_segmented_csv(spark: SparkSession, path: str) -> DataFrame:
    """A segmented recording; ValueError without session_id or with times out of order."""
    if not has_sessions(spark, path):
        raise ValueError(f"no column session_id in {path}: clean and segment the recording first")
    df = read_recording(spark, path).withColumn("session_id", F.col("session_id").cast("long"))
    return check_sorted(df)


def read_sessions(spark: SparkSession, path: str, limit_hours: float = 4.0) -> DataFrame:
    """All sessions of a CSV: as segmented there, else segmented here by gaps above ``limit_hours``."""
    if has_sessions(spark, path):
        return read_segmented_csv(spark, path)
    return sessionize(read_recording(spark, path), [], "timestamp", "seq", limit_hours)


def all_session_ids(spark: SparkSession, path: str, limit_hours: float = 4.0) -> list[int]:
    return [r.session_id for r in read_sessions(spark, path, limit_hours).select("session_id").distinct().orderBy("session_id").collect()]


def channel_of(df: DataFrame, channel: str) -> DataFrame:
    """(session_id, ts, seq, value) of one channel; ValueError if the recording lacks it."""
    if channel not in df.columns:
        raise ValueError(f"no column '{channel}': export the recording with -2 (resA, resB, resC) or -1 (pulse) and clean it")
    return df.select("session_id", F.col("timestamp").alias("ts"), "seq", F.col(f"`{channel}`").cast("double").alias("value"))


def load_session(spark: SparkSession, path: str, session_id: int, channel: str = "resA", limit_hours: float = 4.0) -> Night:
    """One session's channel with its rate from the median positive step (25 Hz without one).

    ValueError for an unknown session lists those there are.
    """
    frame = read_sessions(spark, path, limit_hours)
    ids = [r.session_id for r in frame.select("session_id").distinct().orderBy("session_id").collect()]
    if session_id not in ids:
        raise ValueError(f"session {session_id} not found; there are: {ids}")
    samples = channel_of(frame, channel).filter(F.col("session_id") == session_id)
    period = sampling_period(samples, ["session_id"]).first().period_s or 0.0
    return Night(samples, session_id, channel, period, 1.0 / period if period > 0 else DEFAULT_HZ)


def last_sessions(df: DataFrame, n: int) -> DataFrame:
    """The rows of the ``n`` sessions with the largest ids."""
    ids = df.select("session_id").distinct().orderBy(F.col("session_id").desc()).limit(n)
    return df.join(F.broadcast(ids), "session_id", "left_semi")  # at most n rows


def hours_since_start(ts: str = "ts") -> Column:
    """Hours since the session's first sample."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(F.col(ts)) - micros(F.min(ts).over(Window.partitionBy("session_id")))) / 3.6e9


def pressure(column: str) -> Column:
    """cmH2O of a raw half-unit."""
    return F.col(f"`{column}`") / 2.0
