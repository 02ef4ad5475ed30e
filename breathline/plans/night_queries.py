"""Queries of the session, export and figure operators over the ``events`` values, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breathline.operators import signal
from breathline.operators.sessions import sessionize
from breathline.plans import figures
from breathline.sources import exports, tables
from breathline.sources.nights import hours_since_start, last_sessions, pressure


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")


def _sessions(spark, sf_dir):
    return sessionize(_events(spark, sf_dir), ["user_id"], tie="event_id")


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _recording(spark, sf_dir):
    """The events as a cleaned recording in which values from 50 on are the missing mark."""
    df = _events(spark, sf_dir).withColumn("value", F.when(F.col("value") >= 50, tables.MISSING).otherwise(F.col("value")))
    return tables.clean(df.withColumnRenamed("event_id", "seq"))


def _quality(spark, sf_dir):
    df = signal.flag_clipping(_events(spark, sf_dir).withColumnRenamed("event_id", "seq"), "value", hi=50.0)
    none = F.lit(False)
    flagged = df.withColumns({"spike": F.col("value") < 0.5, "flatline": none, "drift": none}).withColumn("in_qc", F.col("spike") | F.col("clipping"))
    return signal.quality_report(flagged, signal.artifact_intervals(flagged, ["user_id"]), ["user_id"])


def _bimodal(spark, sf_dir):
    got = signal.distribution(_events(spark, sf_dir), ["user_id"], "value")
    return got.select("user_id", F.coalesce(F.col("bimodality") > 5 / 9, F.lit(False)).alias("above"))


def _overlay(spark, sf_dir):
    df = _sessions(spark, sf_dir).filter("user_id = 7")
    return _round(last_sessions(df, 5).select("event_id", "session_id", hours_since_start("ts").alias("hours"), pressure("value").alias("half")))


def _times(spark, sf_dir):
    at = F.date_trunc("second", "ts").cast("timestamp_ntz")
    return _events(spark, sf_dir).select("event_id", exports.time_seconds("ts").alias("time_seconds"), exports.iso_text("ts").alias("iso"), exports.hours_minutes(exports.time_seconds(at) % 86_400).alias("hm"))


def _decimated(spark, sf_dir):
    return figures.decimate(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], 20).select("event_id", "user_id", "value")


def _density(spark, sf_dir):
    return _round(figures.density(_events(spark, sf_dir), [], "value", bins=10, points=20).select("x", "density"))


_S = """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 14400000000 THEN 1 ELSE 0 END AS o
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS session_id FROM g) """

_PLANS = {
    "clean_recording": (
        lambda s, d: _recording(s, d).select("seq", "value"),
        "SELECT event_id AS seq, CASE WHEN value < 50 THEN value END AS value FROM events",
    ),
    "quality_counts": (
        lambda s, d: _round(_quality(s, d)),
        """WITH f AS (SELECT *, coalesce(value >= 50.0 - 5e-5, false) AS c, coalesce(value < 0.5, false) AS p FROM events),
        r AS (SELECT *, row_number() OVER w - sum(c::INT) OVER w AS rc, row_number() OVER w - sum(p::INT) OVER w AS rp FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, count(*) AS total_samples, count(*) FILTER (NOT c AND NOT p) AS valid_samples, count(*) FILTER (p) AS n_spike, CAST(0 AS BIGINT) AS n_flatline, count(*) FILTER (c) AS n_clipping, CAST(0 AS BIGINT) AS n_drift,
            round(100.0 * count(*) FILTER (NOT c AND NOT p) / count(*), 5) AS valid_pct, count(DISTINCT rp) FILTER (p) AS runs_spike, CAST(0 AS BIGINT) AS runs_flatline, count(DISTINCT rc) FILTER (c) AS runs_clipping, CAST(0 AS BIGINT) AS runs_drift
        FROM r GROUP BY user_id""",
    ),
    "iqr_spread": (
        lambda s, d: _round(signal.spread(_events(s, d), ["user_id"], "value")),
        "SELECT user_id, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 5) AS iqr FROM events GROUP BY user_id",
    ),
    "bimodality_test": (
        _bimodal,
        """WITH a AS (SELECT user_id, count(value) AS n, skewness(value) AS g, kurtosis(value) AS k FROM events GROUP BY user_id)
        SELECT user_id, coalesce(n > 3 AND least((g * g + 1) / (k + 3.0 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))), 1.0) > 5.0 / 9, false) AS above FROM a""",
    ),
    "overlapped_sessions": (
        _overlay,
        _S + """, t AS (SELECT *, dense_rank() OVER (ORDER BY session_id DESC) AS k FROM s WHERE user_id = 7)
        SELECT event_id, session_id, round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY session_id))) / 3.6e9, 5) AS hours, round(value / 2, 5) AS half FROM t WHERE k <= 5""",
    ),
    "export_times": (
        _times,
        """SELECT event_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) + 719163 AS BIGINT) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS time_seconds,
            strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%H:%M') AS hm FROM events""",
    ),
    "decimated": (
        _decimated,
        """WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, greatest(1, CAST(round_even(count(*) OVER (PARTITION BY user_id) / 20.0, 0) AS BIGINT)) AS k FROM events)
        SELECT event_id, user_id, value FROM k WHERE i % k = 0""",
    ),
    "value_density": (
        _density,
        """WITH a AS (SELECT min(value) AS lo, max(value) - min(value) AS sp, count(value) AS n FROM events),
        f AS (SELECT CAST(floor(least(floor((value - lo) / sp * 200), 199) / 20) AS BIGINT) AS b, count(*) AS c FROM events, a WHERE value IS NOT NULL GROUP BY ALL),
        e AS (SELECT unnest(range(10)) AS b)
        SELECT round(lo + (e.b + 0.5) * sp / 10, 5) AS x, round(coalesce(c, 0) / n * 10 / sp, 5) AS density FROM e LEFT JOIN f USING (b), a""",
    ),
}


def queries() -> dict:
    return {name: plan for name, (plan, _) in _PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _PLANS.items()}
