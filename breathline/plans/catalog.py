"""The named queries of the core engine over the ``events`` stream, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breathline.operators.frames import centred, islands, median, rolling
from breathline.operators.sessions import sampling_period, session_summary, sessionize
from breathline.operators.signal import distribution, flag_clipping, flag_flatline, flag_spikes
from breathline.plans import night_queries, signal_queries

KEYS, ORDER = ["user_id"], ["ts", "event_id"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(session_summary(sessionize(_events(spark, sf_dir), KEYS, tie="event_id"), KEYS))


def _sessionize(spark, sf_dir):
    return sessionize(_events(spark, sf_dir), KEYS, tie="event_id").select("event_id", "user_id", "session_id")


def _period(spark, sf_dir):
    found = sampling_period(_events(spark, sf_dir), KEYS, tie="event_id")
    return found.select("user_id", F.round(F.col("period_s") * 1e6, 1).alias("period_us"))  # in seconds, half a microsecond would be a rounding tie


def _median(spark, sf_dir):
    value = rolling(F.col("value"), median, centred(KEYS, ORDER, 4), 2)
    return _rounded(_events(spark, sf_dir).select("event_id", value.alias("rolling_median")))


def _clean(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.nullif(F.col("value"), F.lit(65535.0)).alias("value")).filter(F.col("ts").isNotNull())


def _clipping(spark, sf_dir):
    runs = flag_clipping(_events(spark, sf_dir), "value", hi=50.0)
    return islands(runs, KEYS, ORDER, "clipping")


def _flags(spark, sf_dir):
    df = flag_spikes(flag_flatline(_events(spark, sf_dir), KEYS, ORDER, "value"), KEYS, ORDER, "value", factor=3.0)
    return df.groupBy("user_id").agg(F.count_if("flatline").alias("n_flatline"), F.count_if("spike").alias("n_spike"))


def _distribution(spark, sf_dir):
    return _rounded(distribution(_events(spark, sf_dir), KEYS, "value"))


_SESSIONS = """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 14400000000 THEN 1 ELSE 0 END AS o
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS session_id FROM g) """

_PLANS = {
    "sessionize_4h": (_sessionize, _SESSIONS + "SELECT event_id, user_id, session_id FROM s"),
    "session_summary": (flagship, _SESSIONS + """SELECT user_id, session_id, count(*) AS n_rows, min(ts) AS start, max(ts) AS "end",
        round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration_s FROM s GROUP BY user_id, session_id"""),
    "sampling_period": (_period, """WITH d AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS step FROM events)
        SELECT user_id, round(quantile_cont(step, 0.5) FILTER (step > 0), 1) AS period_us FROM d GROUP BY user_id"""),
    "rolling_median": (_median, """SELECT event_id, round(CASE WHEN count(value) OVER w >= 2 THEN quantile_cont(value, 0.5) OVER w END, 6) AS rolling_median
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)"""),
    "clean_sentinel": (_clean, "SELECT event_id, nullif(value, 65535.0) AS value FROM events WHERE ts IS NOT NULL"),
    "clipping_intervals": (_clipping, """WITH f AS (SELECT *, value >= 50.0 - 5e-5 AS c FROM events),
        r AS (SELECT *, row_number() OVER w - sum(c::INT) OVER w AS run FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM r WHERE c GROUP BY user_id, run"""),
    "artifact_counts": (_flags, """WITH d AS (SELECT *, value - lag(value) OVER w AS i, lead(value) OVER w - value AS o,
            coalesce(nullif(stddev_pop(value) OVER (PARTITION BY user_id), 0), 1) AS sc,
            CASE WHEN count(value) OVER f >= 5 THEN stddev_samp(value) OVER f END AS sd FROM events
            WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
        p AS (SELECT *, CASE WHEN abs(i) > 0 THEN abs(i) END AS pos FROM d),
        l AS (SELECT *, 3.0 * greatest(coalesce(quantile_cont(pos, 0.5) OVER f, quantile_cont(pos, 0.5) OVER (PARTITION BY user_id), 0), 1e-9 * sc) AS lim FROM p
            WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING))
        SELECT user_id, count(*) FILTER (sd < 1e-3 * sc) AS n_flatline, count(*) FILTER (abs(i) > lim AND abs(o) > lim AND sign(i) <> sign(o)) AS n_spike FROM l GROUP BY user_id"""),
    "flow_distribution": (_distribution, """WITH a AS (SELECT user_id, count(value) AS n, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS median,
            quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95, avg(value) AS mean, skewness(value) AS skew, kurtosis(value) AS kurtosis FROM events GROUP BY user_id)
        SELECT user_id, n, round(p05, 6) AS p05, round(p25, 6) AS p25, round(median, 6) AS median, round(p75, 6) AS p75, round(p95, 6) AS p95, round(mean, 6) AS mean,
            round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis,
            round(least((skew * skew + 1) / (kurtosis + 3.0 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))), 1.0), 6) AS bimodality FROM a"""),
}


def queries() -> dict:
    return {name: plan for name, (plan, _) in _PLANS.items()} | signal_queries.queries() | night_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _PLANS.items()} | signal_queries.oracle_sql() | night_queries.oracle_sql()
