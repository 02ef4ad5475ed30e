"""Queries of the signal layers over a 25 Hz signal made of the ``events`` values, with their DuckDB equivalents.

A device has 5,000 consecutive events, 40 ms apart from its start; every fifth stretch of
15 s is damped, and in ``holed`` every seventh one of 10 s is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breathline.operators import breaths, events, grid, signal
from breathline.operators.frames import islands
from breathline.plans import pipeline

START_US = 1_789_684_200_000_000
KEYS = ["device"]


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    i = F.col("event_id")
    ts = grid.from_micros(F.lit(START_US) + i * 40_000)
    v = F.col("value") * F.when(F.floor(i / 375) % 5 == 3, 0.1).otherwise(1.0)
    return e.select(F.floor(i / 5000).cast("long").alias("device"), i.alias("seq"), ts.alias("ts"), v.alias("v"))


def _holed(spark, sf_dir):
    return _signal(spark, sf_dir).filter(F.floor(F.col("seq") / 250) % 7 != 3)


def _checked(spark, sf_dir):
    return _signal(spark, sf_dir).withColumn("valid", F.col("v").isNotNull()).withColumn("in_qc", F.col("v") > 400.0)


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _grid(spark, sf_dir):
    return grid.resample(_holed(spark, sf_dir), KEYS, "v", 5.0)


def _envelope(spark, sf_dir):
    return events.envelope(_signal(spark, sf_dir), KEYS, "v")


def _removals(spark, sf_dir):
    return events.mask_removals(_envelope(spark, sf_dir), KEYS, min_minutes=0.05, threshold=12.0)


def _events(spark, sf_dir):
    return events.flow_limitations(_envelope(spark, sf_dir), _checked(spark, sf_dir), KEYS)


def _usage(spark, sf_dir):
    return _checked(spark, sf_dir).groupBy(*KEYS).agg((F.count_if("valid") * 0.04 / 3600).alias("usage_hours"))


def _valid(spark, sf_dir):
    df = _signal(spark, sf_dir)
    runs = islands(df.withColumn("hot", F.coalesce(F.col("v") > 100.0, F.lit(False))), KEYS, ["ts", "seq"], "hot")
    return grid.valid_samples(df, runs, KEYS, "v").select("seq", "valid")


def _drift(spark, sf_dir):
    return signal.flag_drift(_signal(spark, sf_dir), KEYS, "v", window_s=20).groupBy(*KEYS).agg(F.count_if("drift").alias("n_drift"))


def _volumes(spark, sf_dir):
    return breaths.volumes(_checked(spark, sf_dir), KEYS, "v", 0.04, seconds=1.0, floor=10.0)


def _rates(spark, sf_dir):
    return breaths.respiratory_rate(_checked(spark, sf_dir), KEYS, "v", 0.04, block_minutes=1)


_S = f"""WITH s AS (SELECT event_id // 5000 AS device, event_id AS seq, make_timestamp({START_US} + event_id * 40000) AS ts,
    value * CASE WHEN (event_id // 375) % 5 = 3 THEN 0.1 ELSE 1.0 END AS v FROM events)"""
_G = _S + """, h AS (SELECT * FROM s WHERE (seq // 250) % 7 <> 3),
m AS (SELECT device, min(epoch_us(ts)) AS t0, CAST(greatest(1, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 2e5) + 1) AS BIGINT) AS n FROM h GROUP BY device),
b AS (SELECT h.device, least((epoch_us(ts) - t0) // 200000, n - 1) AS bin, quantile_cont(v, 0.5) AS value, arg_min(ts, seq) AS orig_ts, false AS missing FROM h JOIN m USING (device) GROUP BY ALL),
p AS (SELECT device, t0, unnest(range(n)) AS bin FROM m),
g AS (SELECT p.device, p.bin, make_timestamp(t0 + p.bin * 200000) AS ts, orig_ts, round(value, 5) AS value, coalesce(missing, true) AS missing FROM p LEFT JOIN b USING (device, bin))"""
_E = _S + """, env AS (SELECT device, epoch_us(ts) // 1000000 AS sec, CASE WHEN count(*) >= 10 THEN stddev_pop(v) END AS activity FROM s GROUP BY ALL)"""
_F = _E + """, f AS (SELECT *, CASE WHEN count(activity) OVER a >= 2 THEN quantile_cont(activity, 0.5) OVER a END AS sm,
    CASE WHEN count(activity) OVER b >= 90 THEN quantile_cont(activity, 0.5) OVER b END AS ba FROM env
    WINDOW a AS (PARTITION BY device ORDER BY sec ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), b AS (PARTITION BY device ORDER BY sec ROWS BETWEEN 150 PRECEDING AND 149 FOLLOWING)),
l AS (SELECT *, coalesce(sm < ba * 0.7, false) AS low FROM f),
r AS (SELECT *, row_number() OVER w - sum(low::INT) OVER w AS run FROM l WINDOW w AS (PARTITION BY device ORDER BY sec)),
e AS (SELECT device, min(sec) AS a, max(sec) + 1 AS z, 1 - quantile_cont(sm, 0.5) / quantile_cont(ba, 0.5) AS reduction FROM r WHERE low GROUP BY device, run HAVING count(*) >= 10 AND quantile_cont(ba, 0.5) > 0),
j AS (SELECT e.device, a, z, reduction, count(*) AS n, count(v) AS ok, count(*) FILTER (v > 400) AS bad FROM e JOIN s ON s.device = e.device AND epoch_us(ts) BETWEEN a * 1000000 AND z * 1000000 WHERE reduction >= 0.3 GROUP BY ALL),
q AS (SELECT *, bad > 0 OR ok / n < 0.9 AS suspect FROM j),
t AS (SELECT device, make_timestamp(a * 1000000) AS start, make_timestamp(z * 1000000) AS "end", CAST(z - a AS DOUBLE) AS duration_s, round(reduction, 4) AS reduction,
    CASE WHEN reduction >= 0.8 THEN 'apnea' ELSE 'hypopnea' END AS event_type, CASE WHEN suspect THEN 'suspect' ELSE 'ok' END AS quality_flag,
    CASE WHEN NOT suspect AND ok = n THEN 'high' ELSE 'low' END AS confidence, CAST(hour(make_timestamp(a * 1000000)) AS INT) AS hour_of_night FROM q)"""

_PLANS = {
    "resample_grid": (lambda s, d: _round(_grid(s, d)), _G + " SELECT * FROM g"),
    "grid_gaps": (
        lambda s, d: grid.gaps(_grid(s, d), KEYS, 0.2),
        _G + """, r AS (SELECT *, row_number() OVER w - sum(missing::INT) OVER w AS run FROM g WINDOW w AS (PARTITION BY device ORDER BY ts))
        SELECT device, min(ts) AS start, make_timestamp(epoch_us(max(ts)) + 200000) AS "end", count(*) AS n FROM r WHERE missing GROUP BY device, run HAVING count(*) * 0.2 > 5""",
    ),
    "activity_envelope": (lambda s, d: _round(_envelope(s, d)), _E + " SELECT device, sec, round(activity, 5) AS activity FROM env"),
    "mask_removals": (
        _removals,
        _E + """, r AS (SELECT *, row_number() OVER w - sum(coalesce(activity < 12.0, false)::INT) OVER w AS run FROM env WINDOW w AS (PARTITION BY device ORDER BY sec))
        SELECT device, min(sec) AS start_sec, max(sec) + 1 AS end_sec, CAST(12.0 AS DOUBLE) AS threshold FROM r WHERE activity < 12.0 GROUP BY device, run HAVING count(*) >= 3""",
    ),
    "event_timeline": (lambda s, d: events.timeline(_events(s, d), KEYS), _F + " SELECT * FROM t"),
    "ahi_estimate": (
        lambda s, d: _round(events.ahi(_events(s, d), _usage(s, d), KEYS)),
        _F + """, u AS (SELECT device, count(v) * 0.04 / 3600 AS h FROM s GROUP BY device),
        c AS (SELECT device, count(*) AS n, count(*) FILTER (NOT suspect) AS k FROM q GROUP BY device)
        SELECT device, round(CAST(h AS DOUBLE), 5) AS usage_hours, coalesce(n, 0) AS n_events, coalesce(k, 0) AS n_confident,
            round(coalesce(n, 0) / CAST(h AS DOUBLE), 5) AS estimated_ahi, round(coalesce(k, 0) / CAST(h AS DOUBLE), 5) AS estimated_ahi_confident FROM u LEFT JOIN c USING (device)""",
    ),
    "valid_mask": (
        _valid,
        _S + " SELECT seq, v IS NOT NULL AND NOT coalesce(v > 100, false) AS valid FROM s",
    ),
    "drift_counts": (
        _drift,
        _S + """, e AS (SELECT device, epoch_us(ts) // 1000000 AS sec, quantile_cont(v, 0.5) AS m FROM s GROUP BY ALL),
        w AS (SELECT *, avg(m) OVER (PARTITION BY device ORDER BY sec ROWS 19 PRECEDING) AS tr, quantile_cont(m, 0.5) OVER (PARTITION BY device) AS med,
            coalesce(nullif(stddev_pop(m) OVER (PARTITION BY device), 0), 1e-9) AS sd, count(*) OVER (PARTITION BY device) AS n FROM e)
        SELECT s.device, count(*) FILTER (n >= 20 AND abs(tr - med) > 0.5 * sd) AS n_drift FROM s JOIN w ON s.device = w.device AND epoch_us(s.ts) // 1000000 = w.sec GROUP BY s.device""",
    ),
    "night_blocks": (
        lambda s, d: _round(signal.night_blocks(_signal(s, d), KEYS, "v")),
        _S + """, a AS (SELECT *, CASE WHEN count(v) OVER f >= 20 THEN max(v) OVER f - min(v) OVER f END AS amp, max(ts) OVER (PARTITION BY device) AS last FROM s
            WINDOW f AS (PARTITION BY device ORDER BY ts, seq ROWS BETWEEN 62 PRECEDING AND 62 FOLLOWING)),
        l AS (SELECT device, coalesce(quantile_cont(amp, 0.1) FILTER (amp > 0), 1e-12) AS least FROM a GROUP BY device)
        SELECT a.device, date_trunc('hour', ts) AS start, round(avg(amp), 5) AS activity_mean, round(stddev_samp(amp), 5) AS activity_std, coalesce(avg(amp) >= any_value(least), false) AS active
        FROM a JOIN l USING (device) WHERE (hour(ts) >= 22 OR hour(ts) < 7) AND NOT (ts = last AND ts = date_trunc('hour', ts)) GROUP BY a.device, date_trunc('hour', ts)""",
    ),
    "breath_volumes": (
        lambda s, d: _round(_volumes(s, d)),
        _S + """, b AS (SELECT *, v - coalesce(CASE WHEN count(v) OVER w >= 8 THEN quantile_cont(v, 0.5) OVER w END, v) AS f FROM s
            WINDOW w AS (PARTITION BY device ORDER BY ts, seq ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
        r AS (SELECT *, row_number() OVER w - sum(coalesce(f > 0, false)::INT) OVER w AS run FROM b WINDOW w AS (PARTITION BY device ORDER BY ts, seq))
        SELECT device, min(ts) AS start, round(count(*) * CAST(0.04 AS DOUBLE), 5) AS duration_s, round(sum(f) * CAST(0.04 AS DOUBLE), 5) AS volume FROM r WHERE f > 0 GROUP BY device, run
        HAVING count(*) * CAST(0.04 AS DOUBLE) BETWEEN 0.25 AND 8 AND max(f) > 10""",
    ),
    "respiratory_rate": (lambda s, d: _round(_rates(s, d)), None),
    "volume_histogram": (lambda s, d: breaths.volume_histogram(_volumes(s, d), KEYS), None),
    "night_report": (lambda s, d: _round(pipeline.run(_signal(s, d), KEYS, "v").report), None),
    "nightly_trend": (lambda s, d: _round(pipeline.trend(pipeline.run(_signal(s, d), KEYS, "v", steps=("quality", "stats")).stats, KEYS)), None),
}


def queries() -> dict:
    return {name: plan for name, (plan, _) in _PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _PLANS.items() if sql}
