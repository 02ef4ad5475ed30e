"""Artifact detectors and statistics over an ordered signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breathline.operators.frames import centred, islands, median, null_safe_join, rolling
from breathline.operators.grid import second

FLAT_TOLERANCE = 1e-3
SPIKE_FLOOR = 1e-9
KINDS = ("spike", "flatline", "clipping", "drift")


def scale(df: DataFrame, keys: list[str], value: str) -> Column:
    """Population standard deviation per key; 1.0 where it is zero or missing."""
    return F.coalesce(F.nullif(F.stddev_pop(value).over(Window.partitionBy(*keys)), F.lit(0.0)), F.lit(1.0))


def flag_flatline(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``flatline``: the rolling deviation over 25 rows is below a thousandth of the scale."""
    spread = rolling(F.col(value), F.stddev_samp, centred(keys, order, 25), 5)
    return df.withColumn("flatline", F.coalesce(spread < FLAT_TOLERANCE * scale(df, keys, value), F.lit(False)))


def flag_clipping(df: DataFrame, value: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """``clipping``: at or beyond a given bound, up to a tolerance; false without bounds.

    With one bound only, the tolerance comes from that side.
    """
    known = [b for b in (lo, hi) if b is not None]
    eps = 1e-6 * max(1.0, abs(hi - lo) if len(known) == 2 else abs(known[0])) if known else 0.0
    beyond = F.lit(False)
    if lo is not None:
        beyond = beyond | (F.col(value) <= lo + eps)
    if hi is not None:
        beyond = beyond | (F.col(value) >= hi - eps)
    return df.withColumn("clipping", F.coalesce(beyond, F.lit(False)))


def flag_spikes(df: DataFrame, keys: list[str], order: list[str], value: str, factor: float = 25.0) -> DataFrame:
    """``spike``: steps in and out of opposite sign, both large against the local positive steps."""
    w = Window.partitionBy(*keys).orderBy(*order)
    v = F.col(value)
    stepped = df.withColumn("__in", v - F.lag(v).over(w)).withColumn("__out", F.lead(v).over(w) - v)
    size = F.abs("__in")
    positive = F.when(size > 0, size)
    overall = F.coalesce(F.percentile(positive, F.lit(0.5)).over(Window.partitionBy(*keys)), F.lit(0.0))
    local = F.coalesce(rolling(positive, median, centred(keys, order, 25), 1), overall)
    limit = factor * F.greatest(local, SPIKE_FLOOR * scale(df, keys, value))
    spike = (size > limit) & (F.abs("__out") > limit) & (F.signum("__in") != F.signum("__out"))
    return stepped.withColumn("spike", F.coalesce(spike, F.lit(False))).drop("__in", "__out")


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Percentiles, mean and bias-corrected skewness and excess kurtosis with Sarle's coefficient."""
    q = F.percentile(value, F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    got = df.groupBy(*keys).agg(F.count(value).alias("n"), q.alias("q"), F.avg(value).alias("mean"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"))
    n = F.col("n").cast("double")
    skew = F.when(n >= 3, F.coalesce(F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0)))
    kurt = F.when(n >= 4, F.coalesce((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6), F.lit(0.0)))
    cols = [F.col("q")[i].alias(name) for i, name in enumerate(("p05", "p25", "median", "p75", "p95"))]
    out = got.select(*keys, "n", *cols, "mean", skew.alias("skew"), kurt.alias("kurtosis"))
    denom = F.col("kurtosis") + 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))
    return out.withColumn("bimodality", F.when((n > 3) & (denom > 0), F.least((F.col("skew") ** 2 + 1) / denom, F.lit(1.0))))

def flag_drift(df: DataFrame, keys: list[str], value: str, ts: str = "ts", window_s: float = 300.0, tolerance: float = 0.5) -> DataFrame:
    """``drift``: the trailing mean of the per-second medians is far from their median.

    Far is more than ``tolerance`` of their deviation. Keys with fewer seconds than the
    window have no drift.
    """
    width = max(2, round(window_s))
    env = df.groupBy(*keys, second(ts).alias("__sec")).agg(median(F.col(value)).alias("__m"))
    whole = Window.partitionBy(*keys)
    trailing = F.avg("__m").over(whole.orderBy("__sec").rowsBetween(-(width - 1), 0))
    spread = F.coalesce(F.nullif(F.stddev_pop("__m").over(whole), F.lit(0.0)), F.lit(1e-9))
    off = F.abs(trailing - median(F.col("__m")).over(whole)) > tolerance * spread
    env = env.select(*keys, "__sec", (F.coalesce(off, F.lit(False)) & (F.count(F.lit(1)).over(whole) >= width)).alias("drift"))
    return null_safe_join(df.withColumn("__sec", second(ts)), env, [*keys, "__sec"]).drop("__sec")


def artifacts(df: DataFrame, keys: list[str], value: str, ts: str = "ts", tie: str = "seq", lo: float | None = None, hi: float | None = None, factor: float = 25.0, window_s: float = 300.0, tolerance: float = 0.5) -> DataFrame:
    """``df`` with the flags spike, flatline, clipping and drift, and ``in_qc`` where any is set."""
    order = [ts, tie]
    out = flag_spikes(df, keys, order, value, factor)
    out = flag_drift(flag_clipping(flag_flatline(out, keys, order, value), value, lo, hi), keys, value, ts, window_s, tolerance)
    return out.withColumn("in_qc", F.col("spike") | F.col("flatline") | F.col("clipping") | F.col("drift"))


def artifact_intervals(flagged: DataFrame, keys: list[str], ts: str = "ts", tie: str = "seq") -> DataFrame:
    """(keys, start, end, n, kind): runs of flagged samples; the end is the last one."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    # One sort for all kinds: a flagged sample's run number is its place less the flagged ones so far.
    numbered = flagged.select(*keys, F.col(ts).alias("__at"), *KINDS, *[(F.row_number().over(w) - F.sum(F.col(k).cast("int")).over(so_far)).alias(f"__{k}") for k in KINDS])
    each = F.array(*[F.when(F.col(k), F.struct(F.lit(k).alias("kind"), F.col(f"__{k}").alias("run"))) for k in KINDS])
    runs = numbered.select(*keys, "__at", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("k"))
    found = runs.groupBy(*keys, "k.kind", "k.run").agg(F.min("__at").alias("start"), F.max("__at").alias("end"), F.count(F.lit(1)).alias("n"))
    return found.select(*keys, "start", "end", "n", "kind")


def quality_report(flagged: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: samples, samples without any flag, their share, and by kind the flagged samples (``n_``) and intervals (``runs_``)."""
    flags = [F.count_if(F.col(k)).alias(f"n_{k}") for k in KINDS]
    total = flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_samples"), F.count_if(~F.col("in_qc")).alias("valid_samples"), *flags)
    runs = intervals.groupBy(*keys).agg(*[F.count_if(F.col("kind") == k).alias(f"runs_{k}") for k in KINDS])
    return null_safe_join(total.withColumn("valid_pct", 100 * F.col("valid_samples") / F.col("total_samples")), runs, keys, "left").fillna(0, [f"runs_{k}" for k in KINDS])


def require_signal(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with a check that fails the query where a key has no value at all: such a signal cannot be judged."""
    n = F.count(value).over(Window.partitionBy(*keys))
    return df.withColumn(value, F.when(n > 0, F.col(value)).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no value in the signal of"), *[F.col(k).cast("string") for k in keys])).cast("double")))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, iqr): the distance of the quartiles by linear interpolation; null without values."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    return df.groupBy(*keys).agg(q.alias("q")).select(*keys, (F.col("q")[1] - F.col("q")[0]).alias("iqr"))


def drift_findings(df: DataFrame, keys: list[str], ts: str = "ts", window_s: float = 300.0) -> DataFrame:
    """(keys, finding) of the keys with fewer seconds than the drift window, where drift is not looked for."""
    secs = df.groupBy(*keys).agg(F.countDistinct(second(ts)).alias("n")).filter(F.col("n") < max(2, round(window_s)))
    return secs.select(*keys, F.format_string("drift detection skipped: %d s of signal, window %d s", F.col("n"), F.lit(max(2, round(window_s)))).alias("finding"))


def night_blocks(df: DataFrame, keys: list[str], value: str, ts: str = "ts", tie: str = "seq", bed_start: str = "22:00:00", bed_end: str = "07:00:00", min_activity: float | None = None) -> DataFrame:
    """(keys, start, activity_mean, activity_std, active) of the hours of the night that have samples.

    Activity is the range over 125 rows; a block is active from the tenth percentile of
    the positive ranges of the whole key on. A last sample on the full hour is left out.
    """
    frame = centred(keys, [ts, tie], 125)
    amp = rolling(F.col(value), F.max, frame, 20) - rolling(F.col(value), F.min, frame, 20)
    rows = df.withColumn("__amp", amp)
    whole = Window.partitionBy(*keys)
    least = F.lit(min_activity) if min_activity is not None else F.coalesce(F.percentile(F.when(F.col("__amp") > 0, F.col("__amp")), F.lit(0.1)).over(whole), F.lit(1e-12))
    clock = F.date_format(ts, "HH:mm:ss")
    rows = rows.withColumn("__least", least).filter((clock >= bed_start) | (clock < bed_end))
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz")
    rows = rows.withColumn("start", hour).withColumn("__last", F.max(ts).over(whole)).filter((F.col(ts) != F.col("__last")) | (F.col(ts) != F.col("start")))
    got = rows.groupBy(*keys, "start").agg(F.avg("__amp").alias("activity_mean"), F.stddev_samp("__amp").alias("activity_std"), F.first("__least").alias("__least"))
    return got.withColumn("active", F.coalesce(F.col("activity_mean") >= F.col("__least"), F.lit(False))).drop("__least")
