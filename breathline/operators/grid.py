"""Regular grids: resampling, gaps, sample validity against intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breathline.operators.frames import islands, median, null_safe_join

DEFAULT_PERIOD_S = 0.040
GAP_S = 5.0


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value).cast("timestamp_ntz")


def second(ts: str) -> Column:
    """Whole epoch seconds, rounded down."""
    return F.floor(micros(ts) / 1_000_000).cast("long")


def _spans(df: DataFrame, keys: list[str], ts: str, tie: str, target_hz: float | None) -> DataFrame:
    """Per key: first time, measured period, grid step in microseconds and number of grid points."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    step = micros(ts) - F.lag(micros(ts)).over(w)
    got = df.withColumn("__d", step).groupBy(*keys).agg(
        F.min(micros(ts)).alias("t0"),
        F.max(micros(ts)).alias("t1"),
        F.coalesce(F.percentile(F.when(F.col("__d") > 0, F.col("__d")), F.lit(0.5)) / 1e6, F.lit(DEFAULT_PERIOD_S)).alias("measured"),
    )
    period = F.lit(1.0 / target_hz) if target_hz else F.col("measured")
    got = got.withColumn("period_s", period).withColumn("step", F.greatest(F.lit(1), F.round(F.col("period_s") * 1e6)).cast("long"))
    points = F.bround((F.col("t1") - F.col("t0")) / 1e6 / F.col("period_s")) + 1
    return got.withColumn("n", F.greatest(F.lit(1), points).cast("long"))


def resample(df: DataFrame, keys: list[str], value: str, target_hz: float | None = None, method: str = "median", ts: str = "ts", tie: str = "seq") -> DataFrame:
    """(keys, bin, ts, orig_ts, value, missing) on the regular grid that starts at each key's first sample.

    At or below the measured rate, a grid point takes the median or mean of the samples
    of its bin and the first original time; it is missing where the bin has no row. Above
    it, a point takes the nearest sample within one step, the later of two at equal
    distance; it is missing where that has no value. Every grid point is returned.
    """
    if method not in ("median", "mean"):
        raise ValueError(f"unknown method: {method}")
    rows = df.select(*keys, ts, tie, F.col(value).alias("value"))
    spans = _spans(rows, keys, ts, tie, target_hz)
    finer = F.lit(1.0) / F.col("period_s") > (1 + 1e-6) / F.col("measured")
    grid = spans.select(*keys, "t0", "step", finer.alias("finer"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin"))
    grid = grid.select(*keys, "bin", (F.col("t0") + F.col("bin") * F.col("step")).alias("t"), "step", "finer")
    placed = null_safe_join(rows, spans.filter(~finer).select(*keys, "t0", "step", "n"), keys)
    at = F.floor((micros(ts) - F.col("t0")) / F.col("step"))
    placed = placed.withColumn("bin", F.least(F.greatest(at, F.lit(0)), F.col("n") - 1).cast("long"))
    agg = (median if method == "median" else F.avg)(F.col("value"))
    binned = placed.groupBy(*keys, "bin").agg(agg.alias("value"), F.min_by(ts, F.col(tie)).alias("orig_ts"), F.lit(False).alias("missing"))
    coarse = null_safe_join(grid.filter(~F.col("finer")), binned, [*keys, "bin"], "left").withColumn("missing", F.coalesce("missing", F.lit(True)))
    out = coarse.select(*keys, "bin", from_micros(F.col("t")).alias("ts"), "orig_ts", "value", "missing")
    if not target_hz:
        return out
    points = grid.filter("finer")
    samples = null_safe_join(rows, spans.filter(finer).select(*keys, "step"), keys).select(*keys, micros(ts).alias("t"), tie, "step", F.struct(micros(ts).alias("t"), "value").alias("s"))
    both = samples.withColumn("bin", F.lit(None).cast("long")).unionByName(points.select(*keys, "t", "step", "bin"), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("t", F.col(tie).asc_nulls_last())
    both = both.withColumn("a", F.last("s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first("s", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    before, after = F.col("t") - F.col("a.t"), F.col("b.t") - F.col("t")
    near = F.when(F.col("b").isNotNull() & (after <= F.col("step")) & (F.col("a").isNull() | (after <= before)), F.col("b")).when(before <= F.col("step"), F.col("a"))
    fine = both.filter("bin is not null").withColumn("s", near)
    return out.unionByName(fine.select(*keys, "bin", from_micros(F.col("t")).alias("ts"), from_micros(F.col("s.t")).alias("orig_ts"), F.col("s.value").alias("value"), F.col("s.value").isNull().alias("missing")))


def gaps(grid: DataFrame, keys: list[str], period_s: float, least_s: float = GAP_S) -> DataFrame:
    """Runs of missing grid points longer than ``least_s``: keys, start, end (a step after the last) and n."""
    found = islands(grid, keys, ["ts"], "missing").filter(F.col("n") * period_s > least_s)
    return found.withColumn("end", from_micros(micros("end") + round(period_s * 1e6)))


def valid_samples(df: DataFrame, intervals: DataFrame, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    """Add ``valid``: the value is there and no interval (both ends inclusive) covers the sample.

    Intervals are merged into changes of a running count, so there is no range join:
    one sort per key, whatever the number of intervals.
    """
    kept = [f.name for f in df.schema if f.name not in keys]
    marks = intervals.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(0).alias("ord"), F.lit(1).alias("by")), F.struct(F.col("end").alias("at"), F.lit(2).alias("ord"), F.lit(-1).alias("by")))).alias("m"))
    rows = df.select(*keys, F.col(ts).alias("__at"), F.lit(1).alias("__ord"), F.lit(0).alias("__by"), F.struct(*kept).alias("__row"))
    both = rows.unionByName(marks.select(*keys, F.col("m.at").alias("__at"), F.col("m.ord").alias("__ord"), F.col("m.by").alias("__by")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__at", "__ord").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__open", F.sum("__by").over(w)).filter("__row is not null")
    return both.select(*keys, "__row.*", (F.col("__open") == 0).alias("__clear")).withColumn("valid", F.col("__clear") & F.col(value).isNotNull()).drop("__clear")
