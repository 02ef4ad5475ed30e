"""The data behind the figures: each function returns the rows that a plot shows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breathline.operators import breaths
from breathline.sources.nights import hours_since_start, last_sessions, pressure

#: Points that a figure shows at most, about.
POINTS = 200_000
TIDAL = "tidal_vol (L/min)"


def column_of(df: DataFrame, name: str) -> str:
    """The column whose name is ``name`` up to blanks or begins with it and a unit; ValueError without one."""
    found = [c for c in df.columns if c.strip() == name] or [c for c in df.columns if c.strip().startswith(name + " (")]
    if not found:
        raise ValueError(f"column '{name}' not found: parse and clean the recording first")
    return found[0]


def decimate(df: DataFrame, keys: list[str], order: list[str], points: int = POINTS) -> DataFrame:
    """Every k-th row of each key, k the number of rows by ``points``, rounded to even, at least one."""
    w = Window.partitionBy(*keys)
    k = F.greatest(F.lit(1), F.bround(F.count(F.lit(1)).over(w) / points)).cast("long")
    numbered = df.withColumns({"__k": k, "__i": F.row_number().over(w.orderBy(*order)) - 1})
    return numbered.filter("__i % __k = 0").drop("__k", "__i")


def pressure_curve(df: DataFrame) -> DataFrame:
    """(session_id, ts, ipap, epap) in cmH2O; ValueError with fewer than two rows."""
    if df.limit(2).count() < 2:
        raise ValueError("fewer than two rows: nothing to draw")
    return df.select("session_id", F.col("timestamp").alias("ts"), pressure(column_of(df, "IPAP")).alias("ipap"), pressure(column_of(df, "EPAP")).alias("epap"))


def overlapped_sessions(df: DataFrame, n: int, epap: bool = False) -> DataFrame:
    """(session_id, hours_since_start, ipap, and epap if asked) of the last ``n`` sessions."""
    rows = last_sessions(df, n).withColumnRenamed("timestamp", "ts")
    extra = [pressure(column_of(df, "EPAP")).alias("epap")] if epap else []
    return rows.select("session_id", hours_since_start("ts").alias("hours_since_start"), pressure(column_of(df, "IPAP")).alias("ipap"), *extra)


def waveform(df: DataFrame, channel: str, points: int = POINTS) -> DataFrame:
    """(session_id, ts, value) of a channel, decimated; ValueError for an unknown one."""
    if channel not in ("resA", "resB", "resC", "pulse"):
        raise ValueError(f"unknown channel: {channel}")
    rows = df.select("session_id", F.col("timestamp").alias("ts"), "seq", F.col(f"`{column_of(df, channel)}`").alias("value"))
    return decimate(rows, ["session_id"], ["ts", "seq"], points).drop("seq")


def density(df: DataFrame, keys: list[str], value: str, bins: int = 30, points: int = 200) -> DataFrame:
    """(keys, x, density, kde): a histogram of unit area with a Gaussian kernel estimate at the bins' centres.

    The estimate sums over the values' counts in ``points`` fine bins, so its cost does not
    grow with the rows; the width follows Scott's rule. Nulls are left out; equal values
    are one bin of width one.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).filter("v is not null")
    got = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd"))
    got = got.withColumn("span", F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0)))
    got = got.withColumn("h", F.coalesce(F.nullif("sd", F.lit(0.0)), F.col("span")) * F.pow(F.col("n"), -0.2))
    at = lambda m: F.least(F.floor((F.col("v") - F.col("lo")) / F.col("span") * m), F.lit(m - 1)).cast("long")
    fine = rows.join(F.broadcast(got), keys) if keys else rows.crossJoin(F.broadcast(got))  # one row per key
    fine = fine.groupBy(*keys, "n", "lo", "span", "h", at(bins * points).alias("f")).agg(F.count(F.lit(1)).alias("c"), F.avg("v").alias("m"))
    packed = fine.groupBy(*keys, "n", "lo", "span", "h").agg(F.collect_list(F.struct("f", "c", "m")).alias("cells"))  # bins * points cells at most
    each = packed.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("x", F.col("lo") + (F.col("b") + 0.5) * F.col("span") / bins)
    inside = F.aggregate(F.filter("cells", lambda c: F.floor(c["f"] / points) == F.col("b")), F.lit(0).cast("long"), lambda s, c: s + c["c"])
    bell = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["c"] * F.exp(-0.5 * F.pow((F.col("x") - c["m"]) / F.col("h"), 2)))
    return each.select(*keys, "x", (inside / F.col("n") * bins / F.col("span")).alias("density"), (bell / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("kde"))


def tidal_volume_distribution(df: DataFrame, bins: int = 30) -> DataFrame:
    """The density of the stored tidal volumes over all sessions; ValueError if there is none."""
    name = column_of(df, TIDAL)
    if not df.filter(F.col(f"`{name}`").isNotNull()).limit(1).count():
        raise ValueError(f"column '{TIDAL}' has no value")
    return density(df.withColumnRenamed(name, "v"), [], "v", bins)


def signal_quality(flagged: DataFrame, intervals: DataFrame, points: int = POINTS) -> tuple[DataFrame, DataFrame]:
    """The decimated signal (session_id, ts, value) and its intervals (session_id, start, end, kind)."""
    return decimate(flagged, ["session_id"], ["ts", "seq"], points).select("session_id", "ts", "value"), intervals.select("session_id", "start", "end", "kind")


def volume_distribution(found: DataFrame) -> DataFrame:
    """(session_id, left, right, count, is_mode) of the breath volumes' histogram."""
    hist = breaths.volume_histogram(found, ["session_id"])
    rows = hist.select("session_id", "edges", "mode", F.posexplode("counts").alias("i", "count"))
    left, right = F.col("edges")[F.col("i")], F.col("edges")[F.col("i") + 1]
    return rows.select("session_id", left.alias("left"), right.alias("right"), "count", F.col("mode").between(left, right).alias("is_mode"))


def night_events(flagged: DataFrame, timeline: DataFrame, removals: DataFrame, points: int = POINTS) -> tuple[DataFrame, DataFrame]:
    """The decimated signal, and (session_id, start, end, kind) of the events and the mask removals."""
    at = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    off = removals.select("session_id", at("start_sec").alias("start"), at("end_sec").alias("end"), F.lit("mask off").alias("kind"))
    marks = timeline.select("session_id", "start", "end", F.col("event_type").alias("kind")).unionByName(off)
    return decimate(flagged, ["session_id"], ["ts", "seq"], points).select("session_id", "ts", "value"), marks
