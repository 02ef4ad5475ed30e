"""Respiratory events on the per-second envelope: mask removals, flow limitations, AHI."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breathline.operators.frames import centred, islands, median, rolling
from breathline.operators.grid import second

MIN_ROWS_PER_S = 10
SMOOTH_S, SMOOTH_LEAST = 5, 2
BASELINE_S, BASELINE_LEAST = 300, 90
MASK_SHARE = 0.20
MIN_VALID = 0.9


def envelope(df: DataFrame, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    """(keys, sec, activity): population deviation per second; null below ten rows, nulls counted."""
    got = df.groupBy(*keys, second(ts).alias("sec")).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(value).alias("sd"))
    return got.select(*keys, "sec", F.when(F.col("n") >= MIN_ROWS_PER_S, F.col("sd")).alias("activity"))


def mask_removals(env: DataFrame, keys: list[str], min_minutes: float = 2.0, threshold: float | None = None) -> DataFrame:
    """(keys, start_sec, end_sec, threshold) of quiet runs; by default below a fifth of the median activity.

    The end is a second after the last quiet one. A null second ends a run.
    """
    limit = F.lit(threshold) if threshold is not None else F.coalesce(MASK_SHARE * median(F.col("activity")).over(Window.partitionBy(*keys)), F.lit(0.0))
    quiet = env.withColumn("threshold", limit.cast("double")).withColumn("quiet", F.coalesce(F.col("activity") < F.col("threshold"), F.lit(False)))
    runs = islands(quiet, [*keys, "threshold"], ["sec"], "quiet").filter(F.col("n") >= max(1, round(min_minutes * 60)))
    return runs.select(*keys, F.col("start").alias("start_sec"), (F.col("end") + 1).alias("end_sec"), "threshold")


def _covered(env: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Mark the seconds inside spans (both ends inclusive); spans are at least a second and expand to seconds."""
    secs = spans.select(*keys, F.explode(F.sequence("start_sec", "end_sec")).alias("sec")).distinct().withColumn("__in", F.lit(True))
    return env.join(secs, [*keys, "sec"], "left").withColumn("excluded", F.coalesce("__in", F.lit(False))).drop("__in")


def flow_limitations(env: DataFrame, samples: DataFrame, keys: list[str], drop: float = 0.30, min_duration_s: float = 10.0, apnea_drop: float = 0.80, exclude: DataFrame | None = None) -> DataFrame:
    """(keys, start_sec, end_sec, duration_s, reduction, event_type, quality_flag, confidence).

    A run of at least ``min_duration_s`` seconds whose smoothed activity is below the
    baseline by more than ``drop``. ``samples`` has keys, ts, ``valid`` and ``in_qc``
    (inside an artifact interval): an event that touches an artifact, or of which less
    than nine tenths are valid, is suspect. The second after the event counts with its
    first instant, as ends are inclusive.
    """
    w5, w300 = centred(keys, ["sec"], SMOOTH_S), centred(keys, ["sec"], BASELINE_S)
    a = F.col("activity")
    env = _covered(env, exclude, keys) if exclude is not None else env.withColumn("excluded", F.lit(False))
    env = env.withColumn("smooth", rolling(a, median, w5, SMOOTH_LEAST)).withColumn("base", rolling(a, median, w300, BASELINE_LEAST))
    env = env.withColumn("below", F.coalesce(F.col("smooth") < F.col("base") * (1.0 - drop), F.lit(False)) & ~F.col("excluded"))
    w = Window.partitionBy(*keys).orderBy("sec")
    run = F.row_number().over(w) - F.sum(F.col("below").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    low = env.withColumn("__run", run).filter("below")
    found = low.groupBy(*keys, "__run").agg(F.min("sec").alias("start_sec"), (F.max("sec") + 1).alias("end_sec"), F.count(F.lit(1)).alias("n"), median(F.col("smooth")).alias("s"), median(F.col("base")).alias("b"))
    found = found.filter((F.col("n") >= max(1, round(min_duration_s))) & (F.col("b") > 0)).withColumn("reduction", 1.0 - F.col("s") / F.col("b")).filter(F.col("reduction") >= drop)
    per_sec = samples.groupBy(*keys, second("ts").alias("sec")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("ok"), F.count_if("in_qc").alias("bad"),
        F.count_if(F.date_trunc("second", "ts").cast("timestamp_ntz") == F.col("ts")).alias("n0"),
        F.count_if((F.date_trunc("second", "ts").cast("timestamp_ntz") == F.col("ts")) & F.col("valid")).alias("ok0"),
        F.count_if((F.date_trunc("second", "ts").cast("timestamp_ntz") == F.col("ts")) & F.col("in_qc")).alias("bad0"),
    )
    each = found.drop("n", "s", "b").withColumn("sec", F.explode(F.sequence("start_sec", "end_sec"))).join(per_sec, [*keys, "sec"], "left")
    last = F.col("sec") == F.col("end_sec")
    part = lambda whole, first: F.sum(F.coalesce(F.when(last, F.col(first)).otherwise(F.col(whole)), F.lit(0)))
    out = each.groupBy(*keys, "start_sec", "end_sec", "reduction").agg(part("n", "n0").alias("n"), part("ok", "ok0").alias("ok"), part("bad", "bad0").alias("bad"))
    frac = F.when(F.col("n") > 0, F.col("ok") / F.col("n")).otherwise(1.0)
    suspect = (F.col("bad") > 0) | (frac < MIN_VALID)
    return out.select(
        *keys, "start_sec", "end_sec", (F.col("end_sec") - F.col("start_sec")).cast("double").alias("duration_s"), "reduction",
        F.when(F.col("reduction") >= apnea_drop, "apnea").otherwise("hypopnea").alias("event_type"),
        F.when(suspect, "suspect").otherwise("ok").alias("quality_flag"),
        F.when(~suspect & (frac >= 1.0), "high").otherwise("low").alias("confidence"),
    )


def ahi(events: DataFrame, usage: DataFrame, keys: list[str]) -> DataFrame:
    """Events per hour of use, of all events and of those not suspect; null without use. ``usage`` has keys and usage_hours."""
    counts = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("quality_flag") == "ok").alias("n_confident"))
    out = usage.join(counts, keys, "left").fillna(0, ["n_events", "n_confident"])
    hours = F.when(F.col("usage_hours") > 0, F.col("usage_hours"))
    return out.select(*keys, "usage_hours", "n_events", "n_confident", (F.col("n_events") / hours).alias("estimated_ahi"), (F.col("n_confident") / hours).alias("estimated_ahi_confident"))


def timeline(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events as rows with times, the hour they start in, and rounded figures."""
    at = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    return events.select(*keys, at("start_sec").alias("start"), at("end_sec").alias("end"), F.bround("duration_s", 3).alias("duration_s"), F.bround("reduction", 4).alias("reduction"), "event_type", "quality_flag", "confidence", F.hour(at("start_sec")).alias("hour_of_night"))


def events_by_hour(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, by_hour): a map from two-digit hour to the number of events that start in it."""
    per = events.groupBy(*keys, F.date_format(F.timestamp_seconds("start_sec").cast("timestamp_ntz"), "HH").alias("h")).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("h", "c")))).alias("by_hour"))


def events_report(events: DataFrame, removals: DataFrame, usage: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: AHI figures, suspect share, events by hour, and mask removals with their hours."""
    off = removals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_mask_removals"), (F.sum(F.col("end_sec") - F.col("start_sec")) / 3600).alias("mask_removal_hours"))
    out = ahi(events, usage, keys).join(events_by_hour(events, keys), keys, "left").join(off, keys, "left").fillna(0, ["n_mask_removals", "mask_removal_hours"])
    out = out.withColumn("by_hour", F.coalesce("by_hour", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))))
    suspect = F.col("n_events") - F.col("n_confident")
    share = F.when(F.col("n_events") > 0, F.bround(100 * suspect / F.col("n_events"), 1)).otherwise(0.0)
    return out.withColumn("n_suspect", suspect).withColumn("suspect_pct", share)
