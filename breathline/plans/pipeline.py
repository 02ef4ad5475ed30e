"""All layers over all sessions as one plan: quality, statistics, events."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathline.operators import breaths, events, signal
from breathline.operators.frames import null_safe_join
from breathline.operators.grid import gaps, resample
from breathline.sources import reports
from breathline.storage import keep

STEPS = ("quality", "stats", "events")


@dataclass
class Analysis:
    """Tables keyed by the session columns; those of a step left out are None."""

    grid: DataFrame
    intervals: DataFrame
    quality: DataFrame
    findings: DataFrame
    period_s: float
    stats: DataFrame | None = None
    rates: DataFrame | None = None
    volumes: DataFrame | None = None
    events: DataFrame | None = None
    removals: DataFrame | None = None
    report: DataFrame | None = None
    params: dict[str, float] = field(default_factory=dict)


def check_steps(steps: tuple[str, ...]) -> None:
    unknown = set(steps) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps: {', '.join(sorted(unknown))}")
    if not steps:
        raise ValueError(f"name at least one of {', '.join(STEPS)}")


def run(
    sessions: DataFrame, keys: list[str], channel: str, rate_hz: float = 25.0, steps: tuple[str, ...] = STEPS, block_minutes: float = 5, min_mask_minutes: float = 2.0, lo: float | None = None, hi: float | None = None,
    drop: float = 0.30, min_duration_s: float = 10.0, apnea_drop: float = 0.80, factor: float = 25.0, window_s: float = 300.0, tolerance: float = 0.5,
) -> Analysis:
    """``sessions`` has the keys, ts, seq and the channel. Statistics and events build on the quality flags.

    The flagged grid is written once to the shared folder and read by every later step.
    A session without any value fails the quality step.
    """
    check_steps(steps)
    period = 1.0 / rate_hz
    grid = resample(sessions, keys, channel, rate_hz).withColumnRenamed("bin", "seq")
    flagged = signal.artifacts(signal.require_signal(grid, keys, "value"), keys, "value", lo=lo, hi=hi, factor=factor, window_s=window_s, tolerance=tolerance)
    flagged = keep(flagged.withColumn("valid", ~F.col("in_qc") & F.col("value").isNotNull()), "flagged")
    intervals = signal.artifact_intervals(flagged, keys)
    found = gaps(flagged, keys, period)
    said = found.select(*keys, F.format_string("gap > 5 s in the signal: %s to %s", reports.iso(F.col("start")), reports.iso(F.col("end"))).alias("finding"))
    findings = said.unionByName(signal.drift_findings(flagged, keys, window_s=window_s))
    params = {"spike_rel_factor": factor, "drift_window_s": window_s, "drift_rel_tol": tolerance, **({"clip_lo": lo} if lo is not None else {}), **({"clip_hi": hi} if hi is not None else {})}
    out = Analysis(flagged, intervals, signal.quality_report(flagged, intervals, keys), findings, period, params=params)
    if "stats" in steps:
        out.rates = breaths.respiratory_rate(flagged, keys, "value", period, block_minutes)
        out.volumes = breaths.volumes(flagged, keys, "value", period)
        out.stats = breaths.session_stats(flagged, out.rates, out.volumes, keys, "value", period)
    if "events" in steps:
        env = events.envelope(flagged, keys, "value")
        out.removals = events.mask_removals(env, keys, min_mask_minutes)
        out.events = events.flow_limitations(env, flagged, keys, drop, min_duration_s, apnea_drop, exclude=out.removals)
        usage = flagged.groupBy(*keys).agg((F.count_if("valid") * period / 3600).alias("usage_hours"), F.min("ts").alias("start"), F.max("ts").alias("end"))
        out.report = null_safe_join(events.events_report(out.events, out.removals, usage.select(*keys, "usage_hours"), keys), usage.select(*keys, F.to_date("start").alias("date"), "start", "end"), keys)
    return out


def trend(stats: DataFrame, keys: list[str]) -> DataFrame:
    """One row per night, durations and shares rounded to three digits."""
    rounded = [F.bround(c, 3).alias(c) for c in ("total_duration_s", "usage_duration_s", "night_usage_pct", "signal_valid_pct")]
    return stats.select(*keys, F.to_date("start").alias("date"), *rounded, "flow_median", "tidal_mode", "rr_mean", "rr_iqr", "n_blocks_valid")


def _plain(value):
    """A value as JSON knows it."""
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def stats_payload(out: Analysis, session_id: int) -> dict:
    """One session's statistics, volume distribution and blocks of respiratory rate, for JSON."""
    of = lambda df: df.filter(F.col("session_id") == session_id)
    session = of(out.stats).first()
    hist = of(breaths.volume_distribution(out.volumes, ["session_id"])).first()
    rates = [r.asDict() for r in of(out.rates).orderBy("block").toLocalIterator()]
    return _plain({"session": session.asDict(True), "volume_distribution": hist.asDict(True) if hist else {"edges": [], "counts": []}, "respiratory_rate": rates})


def events_payload(out: Analysis, session_id: int, channel: str, params: dict) -> dict:
    """One session's events with their rounded figures, mask removals, hours and AHI, for JSON."""
    of = lambda df: df.filter(F.col("session_id") == session_id)
    row = of(out.report).first()
    off = of(out.removals).select(F.timestamp_seconds("start_sec").cast("timestamp_ntz").alias("start"), F.timestamp_seconds("end_sec").cast("timestamp_ntz").alias("end"), (F.col("end_sec") - F.col("start_sec")).cast("double").alias("duration_s"), "threshold")
    removals = [r.asDict() for r in off.orderBy("start").toLocalIterator()]
    listed = [r.asDict() for r in of(events.timeline(out.events, ["session_id"])).drop("session_id").orderBy("start").toLocalIterator()]
    ahi = {"usage_hours": round(row.usage_hours, 4), "n_events": row.n_events, "n_confident": row.n_confident} | {k: None if row[k] is None else round(row[k], 4) for k in ("estimated_ahi", "estimated_ahi_confident")}
    head = {"session_id": session_id, "channel": channel, "start": row.start, "end": row.end}
    threshold = removals[0]["threshold"] if removals else None
    return _plain({"session": head, "params": params, "mask_removal_threshold": threshold, "mask_removals": [{k: v for k, v in r.items() if k != "threshold"} for r in removals], "events": listed, "events_by_hour": dict(sorted(row.by_hour.items())), "ahi": ahi})


def events_summary(report: DataFrame) -> DataFrame:
    """The events report as text and rounded figures, one row per session."""
    by_hour = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries("by_hour")), lambda e: F.format_string('"%s": %d', e["key"], e["value"])), ", "), F.lit("}"))
    return report.select(
        "session_id", F.date_format("date", "yyyy-MM-dd").alias("date"), reports.iso(F.col("start")).alias("start"), reports.iso(F.col("end")).alias("end"), F.bround("usage_hours", 4).alias("usage_hours"),
        "n_events", "n_suspect", "suspect_pct", "estimated_ahi", "estimated_ahi_confident", by_hour.alias("events_by_hour"), "n_mask_removals", F.bround("mask_removal_hours", 4).alias("mask_removal_hours"),
    ).orderBy("session_id")


def write_one_csv(df: DataFrame, path: str) -> str:
    """A small table as one CSV file with a header, replaced if it is there; rows come one at a time."""
    import csv

    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(df.columns)
        for row in df.toLocalIterator():
            writer.writerow(["" if v is None else _plain(v) for v in row])
    return path


def write_json(payload: dict, path: str) -> str:
    Path(path).write_text(json.dumps(payload, indent=2, ensure_ascii=False), encoding="utf-8")
    return path


def write_artifacts(out: Analysis, folder: str, channel: str) -> list[str]:
    """The reports of every session, the timelines, the trend and the summary, as far as their steps ran; the paths."""
    starts = out.grid.groupBy("session_id").agg(F.min("ts").alias("start"))
    paths = reports.write_reports(reports.reports(out.quality.join(starts, "session_id"), out.intervals, out.findings, channel, 1 / out.period_s, out.params), folder)
    if out.events is not None:
        timeline = keep(events.timeline(out.events, ["session_id"]), "timeline")
        for row in starts.orderBy("session_id").toLocalIterator():
            own = timeline.filter(F.col("session_id") == row.session_id).drop("session_id").orderBy("start")
            paths.append(write_one_csv(own, reports.report_path(folder, row.session_id, row.start, "events", "csv")))
    if out.stats is not None:
        paths.append(write_one_csv(trend(out.stats, ["session_id"]).orderBy("session_id"), f"{folder}/nightly_trend.csv"))
    if out.report is not None:
        paths.append(write_one_csv(events_summary(out.report), f"{folder}/events_summary.csv"))
    return paths
