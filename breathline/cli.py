"""The command line: parse, preprocess, segment, plot, analyze, quality, stats, events, pipeline.

Every step returns an exit code: 0 done, 1 nothing to work on, 2 wrong use.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breathline.operators import breaths, events
from breathline.operators.sessions import session_summary, sessionize
from breathline.plans import figures, pipeline
from breathline.session import get_session
from breathline.sources import exports, nights, reports, tables

CHANNELS = ("resA", "resB", "resC", "pulse")


def _complain(text: str) -> None:
    print(text, file=sys.stderr)


def _spark() -> SparkSession:
    spark = get_session("breathline", None if SparkSession.getActiveSession() else "local[*]")
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _figure(value: float | None, digits: int = 2) -> str:
    return "-" if value is None else f"{value:.{digits}f}"


def parse(argv: list[str]) -> int:
    """binary recordings to a CSV, or a summary by days"""
    p = argparse.ArgumentParser(prog="parse")
    p.add_argument("folder", nargs="?", default=".")
    for short, name in (("-i", "info"), ("-2", "f25_hz"), ("-1", "f10_hz"), ("-a", "all_data"), ("-y", "time_ymd"), ("-s", "time_seconds"), ("-q", "quiet")):
        p.add_argument(short, f"--{name}", action="store_true")
    p.add_argument("-o", "--output", default="RESmart_data.csv")
    p.add_argument("-d", "--dates", nargs="+", default=[])
    if not argv:
        p.print_help(sys.stderr)
        return 2
    a = p.parse_args(argv)
    try:
        days = exports.parse_dates(a.dates)
    except ValueError as bad:
        p.error(str(bad))
    try:
        rows = exports.recorded(_spark(), a.folder, days)
    except FileNotFoundError as none:
        _complain(str(none))
        return 1
    if a.info:
        if not a.quiet:
            print(f"{rows.count()} packets found in {rows.select('path').distinct().count()} files")
        for line in exports.info(rows):
            print(line)
        return 0
    time = "both" if a.time_ymd and a.time_seconds else "ymd" if a.time_ymd else "seconds" if a.time_seconds else "iso"
    mode = exports.Mode(time, a.all_data, 10 if a.f10_hz else 25 if a.f25_hz else 1)
    count = exports.write_lines(rows, exports.Mode("seconds", mode.all_words, mode.rate) if time == "both" else mode, a.output)
    if time == "both":  # the header of the dates stands above rows in seconds
        text = Path(a.output).read_text(encoding="utf-8").split("\n", 1)
        Path(a.output).write_text(exports.SEPARATOR.join(exports.header(mode)) + "\n" + text[1], encoding="utf-8")
    if not count:
        _complain("No data found")
    elif not a.quiet:
        _complain(f"{count} rows written to {a.output}")
    return 0


def preprocess(argv: list[str]) -> int:
    """clean a CSV and show its shape"""
    if not argv:
        _complain("usage: preprocess CSV")
        return 2
    df = tables.read_recording(_spark(), argv[0])
    print(f"{df.count()} rows, {len(df.columns) - 1} columns, {tables.count_rejected(_spark(), argv[0])} rows without a time left out")
    for name, kind in df.drop("seq").dtypes:
        print(f"  {name}: {kind}")
    return 0


def segment(argv: list[str]) -> int:
    """sessions of a CSV by gaps"""
    p = argparse.ArgumentParser(prog="segment")
    p.add_argument("csv")
    p.add_argument("limit_hours", nargs="?", type=float, default=4.0)
    p.add_argument("-o", "--output")
    if not argv:
        p.print_usage(sys.stderr)
        return 2
    a = p.parse_args(argv)
    df = sessionize(tables.read_recording(_spark(), a.csv), [], "timestamp", "seq", a.limit_hours)
    _print_segments(df)
    if a.output:
        pipeline.write_one_csv(df.orderBy("timestamp", "seq").drop("seq"), a.output)
    return 0


def _print_segments(df: DataFrame) -> None:
    for r in session_summary(df, [], "timestamp").orderBy("session_id").toLocalIterator():
        print(f"session {r.session_id}: {r.n_rows} rows, {r.start} to {r.end}, {r.duration_s / 3600:.2f} h")


def plot(argv: list[str]) -> int:
    """the data of a figure as a CSV"""
    p = argparse.ArgumentParser(prog="plot")
    p.add_argument("csv")
    p.add_argument("-o", "--output", default="figure.csv")
    which = p.add_mutually_exclusive_group()
    which.add_argument("--session", type=int)
    which.add_argument("--overlay", type=int)
    which.add_argument("--tidal", action="store_true")
    p.add_argument("--wave", choices=CHANNELS)
    p.add_argument("--epap", action="store_true")
    if not argv:
        p.print_usage(sys.stderr)
        return 2
    a = p.parse_args(argv)
    if a.tidal and a.wave:
        p.error("--tidal and --wave exclude each other")
    df = nights.read_sessions(_spark(), a.csv)
    try:
        if a.tidal:
            found = figures.tidal_volume_distribution(df).orderBy("x")
        elif a.overlay:
            found = figures.overlapped_sessions(df, a.overlay, a.epap).orderBy("session_id", "hours_since_start")
        else:
            session = a.session if a.session is not None else df.agg(F.max("session_id")).first()[0]  # the last one
            part = df.filter(F.col("session_id") == session)
            if not part.limit(1).count():
                _complain(f"session {session} not found")
                return 1
            found = (figures.waveform(part, a.wave) if a.wave else figures.pressure_curve(part)).orderBy("ts")
    except ValueError as bad:
        _complain(str(bad))
        return 1
    print(f"wrote {pipeline.write_one_csv(found, a.output)}")
    return 0


def analyze(argv: list[str]) -> int:
    """clean, segment and summarise a CSV, with its pressure by session"""
    if not argv:
        _complain("usage: analyze CSV")
        return 2
    df = nights.read_sessions(_spark(), argv[0])
    _print_segments(df)
    try:
        curve = figures.pressure_curve(df)
    except ValueError as bad:
        _complain(str(bad))
        return 1
    for r in curve.groupBy("session_id").agg(F.avg("ipap").alias("i"), F.avg("epap").alias("e")).orderBy("session_id").toLocalIterator():
        print(f"session {r.session_id}: IPAP {_figure(r.i)} cmH2O, EPAP {_figure(r.e)} cmH2O on average")
    return 0


def _options(prog: str, actions: tuple[str, ...] = ()) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=prog)
    if actions:
        p.add_argument("action", choices=actions)
    p.add_argument("--input", required=True)
    p.add_argument("--channel", default="resA", choices=CHANNELS)
    p.add_argument("--session", type=int)
    p.add_argument("--report-dir", default="reports")
    p.add_argument("--limit-hours", type=float, default=4.0)
    p.add_argument("--block-minutes", type=float, default=5.0)
    p.add_argument("--drop-pct", type=float, default=0.30)
    p.add_argument("--min-duration-s", type=float, default=10.0)
    p.add_argument("--apnea-drop-pct", type=float, default=0.80)
    p.add_argument("--mask-off-minutes", type=float, default=2.0)
    p.add_argument("--json")
    return p


def _samples(a: argparse.Namespace) -> tuple[DataFrame, float]:
    """The channel of the wanted sessions and its rate."""
    if a.session is not None:
        night = nights.load_session(_spark(), a.input, a.session, a.channel, a.limit_hours)
        return night.samples, night.sample_rate_hz
    rows = nights.channel_of(nights.read_sessions(_spark(), a.input, a.limit_hours), a.channel)
    period = nights.sampling_period(rows, ["session_id"]).agg(F.percentile("period_s", F.lit(0.5))).first()[0]
    return rows, 1.0 / period if period else nights.DEFAULT_HZ


def _run(a: argparse.Namespace, steps: tuple[str, ...]) -> pipeline.Analysis:
    rows, rate = _samples(a)
    return pipeline.run(rows, ["session_id"], "value", rate, steps, a.block_minutes, a.mask_off_minutes, drop=a.drop_pct, min_duration_s=a.min_duration_s, apnea_drop=a.apnea_drop_pct)


def _require_reports(a: argparse.Namespace) -> None:
    rows, _ = _samples(a)
    for r in rows.groupBy("session_id").agg(F.min("ts").alias("start")).orderBy("session_id").toLocalIterator():
        reports.load_quality_or_error(_spark(), reports.report_path(a.report_dir, r.session_id, r.start)).limit(1).count()


def quality(argv: list[str]) -> int:
    """quality reports of the sessions: quality preprocess"""
    if not argv:
        _complain("usage: quality preprocess --input CSV")
        return 2
    a = _options("quality", ("preprocess",)).parse_args(argv)
    try:
        out = _run(a, ("quality",))
        paths = pipeline.write_artifacts(out, a.report_dir, a.channel)
    except ValueError as bad:
        _complain(str(bad))
        return 1
    for r in out.quality.orderBy("session_id").toLocalIterator():
        print(f"session {r.session_id}: {r.valid_pct:.1f} % of {r.total_samples} samples valid; " + ", ".join(f"{k} {r[f'n_{k}']}" for k in reports.KINDS))
    print("\n".join(f"wrote {p}" for p in paths))
    return 0


def stats(argv: list[str]) -> int:
    """statistics of the sessions: stats stats, or stats trend"""
    if not argv:
        _complain("usage: stats {stats,trend} --input CSV")
        return 2
    a = _options("stats", ("stats", "trend")).parse_args(argv)
    try:
        _require_reports(a)
        out = _run(a, ("quality", "stats"))
    except ValueError as bad:
        _complain(str(bad))
        return 2
    if a.action == "trend":
        rows = pipeline.trend(out.stats, ["session_id"]).orderBy("session_id")
        for r in rows.toLocalIterator():
            print(f"{r.date} session {r.session_id}: use {r.usage_duration_s / 3600:.2f} h, rate {_figure(r.rr_mean)} /min")
        print(f"wrote {pipeline.write_one_csv(rows, f'{a.report_dir}/nightly_trend.csv')}")
        return 0
    shapes = {r.session_id: r for r in breaths.volume_distribution(out.volumes, ["session_id"]).toLocalIterator()}
    for r in out.stats.orderBy("session_id").toLocalIterator():
        shape = shapes.get(r.session_id)
        print(f"session {r.session_id}, {a.channel}, {r.start:%Y-%m-%d %H:%M} to {r.end:%Y-%m-%d %H:%M}")
        print(f"  use {r.usage_duration_s / 3600:.2f} h of {r.total_duration_s / 3600:.2f} h ({r.night_usage_pct:.1f} %), {r.signal_valid_pct:.1f} % of samples valid")
        print(f"  flow median {_figure(r.flow_median, 1)}, mean {_figure(r.flow_mean, 1)}, IQR {_figure(r.flow_iqr, 1)}, p05 {_figure(r.flow_p05, 1)}, p95 {_figure(r.flow_p95, 1)}")
        print(f"  {r.n_breaths} breaths, volume mode {_figure(r.tidal_mode, 3)}, p90 {_figure(r.volume_p90, 3)}, two modes: {bool(shape and shape.bimodal)}")
        print(f"  rate median {_figure(r.rr_median)}, mean {_figure(r.rr_mean)}, IQR {_figure(r.rr_iqr)}; {r.n_blocks_valid} of {r.n_blocks} blocks ({r.rr_coverage_pct:.1f} %)")
        for text in r.warnings:
            print(f"  note: {text}")
        if a.json:
            pipeline.write_json(pipeline.stats_payload(out, r.session_id), a.json)
    return 0


def events_step(argv: list[str]) -> int:
    """respiratory events of the sessions: events events, or events events-report"""
    if not argv:
        _complain("usage: events {events,events-report} --input CSV")
        return 2
    a = _options("events", ("events", "events-report")).parse_args(argv)
    try:
        _require_reports(a)
        out = _run(a, ("quality", "events"))
    except ValueError as bad:
        _complain(str(bad))
        return 2
    if a.action == "events-report":
        rows = pipeline.events_summary(out.report)
        for r in rows.toLocalIterator():
            print(f"{r.date} session {r.session_id}: {r.n_events} events ({r.suspect_pct} % suspect), AHI {_figure(r.estimated_ahi)} /h, hours {r.events_by_hour}")
        print(f"wrote {pipeline.write_one_csv(rows, f'{a.report_dir}/events_summary.csv')}")
        return 0
    params = {"drop_pct": a.drop_pct, "min_duration_s": a.min_duration_s, "apnea_drop_pct": a.apnea_drop_pct, "mask_off_minutes": a.mask_off_minutes}
    listed = events.timeline(out.events, ["session_id"]).orderBy("session_id", "start")
    for r in listed.toLocalIterator():
        print(f"session {r.session_id} {r.start:%H:%M:%S} {r.event_type} {r.duration_s:.0f} s, reduction {r.reduction:.2f}, {r.quality_flag}, {r.confidence}")
    for r in out.report.orderBy("session_id").toLocalIterator():
        print(f"session {r.session_id}: {r.n_events} events, AHI {_figure(r.estimated_ahi)} /h, confident {_figure(r.estimated_ahi_confident)} /h, mask off {r.n_mask_removals} times")
        if a.json:
            pipeline.write_json(pipeline.events_payload(out, r.session_id, a.channel, params), a.json)
    return 0


def pipeline_step(argv: list[str]) -> int:
    """quality, stats and events of every session"""
    p = _options("pipeline")
    p.add_argument("--steps", default=",".join(pipeline.STEPS))
    a = p.parse_args(argv)
    steps = tuple(s.strip() for s in a.steps.split(",") if s.strip())
    try:
        pipeline.check_steps(steps)
    except ValueError as bad:
        _complain(f"pipeline: {bad}")
        return 2
    Path(a.report_dir).mkdir(parents=True, exist_ok=True)
    if "quality" not in steps:  # the later layers need the reports of the same call
        print(f"pipeline done: {len(nights.all_session_ids(_spark(), a.input, a.limit_hours))} session(s)")
        return 0
    out = _run(a, steps)
    paths = pipeline.write_artifacts(out, a.report_dir, a.channel)
    rows = out.quality.select("session_id", "valid_pct")
    if out.stats is not None:
        rows = rows.join(out.stats.select("session_id", "usage_duration_s"), "session_id", "left")
    if out.report is not None:
        rows = rows.join(out.report.select("session_id", "n_events", "estimated_ahi"), "session_id", "left")
    found = rows.orderBy("session_id").collect()  # a row per session
    print(f"pipeline done: {len(found)} session(s)")
    for r in found:
        parts = [f"valid {r.valid_pct:.1f}%"]
        if out.stats is not None:
            parts.append(f"use {r.usage_duration_s / 3600:.2f} h")
        if out.report is not None:
            parts.append(f"events {r.n_events} | estimated_AHI {r.estimated_ahi or 0.0:.2f} /h")
        print(f"  session {r.session_id}: " + " | ".join(parts))
    print("\n".join(f"wrote {path}" for path in paths))
    return 0


STEPS: dict[str, Callable[[list[str]], int]] = {
    "parse": parse, "preprocess": preprocess, "segment": segment, "plot": plot, "analyze": analyze,
    "quality": quality, "stats": stats, "events": events_step, "pipeline": pipeline_step,
}


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv or argv[0] not in STEPS:
        _complain("usage: python -m breathline STEP [options]\n" + "\n".join(f"  {name:<12}{step.__doc__}" for name, step in STEPS.items()))
        return 2
    return STEPS[argv[0]](argv[1:])
