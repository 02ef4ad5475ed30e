"""Packets, grids, artifacts, breaths and events on signals with known results."""

import math
import struct
from datetime import datetime, timedelta

import numpy as np
import pytest

from breathline.operators import breaths, events, grid, signal
from breathline.plans import pipeline
from breathline.sources import packets, tables

START = datetime(2026, 9, 17, 22, 30)


def frame(spark, values, period=0.04, start=START):
    rows = [(1, i, start + timedelta(microseconds=round(period * 1e6) * i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "session_id long, seq long, ts timestamp_ntz, v double")


def packet(when, words=None, pulse=0):
    values = [0] * 106
    values[102] = pulse
    for i, v in (words or {}).items():
        values[i] = v
    return struct.pack("<106H", *values) + bytes(36) + struct.pack("<HBBBBBB", *when, 0)


def test_packets_drop_the_last_and_quarantine_bad_dates(spark, tmp_path):
    times = [(2026, 7, 21, 22, 0, s) for s in range(4)] + [(2026, 13, 1, 0, 0, 0)]
    (tmp_path / "S.000").write_bytes(b"".join(packet(t, {2: 65535, 4: 7}, pulse=int(i == 1)) for i, t in enumerate(times)))
    (tmp_path / "short.001").write_bytes(b"x" * 256)
    (tmp_path / "notes.txt").write_bytes(b"x" * 1024)
    assert packets.read_packets(spark, str(tmp_path)).count() == 4
    kept = packets.read_packets(spark, str(tmp_path), keep_last=True)
    assert kept.filter("ts is null").count() == 2
    rows = packets.known_values(packets.read_packets(spark, str(tmp_path))).collect()
    assert len(rows) == 4 and all(r.IPAP is None for r in rows)
    waves = packets.waveforms(packets.read_packets(spark, str(tmp_path)))
    assert waves.count() == 100 and waves.filter("sub = 0").first().resA == 7.0
    tally = packets.day_tally(packets.read_packets(spark, str(tmp_path))).collect()
    assert [(r.seconds, r.hours) for r in tally] == [(4, "." * 22 + "+.")]


def test_resampling(spark):
    same = grid.resample(frame(spark, range(400)), ["session_id"], "v", 25.0)
    assert same.count() == 400 and same.filter("missing or ts <> orig_ts").count() == 0
    down = grid.resample(frame(spark, range(400), 0.01), ["session_id"], "v", 25.0)
    assert down.count() in (100, 101) and down.filter("not missing").count() == 100
    holed = frame(spark, range(400)).filter("seq < 100 or seq >= 275")
    found = grid.gaps(grid.resample(holed, ["session_id"], "v", 25.0), ["session_id"], 0.04).collect()
    assert [r.n for r in found] == [175]
    up = grid.resample(frame(spark, [0.0, 1.0, 2.0]), ["session_id"], "v", 50.0).orderBy("bin").collect()
    assert [r.value for r in up] == [0.0, 1.0, 1.0, 2.0, 2.0]
    with pytest.raises(ValueError):
        grid.resample(holed, ["session_id"], "v", 25.0, method="mode")


def test_validity_includes_both_ends(spark):
    iv = spark.createDataFrame([(1, START + timedelta(seconds=a), START + timedelta(seconds=b)) for a, b in ((2, 3), (5, 5), (9, 9))], "session_id long, start timestamp_ntz, end timestamp_ntz")
    got = grid.valid_samples(frame(spark, range(10), 1.0), iv, ["session_id"], "v").orderBy("seq").collect()
    assert [r.valid for r in got] == [i not in (2, 3, 5, 9) for i in range(10)]


def test_drift_and_night_blocks(spark):
    rng = np.random.default_rng(1)
    step = 5 + 0.1 * np.sin(np.arange(7500) / 10) + 0.02 * rng.normal(size=7500) + 2.0 * (np.arange(7500) >= 3750)
    assert signal.flag_drift(frame(spark, step), ["session_id"], "v", window_s=60).filter("drift").count() > 500
    t = np.arange(4 * 3600)
    blocks = signal.night_blocks(frame(spark, np.where(t < 3 * 3600, np.sin(t / 2), 0.0), 1.0, datetime(2026, 9, 17, 22)), ["session_id"], "v").orderBy("start").collect()
    assert [r.active for r in blocks] == [True, True, True, False]
    assert signal.night_blocks(frame(spark, range(100), 1.0, datetime(2026, 9, 17, 10)), ["session_id"], "v").count() == 0


def test_breaths_and_rate(spark):
    rng = np.random.default_rng(2)
    t = np.arange(7500) * 0.04
    df = frame(spark, 5 + np.sin(2 * math.pi * 15 / 60 * t) + 0.02 * rng.normal(size=7500)).selectExpr("*", "true AS valid")
    rate = breaths.respiratory_rate(df, ["session_id"], "v", 0.04).collect()
    assert len(rate) == 1 and rate[0].is_valid and abs(rate[0].rr_bpm - 15) < 1
    found = breaths.volumes(df, ["session_id"], "v", 0.04)
    assert found.count() >= 60
    stats = breaths.session_stats(df, breaths.respiratory_rate(df, ["session_id"], "v", 0.04), found, ["session_id"], "v", 0.04).first()
    assert stats.n_valid == 7500 and abs(stats.night_usage_pct - 100) < 0.1
    hist = breaths.volume_histogram(found, ["session_id"]).first()
    assert sum(hist.counts) == stats.n_breaths and len(hist.edges) == len(hist.counts) + 1


def _night(spark, seconds, dips, depth=0.1, quiet=()):
    t = np.arange(seconds * 25) * 0.04
    amp = np.ones(len(t))
    for a, b in dips:
        amp[(t >= a) & (t < b)] = depth
    for a, b in quiet:
        amp[(t >= a) & (t < b)] = 0.0
    return frame(spark, amp * np.sin(2 * math.pi * t) + 5)


def _events(spark, df):
    rows = df.selectExpr("*", "true AS valid", "false AS in_qc")
    return events.flow_limitations(events.envelope(rows, ["session_id"], "v"), rows, ["session_id"])


def test_apneas_hypopneas_and_short_dips(spark):
    got = _events(spark, _night(spark, 300, [(60, 75), (120, 135), (210, 225)])).collect()
    assert [r.event_type for r in got] == ["apnea"] * 3
    assert all(abs(r.reduction - 0.9) < 0.03 and 10 <= r.duration_s <= 20 and r.confidence == "high" for r in got)
    mild = _events(spark, _night(spark, 300, [(100, 115)], 0.45)).collect()
    assert [r.event_type for r in mild] == ["hypopnea"] and abs(mild[0].reduction - 0.55) < 0.05
    assert _events(spark, _night(spark, 300, [(100, 104)])).count() == 0


def test_mask_removal_excludes_events(spark):
    env = events.envelope(_night(spark, 780, [], quiet=[(300, 480)]), ["session_id"], "v")
    off = events.mask_removals(env, ["session_id"]).collect()
    assert len(off) == 1 and 170 <= off[0].end_sec - off[0].start_sec <= 190


def test_pipeline_runs_all_layers(spark):
    rng = np.random.default_rng(3)
    t = np.arange(300 * 25) * 0.04
    noisy = 5 + np.where((t >= 150) & (t < 165), 0.1, 1.0) * np.sin(2 * math.pi * t) + 0.01 * rng.normal(size=len(t))
    out = pipeline.run(frame(spark, noisy), ["session_id"], "v")
    report = out.report.first()
    assert report.n_events == 1 and report.estimated_ahi > 0 and out.quality.first().total_samples == 7500
    with pytest.raises(ValueError):
        pipeline.run(frame(spark, [1.0]), ["session_id"], "v", steps=("nothing",))


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text("timestamp, IPAP (0.5 cmH2O), resA\n2026-07-21T22:00:01, 65535, 3\nbad, 1, 2\n2026-07-21T22:00:00, 20, 4\n")
    got = tables.read_recording(spark, str(tmp_path / "in.csv")).orderBy("timestamp", "seq").collect()
    assert [(r["IPAP (0.5 cmH2O)"], r.resA) for r in got] == [(20.0, 4.0), (None, 3.0)]
    assert tables.unit_findings(["IPAP (0.5 cmH2O)", "tidal_vol (L/min)", "resA"]) == [("tidal_vol (L/min)", "uncertain"), ("resA", "unknown")]
