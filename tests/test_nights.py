"""Sessions, reports, exports, figures and the command line on small recordings with known results."""

import json
import math
import struct
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from breathline import cli
from breathline.operators import breaths, signal
from breathline.plans import figures
from breathline.sources import exports, nights, packets, reports, tables

START = datetime(2026, 7, 21, 22, 0)


@pytest.fixture(scope="module")
def recording(tmp_path_factory):
    """Two sessions of five minutes at 25 Hz, the second a day later; one apnea each."""
    path = tmp_path_factory.mktemp("rec") / "rec.csv"
    rng = np.random.default_rng(1)
    t = np.arange(300 * 25) * 0.04
    with open(path, "w") as out:
        out.write("timestamp, IPAP (0.5 cmH2O), EPAP (0.5 cmH2O), tidal_vol (L/min), resA\n")
        for day in range(2):
            flow = 500 + 100 * np.where((t >= 150) & (t < 165), 0.1, 1.0) * np.sin(2 * math.pi * t * 0.5) + rng.normal(size=len(t))
            for i, v in enumerate(flow):
                at = START + timedelta(days=day, milliseconds=40 * i)
                out.write(f"{at.isoformat(timespec='milliseconds')}, {20 + day}, 10, {i % 7}, {v:.2f}\n")
        out.write("bad, 1, 1, 1, 1\n")
    return str(path)


def test_sessions(spark, recording, tmp_path):
    assert nights.all_session_ids(spark, recording) == [1, 2]
    night = nights.load_session(spark, recording, 2)
    assert night.samples.count() == 7500 and night.sample_rate_hz == pytest.approx(25)
    with pytest.raises(ValueError, match="there are: \\[1, 2\\]"):
        nights.load_session(spark, recording, 9)
    with pytest.raises(ValueError, match="pulse"):
        nights.load_session(spark, recording, 1, "pulse")
    assert tables.count_rejected(spark, recording) == 1
    bad = tmp_path / "bad.csv"
    bad.write_text("timestamp,session_id,resA\n2026-07-21T22:00:01,1,2\n2026-07-21T22:00:00,1,2\n")
    with pytest.raises(ValueError, match="order"):
        nights.read_segmented_csv(spark, str(bad))
    with pytest.raises(ValueError, match="session_id"):
        nights.read_segmented_csv(spark, recording)


def test_reports_come_back(spark, tmp_path):
    quality = spark.createDataFrame([(3, START, 10, 8, 80.0, 1, 1, 0, 0)], "session_id long, start timestamp_ntz, total_samples long, valid_samples long, valid_pct double, n_spike long, n_flatline long, n_clipping long, n_drift long")
    spans = spark.createDataFrame([(3, START + timedelta(seconds=s), START + timedelta(seconds=s), k) for s, k in ((5, "flatline"), (1, "clipping"), (5, "spike"))], "session_id long, start timestamp_ntz, end timestamp_ntz, kind string")
    said = spark.createDataFrame([(3, "a gap")], "session_id long, finding string")
    [path] = reports.write_reports(reports.reports(quality, spans, said, "resA", 25.0, {"drift_window_s": 300.0}), str(tmp_path))
    assert path.endswith("qc_session_3_2026-07-21.json")
    assert [i["kind"] for i in json.loads(open(path).read())["intervals"]] == ["clipping", "spike", "flatline"]
    row = reports.load_quality_or_error(spark, path).first()
    assert (row.session_id, row.channel, row.sample_rate_hz, row.valid_pct, row.warnings, row.params) == (3, "resA", 25.0, 80.0, ["a gap"], {"drift_window_s": 300.0})
    assert row.counts_by_kind == {"spike": 1, "flatline": 1, "clipping": 0, "drift": 0} and row.spans[0].start == START + timedelta(seconds=1)
    (tmp_path / "thin.json").write_text('{\n "session_id": 1, "channel": "resA", "sample_rate_hz": 25\n}')
    thin = reports.read_reports(spark, str(tmp_path / "thin.json")).first()
    assert (thin.total_samples, thin.intervals, thin.warnings) == (0, [], [])
    (tmp_path / "poor.json").write_text('{"session_id": 1}')
    with pytest.raises(ValueError, match="channel, sample_rate_hz"):
        reports.read_reports(spark, str(tmp_path / "poor.json"))
    with pytest.raises(ValueError, match="quality preprocess"):
        reports.load_quality_or_error(spark, str(tmp_path / "none.json"))
    with pytest.raises(ValueError, match="\\[4\\]"):
        reports.require_reports(spark.createDataFrame([(3,), (4,)], "session_id long"), reports.read_reports(spark, path))


def _files(folder):
    for name, day in (("a.000", 21), ("b.001", 23)):
        rows = [struct.pack("<106H", *([0, 5, 20] + [i for i in range(103)])) + bytes(36) + struct.pack("<HBBBBBB", 2026, 7, day, 22, 0, s, 0) for s in range(3)]
        (folder / name).write_bytes(b"".join(rows))


def test_raw_export(spark, tmp_path):
    _files(tmp_path)
    rows = exports.recorded(spark, str(tmp_path))
    assert rows.count() == 4
    assert exports.recorded(spark, str(tmp_path), exports.parse_dates(["2026-07-23"])).select("path").distinct().count() == 1
    assert exports.header(exports.Mode())[:3] == ["timestamp", "usage_day", "IPAP (0.5 cmH2O)"]
    assert len(exports.header(exports.Mode("seconds", True, 25))) == 1 + 106 + 1 + 3
    assert exports.write_lines(rows, exports.Mode(), str(tmp_path / "out.csv")) == 4
    lines = (tmp_path / "out.csv").read_text().splitlines()
    assert lines[1].split(", ")[:3] == ["2026-07-21T22:00:00", "5", "20"] and len(lines[0].split(", ")) == len(lines[1].split(", "))
    assert exports.write_lines(rows, exports.Mode("ymd", False, 25), str(tmp_path / "out.csv")) == 100
    lines = (tmp_path / "out.csv").read_text().splitlines()
    assert lines[2].startswith("2026, 7, 21, 22, 0, 0, 0, 5, 20") and lines[2].endswith(".04, 2, 27, 52")
    assert list(exports.info(rows)) == [f"2026-07-{d} {'.' * 22}O. 00:00" for d in (21, 23)]
    for bad in (["2026-07-21"] * 3, ["21.7.2026"]):
        with pytest.raises(ValueError):
            exports.parse_dates(bad)
    assert exports.parse_dates(["2026-07-21", "2026-07-22"]) == (date(2026, 7, 21), date(2026, 7, 22))
    assert packets.date_bounds(rows).count() == 2


def test_figures(spark, recording):
    df = nights.read_sessions(spark, recording)
    assert figures.pressure_curve(df).agg(F.max("ipap")).first()[0] == 10.5
    with pytest.raises(ValueError):
        figures.pressure_curve(df.limit(1))
    over = figures.overlapped_sessions(df, 1)
    assert [r.session_id for r in over.select("session_id").distinct().collect()] == [2] and over.agg(F.min("hours_since_start")).first()[0] == 0
    assert figures.waveform(df, "resA", 500).filter("session_id = 1").count() == 500
    with pytest.raises(ValueError):
        figures.waveform(df, "resZ")
    curve = figures.tidal_volume_distribution(df, bins=7).orderBy("x").collect()
    assert sum(r.density for r in curve) * 6 / 7 == pytest.approx(1) and all(r.kde > 0 for r in curve)


def test_modes_at_the_borders():
    edges = np.arange(4.0)
    assert breaths._mode(edges, np.array([5, 2, 1]), 0) == 0.0 + 1.0  # the bin itself stands beyond the border
    assert breaths._mode(edges, np.array([1, 2, 5]), 2) == 2.0
    assert breaths.secondary_modes(np.array([9, 1, 4, 4])) == []
    assert breaths.secondary_modes(np.array([9, 1, 4, 3])) == [2]


def test_a_signal_without_values_is_refused(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "session_id long, v double")
    with pytest.raises(Exception, match="no value in the signal of 2"):
        signal.require_signal(df, ["session_id"], "v").collect()


def test_command_line(recording, spark, tmp_path, capsys):
    assert cli.main([]) == 2 and cli.main(["nothing"]) == 2 and cli.main(["parse"]) == 2 and cli.main(["preprocess"]) == 2
    assert cli.main(["parse", str(tmp_path), "-i"]) == 1
    _files(tmp_path)
    assert cli.main(["parse", str(tmp_path), "-i"]) == 0
    assert cli.main(["preprocess", recording]) == 0
    assert "1 rows without a time" in capsys.readouterr().out
    one = ["--input", recording, "--report-dir", str(tmp_path / "rep"), "--session", "1"]
    assert cli.main(["stats", "stats", *one]) == 2 and cli.main(["events", "events", *one]) == 2
    assert cli.main(["plot", recording, "--session", "9"]) == 1
    assert cli.main(["pipeline", "--input", recording, "--steps", "nothing"]) == 2 and cli.main(["pipeline", "--input", recording, "--steps", ","]) == 2
    assert cli.main(["pipeline", "--input", recording, "--report-dir", str(tmp_path / "rep")]) == 0
    assert "pipeline done: 2 session(s)" in capsys.readouterr().out
    names = sorted(p.name for p in (tmp_path / "rep").iterdir())
    assert names == ["events_session_1_2026-07-21.csv", "events_session_2_2026-07-22.csv", "events_summary.csv", "nightly_trend.csv", "qc_session_1_2026-07-21.json", "qc_session_2_2026-07-22.json"]
    assert cli.main(["events", "events", *one, "--json", str(tmp_path / "e.json")]) == 0
    payload = json.loads((tmp_path / "e.json").read_text())
    assert [e["event_type"] for e in payload["events"]] == ["apnea"] and payload["ahi"]["n_events"] == 1 and sum(payload["events_by_hour"].values()) == 1
    assert cli.main(["stats", "stats", *one, "--json", str(tmp_path / "s.json")]) == 0
    payload = json.loads((tmp_path / "s.json").read_text())
    assert payload["session"]["n_breaths"] > 0 and payload["respiratory_rate"]
