"""Spark-native analytics of therapy signals. The public names are loaded on first use."""

from __future__ import annotations

import importlib

_NAMES = {
    "breathline.sources.nights": ["all_session_ids", "load_session", "read_segmented_csv", "last_sessions"],
    "breathline.sources.reports": ["load_quality_or_error", "read_reports", "report_path", "write_reports", "require_reports"],
    "breathline.sources.tables": ["read_recording", "clean", "unit_findings"],
    "breathline.sources.packets": ["read_packets", "day_tally"],
    "breathline.operators.sessions": ["sessionize"],
    "breathline.operators.grid": ["resample", "valid_samples"],
    "breathline.operators.signal": ["artifacts", "artifact_intervals", "quality_report", "night_blocks"],
    "breathline.operators.breaths": ["respiratory_rate", "session_stats", "volume_distribution"],
    "breathline.operators.events": ["ahi", "events_report", "flow_limitations", "mask_removals", "timeline"],
    "breathline.plans.figures": ["decimate", "density", "night_events", "overlapped_sessions", "pressure_curve", "signal_quality", "tidal_volume_distribution", "waveform"],
    "breathline.plans.pipeline": ["Analysis", "run", "trend"],
    "breathline.session": ["get_session"],
}
_WHERE = {name: module for module, names in _NAMES.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(importlib.import_module(_WHERE[name]), name)
