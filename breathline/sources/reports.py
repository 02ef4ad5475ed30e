"""Quality reports: one JSON document per session, written and read back."""

from __future__ import annotations

import datetime
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breathline.operators.signal import KINDS

#: The fields of a report; the first three are required, the others have the defaults of ``_DEFAULTS``.
SCHEMA = (
    "session_id long, channel string, sample_rate_hz double, total_samples long, valid_samples long, valid_pct double, "
    "counts_by_kind map<string,long>, warnings array<string>, params map<string,double>, intervals array<struct<start:string,end:string,kind:string>>"
)
REQUIRED = ("session_id", "channel", "sample_rate_hz")
_DEFAULTS = {"total_samples": "0L", "valid_samples": "0L", "valid_pct": "0D", "counts_by_kind": "map()", "warnings": "array()", "params": "map()", "intervals": "array()"}


def iso(ts: Column) -> Column:
    """ISO text, with microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(F.concat(whole, F.date_format(ts, ".SSSSSS")))


def reports(quality: DataFrame, intervals: DataFrame, findings: DataFrame, channel: str, rate_hz: float, params: dict[str, float]) -> DataFrame:
    """One row per session in SCHEMA, with ``start`` kept for the file's name.

    ``quality`` has session_id, start, the totals and n_<kind>; intervals come by start,
    equal starts in the order of the kinds; ``findings`` (session_id, finding) become warnings.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    shown = F.struct(F.col("start").alias("at"), rank.alias("rank"), F.struct(iso(F.col("start")).alias("start"), iso(F.col("end")).alias("end"), "kind").alias("iv"))
    listed = intervals.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["iv"]).alias("intervals"))
    said = findings.groupBy("session_id").agg(F.array_sort(F.collect_list("finding")).alias("warnings"))
    counts = F.map_from_arrays(F.array(*[F.lit(k) for k in KINDS]), F.array(*[F.col(f"n_{k}").cast("long") for k in KINDS]))
    rows = quality.withColumn("counts_by_kind", counts).join(listed, "session_id", "left").join(said, "session_id", "left")
    given = F.map_from_arrays(F.array(*[F.lit(k) for k in params]).cast("array<string>"), F.array(*[F.lit(v) for v in params.values()]).cast("array<double>"))
    rows = rows.withColumns({"channel": F.lit(channel), "sample_rate_hz": F.lit(float(rate_hz)), "params": given})
    return rows.select("start", *[F.coalesce(c, F.expr(f"cast({_DEFAULTS[c]} as {kind})")).alias(c) if c in _DEFAULTS else F.col(c) for c, kind in _fields()])


def _fields() -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(SCHEMA)]


def report_path(folder: str, session_id: int, start: datetime.datetime, kind: str = "qc", suffix: str = "json") -> str:
    return str(Path(folder) / f"{kind}_session_{session_id}_{start:%Y-%m-%d}.{suffix}")


def write_reports(rows: DataFrame, folder: str) -> list[str]:
    """One indented JSON file per session, replaced if it is there; the paths in the order of the sessions."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    paths = []
    for row in rows.orderBy("session_id").toLocalIterator():  # one report at a time
        paths.append(report_path(folder, row.session_id, row.start))
        data = {k: v for k, v in row.asDict(recursive=True).items() if k != "start"}
        Path(paths[-1]).write_text(json.dumps(data, indent=2, ensure_ascii=False), encoding="utf-8")
    return paths


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports in SCHEMA from indented or one-line JSON; what is absent gets its default.

    ValueError names the required fields that a report lacks. ``interval`` times are
    read back as timestamps in ``spans``.
    """
    found = spark.read.schema(SCHEMA).json(path, multiLine=True)
    lacks = F.concat_ws(", ", *[F.when(F.col(c).isNull(), c) for c in REQUIRED])
    if bad := found.select(lacks.alias("x")).filter("x <> ''").limit(1).collect():
        raise ValueError(f"report at {path} lacks required fields: {bad[0].x}")
    full = found.select(*[F.coalesce(c, F.expr(f"cast({_DEFAULTS[c]} as {kind})")).alias(c) if c in _DEFAULTS else F.col(c) for c, kind in _fields()])
    spans = F.transform("intervals", lambda x: F.struct(x["start"].cast("timestamp_ntz").alias("start"), x["end"].cast("timestamp_ntz").alias("end"), x["kind"].alias("kind")))
    return full.withColumn("spans", spans)


def load_quality_or_error(spark: SparkSession, path: str) -> DataFrame:
    """The report at ``path``; ValueError that names the step to run first where there is none."""
    if not Path(path).exists():
        raise ValueError(f"no quality report at {path}: run 'quality preprocess' for this session first")
    return read_reports(spark, path)


def interval_rows(found: DataFrame) -> DataFrame:
    """(session_id, start, end, kind) of the intervals of reports."""
    return found.select("session_id", F.explode("spans").alias("s")).select("session_id", "s.*")


def require_reports(sessions: DataFrame, found: DataFrame) -> DataFrame:
    """``sessions`` joined to their reports; ValueError names the sessions without one."""
    missing = [r.session_id for r in sessions.select("session_id").distinct().join(found, "session_id", "left_anti").orderBy("session_id").limit(50).collect()]
    if missing:
        raise ValueError(f"no quality report for sessions {missing}: run 'quality preprocess' first")
    return sessions.join(found, "session_id")
