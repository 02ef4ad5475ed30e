"""The raw CSV export of packets: headers, row formats, date ranges and the day summary."""

from __future__ import annotations

import datetime
import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breathline.sources import packets
from breathline.sources.packets import KNOWN, WAVES, WORDS

#: Units of the stored words as the headers give them (fixed values).
UNITS = {"usage_day": "", "IPAP": "0.5 cmH2O", "EPAP": "0.5 cmH2O", "tidal_vol": "L/min", "spO2_pct": "%", "HR_BPM": "bpm", "rep_rate": "breaths/min"}
#: The names of the date's parts; the last one is a byte without a known meaning.
DATE_PARTS = ("year", "month", "day", "hour", "minute", "second", "?")
#: Days from the first day of year 1 to 1970-01-01, as ordinals count them.
EPOCH_ORDINAL = datetime.date(1970, 1, 1).toordinal()
SEPARATOR = ", "


@dataclass(frozen=True)
class Mode:
    """What a row holds: its time column, its words, and how many rows a second has."""

    time: str = "iso"  # iso, ymd or seconds; "both" has the header of ymd and the rows of seconds
    all_words: bool = False
    rate: int = 1  # 1, 10 or 25


def _labels() -> dict[int, str]:
    waves = {start + i: f"{name}_{i}" for name, (start, n) in WAVES.items() for i in range(n)}
    return waves | {i: n for n, i in KNOWN.items()}


def header(mode: Mode) -> list[str]:
    """Column names; known words carry their unit, unknown ones are ``word_NNN``."""
    with_unit = lambda name: f"{name} ({UNITS[name]})" if UNITS.get(name) else name
    times = {"iso": ["timestamp"], "seconds": ["time_seconds"]}.get(mode.time, list(DATE_PARTS))
    labels = _labels()
    words = [with_unit(labels[i]) if i in labels else f"word_{i:03d}" for i in range(WORDS)] if mode.all_words else [with_unit(n) for n in KNOWN]
    waves = {1: [], 10: ["pulse"], 25: ["resA", "resB", "resC"]}[mode.rate]
    return [*times, *words, *(["time_frac"] if mode.rate > 1 and mode.time != "iso" else []), *waves]


def time_seconds(ts: str | Column) -> Column:
    """Seconds of a time counted from the day before year 1."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    day = F.datediff(ts, F.lit(datetime.date(1970, 1, 1))) + EPOCH_ORDINAL
    return day.cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def iso_text(ts: str | Column, digits: int = 0) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss" + (".SSS" if digits else ""))


def hours_minutes(seconds: str | Column) -> Column:
    """``HH:MM`` of a number of seconds, both cut."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.format_string("%02d:%02d", F.floor(s / 3600).cast("int"), F.floor((s % 3600) / 60).cast("int"))


def lines(rows: DataFrame, mode: Mode) -> DataFrame:
    """(path, packet, sub, line): one text line per row of ``rows`` (packets with words), values as stored."""
    known = [F.col("words")[i] for i in KNOWN.values()]
    words = F.array_join(F.col("words") if mode.all_words else F.array(*known), SEPARATOR)
    rows = rows.filter("ts is not null").select("path", "packet", "ts", "words", words.alias("data"), F.explode(F.sequence(F.lit(0), F.lit(mode.rate - 1))).alias("sub"))
    shifted = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("sub") * (1_000_000 // mode.rate)).cast("timestamp_ntz")
    # The seventh part of a date is stored as zero by every recorder seen so far.
    ymd = F.concat_ws(SEPARATOR, *[f(F.col("ts")).cast("string") for f in (F.year, F.month, F.dayofmonth, F.hour, F.minute, F.second)], F.lit("0"))
    time = {"iso": iso_text(shifted if mode.rate > 1 else F.col("ts"), 3 if mode.rate > 1 else 0), "ymd": ymd}.get(mode.time, time_seconds("ts").cast("string"))
    frac = F.format_string("%.2f", time_seconds("ts").cast("double") + F.col("sub") / mode.rate)
    chosen = {1: [], 10: ["pulse"], 25: ["resA", "resB", "resC"]}[mode.rate]
    waves = [F.element_at("words", F.col("sub") + WAVES[name][0] + 1).cast("string") for name in chosen]
    parts = [time, F.col("data"), *([frac] if mode.rate > 1 and mode.time != "iso" else []), *waves]
    return rows.select("path", "packet", "sub", F.concat_ws(SEPARATOR, *parts).alias("line"))


def parse_dates(texts: list[str]) -> tuple[datetime.date, datetime.date] | None:
    """First and last day, both included; one date is that day. ValueError for more than two or a bad date."""
    if len(texts) > 2:
        raise ValueError(f"1 or 2 dates are wanted, not {len(texts)}")
    try:
        days = [datetime.datetime.strptime(t, "%Y-%m-%d").date() for t in texts]
    except ValueError as bad:
        raise ValueError(f"a date must be YYYY-MM-DD: {bad}") from None
    return (days[0], days[-1]) if days else None


def files_between(bounds: DataFrame, first: datetime.date, last: datetime.date) -> list[str]:
    """Paths of the files with a day in the range; ``bounds`` is ``packets.date_bounds``."""
    hit = bounds.filter((F.col("first_date") <= F.lit(last)) & (F.col("last_date") >= F.lit(first)))
    return [r.path for r in hit.select("path").orderBy("path").collect()]  # one row per file


def recorded(spark: SparkSession, folder: str, days: tuple[datetime.date, datetime.date] | None = None) -> DataFrame:
    """Packets of a folder's files, only of files with a day in the range; FileNotFoundError without a file ``*.NNN``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[0-9][0-9][0-9]").load(folder).select("path")
    if not found.limit(1).count():
        raise FileNotFoundError(f"no recording (*.NNN) in {folder}")
    rows = packets.read_packets(spark, folder)
    if not days:
        return rows
    wanted = files_between(packets.date_bounds(rows.drop("words")), *days)
    return packets.between(packets.read_packets(spark, folder, paths=wanted), *days) if wanted else packets.between(rows.limit(0), *days)


def write_lines(rows: DataFrame, mode: Mode, output: str) -> int:
    """One text file: the header, then the lines in the order of file, packet and sample; the number of lines.

    The parts are written in order by the executors and put together one at a time.
    """
    folder = tempfile.mkdtemp(prefix="export-", dir=str(Path(output).resolve().parent))
    try:
        lines(rows, mode).orderBy("path", "packet", "sub").select("line").write.mode("overwrite").text(f"file://{folder}/parts")
        count = 0
        with open(output, "w", encoding="utf-8") as out:
            out.write(SEPARATOR.join(header(mode)) + "\n")
            for part in sorted(Path(folder, "parts").glob("part-*")):
                with part.open(encoding="utf-8") as text:
                    for line in text:
                        out.write(line)
                        count += 1
        return count
    finally:
        shutil.rmtree(folder)


def info(rows: DataFrame) -> Iterator[str]:
    """A line per run of one date: the date, the hours' marks and the time recorded."""
    days = packets.day_tally(rows).select("path", "run", "date", "hours", hours_minutes("seconds").alias("time"))
    for row in days.orderBy("path", "run").toLocalIterator():
        yield f"{row.date} {row.hours} {row.time}"
