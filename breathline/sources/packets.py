"""Binary recordings: 256-byte packets of 106 words, one packet a second.

Layout (fixed values): little-endian unsigned words at bytes 0-211; at 248 the year as a
word, then month, day, hour, minute and second as bytes.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKET, WORDS, DATE_AT = 256, 106, 248
KNOWN = {"usage_day": 1, "IPAP": 2, "EPAP": 3, "tidal_vol": 99, "spO2_pct": 102, "HR_BPM": 103, "rep_rate": 104}
WAVES = {"resA": (4, 25), "resB": (29, 25), "resC": (54, 25), "pulse": (79, 10)}
MISSING = 65535
#: Packets per Arrow batch.
BATCH = 8192
SCHEMA = "path string, packet long, year int, month int, day int, hour int, minute int, second int, words array<int>"


def _decode(path: str, content: bytes, keep_last: bool) -> Iterator[pa.RecordBatch]:
    whole = len(content) // PACKET
    count = whole if keep_last else max(0, -(-(len(content) - PACKET) // PACKET))
    for first in range(0, count, BATCH):
        n = min(BATCH, count - first)
        raw = np.frombuffer(content, np.uint8, n * PACKET, first * PACKET).reshape(n, PACKET)
        words = np.ascontiguousarray(raw[:, : 2 * WORDS]).view("<u2").astype(np.int32)
        date = raw[:, DATE_AT : DATE_AT + 7].astype(np.int32)
        parts = [date[:, 0] + 256 * date[:, 1], *(date[:, i] for i in range(2, 7))]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * WORDS), pa.array(words.ravel()))
        columns = [pa.array([path] * n), pa.array(np.arange(first, first + n)), *(pa.array(np.ascontiguousarray(p)) for p in parts), lists]
        yield pa.RecordBatch.from_arrays(columns, ["path", "packet", "year", "month", "day", "hour", "minute", "second", "words"])


def read_packets(spark: SparkSession, folder: str, keep_last: bool = False, paths: list[str] | None = None) -> DataFrame:
    """(path, packet, ts, words) of all files ``*.NNN`` in a folder; file order is (path, packet).

    A packet with an impossible date has a null ``ts``. As in the recorder's own tools,
    the last full packet of a file is dropped unless ``keep_last``; a partial one always is.
    Only the files ``paths`` are read if they are given.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield from _decode(path, content, keep_last)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[0-9][0-9][0-9]").load(paths or folder).select("path", "content")
    ts = F.expr("try_make_timestamp_ntz(year, month, day, hour, minute, second)")
    return files.mapInArrow(run, SCHEMA).select("path", "packet", ts.alias("ts"), "words")


def between(packets: DataFrame, first: datetime.date, last: datetime.date | None = None) -> DataFrame:
    """Packets of the days from first to last, both included; one day if last is not given."""
    return packets.filter(F.to_date("ts").between(F.lit(first), F.lit(last or first)))


def date_bounds(packets: DataFrame) -> DataFrame:
    """First and last valid date of each file, with the number of packets without one."""
    return packets.groupBy("path").agg(F.to_date(F.min("ts")).alias("first_date"), F.to_date(F.max("ts")).alias("last_date"), F.count_if(F.col("ts").isNull()).alias("n_rejected"))


def known_values(packets: DataFrame) -> DataFrame:
    """One row per second with the named words; the missing mark is null."""
    named = [F.nullif(F.col("words")[i], F.lit(MISSING)).alias(name) for name, i in KNOWN.items()]
    return packets.filter("ts is not null").select("path", "packet", "ts", *named)


def all_values(packets: DataFrame) -> DataFrame:
    """One row per second with all words, the unnamed as ``word_NNN``."""
    names = {i: n for n, i in KNOWN.items()}
    return packets.filter("ts is not null").select("path", "packet", "ts", *[F.nullif(F.col("words")[i], F.lit(MISSING)).alias(names.get(i, f"word_{i:03d}")) for i in range(WORDS)])


def waveforms(packets: DataFrame, rate: int = 25) -> DataFrame:
    """One row per sample: the 25 Hz channels, or the 10 Hz one; time and order within the second included."""
    if rate not in (10, 25):
        raise ValueError("rate must be 10 or 25")
    chosen = {name: start for name, (start, n) in WAVES.items() if n == rate}
    zipped = F.arrays_zip(*[F.slice("words", start + 1, rate).alias(name) for name, start in chosen.items()])
    rows = packets.filter("ts is not null").select("path", "packet", "ts", F.posexplode(zipped).alias("sub", "v"))
    ts = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("sub") * (1_000_000 // rate)).cast("timestamp_ntz")
    return rows.select("path", "packet", "sub", ts.alias("ts"), *[F.nullif(F.col(f"v.{name}"), F.lit(MISSING)).cast("double").alias(name) for name in chosen])


def day_tally(packets: DataFrame) -> DataFrame:
    """(path, run, date, hours, seconds): one row per run of packets of one date, in file order.

    ``hours`` has 24 marks: ``.`` none, ``+`` flow, ``O`` pulse since the last new hour. An
    hour counts at its first packet past the run's latest hour. Runs are those of a file:
    a date that goes on in the next file has a row in each.
    """
    from pyspark.sql import Window

    file = Window.partitionBy("path").orderBy("packet")
    rows = packets.filter("ts is not null").select("path", "packet", F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), (F.col("words")[KNOWN["spO2_pct"]] > 0).alias("pulse"))
    rows = rows.withColumn("__new", F.coalesce((F.col("date") != F.lag("date").over(file)).cast("int"), F.lit(1))).withColumn("run", F.sum("__new").over(file.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("path", "run").orderBy("packet")
    rows = rows.withColumn("__top", F.coalesce(F.max("hour").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).withColumn("__opens", F.col("hour") > F.col("__top"))
    before = F.coalesce(F.sum(F.col("__opens").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = rows.withColumn("__span", before).groupBy("path", "run", "date", "__span").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("__opens"), F.col("hour"))).alias("hour"), F.max("pulse").alias("pulse"))
    mark = F.when(F.col("pulse"), "O").otherwise("+")
    got = spans.groupBy("path", "run", "date").agg(F.sum("n").alias("seconds"), F.map_from_entries(F.collect_list(F.when(F.col("hour").isNotNull(), F.struct("hour", mark.alias("m"))))).alias("marks"))
    hours = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("marks", h), F.lit("."))), "")
    return got.select("path", "run", "date", hours.alias("hours"), "seconds")
