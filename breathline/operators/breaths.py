"""Breath volumes, their distribution, and respiratory rate by blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breathline.operators.frames import median, null_safe_join
from breathline.operators.grid import micros
from breathline.operators.signal import distribution

BASELINE_S, PEAK_FACTOR = 45.0, 12.0
BREATH_S = (0.25, 8.0)
LAG_S, MIN_CORRELATION = (2.0, 10.0), 0.2
MIN_BLOCK_VALID = 0.5
VALLEY, MIN_PEAK_SHARE = 0.7, 0.15


def baseline(df: DataFrame, keys: list[str], value: str, period_s: float, seconds: float = BASELINE_S, ts: str = "ts", tie: str = "seq") -> DataFrame:
    """Add ``base``: the centred rolling median, or the value itself where too few samples are there.

    A window of a thousand rows sorts slowly as a window aggregate, so pandas
    computes it, one key (a night's session, bounded by its length) at a time.
    """
    width = max(7, round(seconds / period_s))
    schema = df.withColumn("base", F.lit(0.0)).schema

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([ts, tie], kind="stable")
        rolled = part[value].rolling(width, center=True, min_periods=width // 3).median()
        return part.assign(base=rolled.fillna(part[value]))

    return df.groupBy(*keys).applyInPandas(run, schema)


def volumes(df: DataFrame, keys: list[str], value: str, period_s: float, seconds: float = BASELINE_S, floor: float | None = None, ts: str = "ts", tie: str = "seq") -> DataFrame:
    """(keys, start, duration_s, volume) of each excursion above the baseline of plausible length and height.

    ``df`` has a boolean ``valid``. Without ``floor`` the peak must exceed twelve times
    the median positive step between successive valid samples.
    """
    order = Window.partitionBy(*keys).orderBy(ts, tie)
    step = F.abs(F.col(value) - F.lag(value).over(order))
    noise = df.filter("valid").withColumn("__d", step).groupBy(*keys).agg(F.coalesce(PEAK_FACTOR * median(F.when(F.col("__d") > 0, F.col("__d"))), F.lit(0.0)).alias("__floor"))
    rows = baseline(df.select(*keys, ts, tie, value, "valid"), keys, value, period_s, seconds, ts, tie)
    rows = rows.withColumn("__f", F.col(value) - F.col("base")).withColumn("__up", F.coalesce(F.col("__f") > 0, F.lit(False)) & F.col("valid"))
    run = F.row_number().over(order) - F.sum(F.col("__up").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("__run", run).filter("__up").groupBy(*keys, "__run").agg(F.min(ts).alias("start"), F.count(F.lit(1)).alias("n"), F.max("__f").alias("peak"), F.sum("__f").alias("sum"))
    found = runs.join(noise, keys, "left").withColumn("duration_s", F.col("n") * period_s)
    least = F.lit(floor) if floor is not None else F.coalesce("__floor", F.lit(0.0))
    return found.filter(F.col("duration_s").between(*BREATH_S) & (F.col("peak") > least)).select(*keys, "start", "duration_s", (F.col("sum") * period_s).alias("volume"))


def bin_edges(x: np.ndarray) -> np.ndarray:
    """Freedman-Diaconis bins, no wider than those of the square-root rule."""
    lo, hi = float(x.min()), float(x.max())
    if hi <= lo:
        return np.array([lo, lo + 1.0])
    widest = (hi - lo) / max(2, round(math.sqrt(len(x))))
    iqr = float(np.subtract(*np.percentile(x, [75, 25])))
    width = min(2 * iqr * len(x) ** (-1 / 3), widest) if iqr > 0 else widest
    edges = np.arange(lo, hi + width, width)
    return edges if edges[-1] >= hi else np.append(edges, hi)


def _mode(edges: np.ndarray, counts: np.ndarray, i: int) -> float:
    """The edge away from the taller neighbour; the centre between equal ones. Beyond a border stands the bin itself."""
    left, right = (int(counts[min(max(j, 0), len(counts) - 1)]) for j in (i - 1, i + 1))
    return float(edges[i + 1] if left > right else edges[i] if left < right else (edges[i] + edges[i + 1]) / 2)


def secondary_modes(counts: np.ndarray) -> list[int]:
    """Local maxima of at least 15 % of the main one, parted from it by a valley; tallest first.

    Inside, the start of a plateau may rise or stay level from the left; a border bin must be higher than its one neighbour.
    """
    main = int(np.argmax(counts))
    step = np.diff(counts)
    rises = np.concatenate([[True], step >= 0])
    rises[-1:] &= len(step) > 0 and step[-1] > 0
    falls = np.concatenate([step < 0, [True]])
    out = []
    for i in np.flatnonzero(rises & falls):
        between = counts[min(i, main) : max(i, main) + 1]
        if i != main and counts[i] >= MIN_PEAK_SHARE * counts[main] and between.min() < VALLEY * min(counts[i], counts[main]):
            out.append(int(i))
    return sorted(out, key=lambda i: -counts[i])


def volume_histogram(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, edges, counts, mode, secondary) of the volumes of each key; keys without breaths have no row."""
    key_fields = [found.schema[k] for k in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_fields) + ", edges array<double>, counts array<bigint>, mode double, secondary array<double>"

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = part["volume"].to_numpy()
        edges = bin_edges(x)
        counts = np.histogram(x, edges)[0]
        row = [*key, edges.tolist(), counts.tolist(), _mode(edges, counts, int(np.argmax(counts))), [_mode(edges, counts, i) for i in secondary_modes(counts)]]
        return pd.DataFrame([row], columns=[*keys, "edges", "counts", "mode", "secondary"])

    return found.groupBy(*keys).applyInPandas(run, schema)


def rate_of(x: np.ndarray, period_s: float) -> float | None:
    """Breaths a minute from the first high local maximum of the autocorrelation between 2 and 10 s."""
    if len(x) < math.ceil(4.0 * sum(LAG_S) / period_s):
        return None
    spectrum = np.fft.rfft(x - np.median(x), 2 * len(x))
    ac = np.fft.irfft(np.abs(spectrum) ** 2)[: len(x)]
    if not np.isfinite(ac[0]) or ac[0] <= 0:
        return None
    ac = ac / ac[0]
    lo, hi = np.searchsorted(np.arange(len(x)) * period_s, LAG_S)
    inner = ac[lo + 1 : hi - 1]
    peaks = np.flatnonzero((inner > ac[lo : hi - 2]) & (inner >= ac[lo + 2 : hi]) & (inner >= MIN_CORRELATION)) if hi > lo + 2 else []
    return 60.0 / float((lo + 1 + peaks[0]) * period_s) if len(peaks) else None


def respiratory_rate(df: DataFrame, keys: list[str], value: str, period_s: float, block_minutes: float = 5, ts: str = "ts", tie: str = "seq") -> DataFrame:
    """(keys, block, block_start, block_end, rr_bpm, is_valid, valid_frac) of blocks aligned to each key's first sample.

    ``df`` has a boolean ``valid``; blocks with less than half of their samples valid
    have no rate. Empty blocks have no row.
    """
    start = F.min(micros(ts)).over(Window.partitionBy(*keys))
    rows = df.select(*keys, ts, tie, value, "valid").withColumn("block", F.floor((micros(ts) - start) / (block_minutes * 60e6)).cast("long"))
    key_fields = [rows.schema[k] for k in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_fields) + ", block bigint, block_start timestamp_ntz, block_end timestamp_ntz, rr_bpm double, is_valid boolean, valid_frac double"

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([ts, tie], kind="stable")
        ok = part["valid"].to_numpy(dtype=bool)
        rate = rate_of(part[value].to_numpy()[ok], period_s) if ok.mean() >= MIN_BLOCK_VALID else None
        row = [*key, part[ts].iloc[0], part[ts].iloc[-1], rate, rate is not None, round(float(ok.mean()), 6)]
        return pd.DataFrame([row], columns=[*keys, "block", "block_start", "block_end", "rr_bpm", "is_valid", "valid_frac"])

    return rows.groupBy(*keys, "block").applyInPandas(run, schema)


def session_stats(df: DataFrame, rates: DataFrame, found: DataFrame, keys: list[str], value: str, period_s: float, ts: str = "ts") -> DataFrame:
    """Per key: use, share of the night, percentiles of the valid samples, rate and 90th percentile of the volumes."""
    kept = F.when(F.col("valid"), F.col(value))
    q = F.percentile(kept, F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    got = df.groupBy(*keys).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count_if("valid").alias("n_valid"), F.count(F.lit(1)).alias("n"), q.alias("q"), F.avg(kept).alias("flow_mean"))
    span = (micros("end") - micros("start")) / 1e6
    got = got.withColumn("total_duration_s", span).withColumn("usage_duration_s", F.col("n_valid") * period_s)
    got = got.withColumn("night_usage_pct", F.when(span > 0, 100 * F.col("usage_duration_s") / span).otherwise(0.0)).withColumn("signal_valid_pct", 100 * F.col("n_valid") / F.col("n"))
    got = got.select("*", *[F.col("q")[i].alias(f"flow_{name}") for i, name in enumerate(("p05", "p25", "median", "p75", "p95"))]).drop("q")
    bpm = F.when(F.col("is_valid"), F.col("rr_bpm"))
    by_rate = rates.groupBy(*keys).agg(F.avg(bpm).alias("rr_mean"), median(bpm).alias("rr_median"), (F.percentile(bpm, F.lit(0.75)) - F.percentile(bpm, F.lit(0.25))).alias("rr_iqr"), F.count_if("is_valid").alias("n_blocks_valid"), F.count(F.lit(1)).alias("n_blocks"))
    by_volume = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_breaths"), F.percentile("volume", F.lit(0.9)).alias("volume_p90"))
    modes = volume_histogram(found, keys).select(*keys, F.col("mode").alias("tidal_mode"))
    for part in (by_rate, by_volume, modes):
        got = null_safe_join(got, part, keys, "left")
    got = got.fillna(0, ["n_breaths", "n_blocks_valid", "n_blocks"]).withColumn("flow_iqr", F.col("flow_p75") - F.col("flow_p25"))
    got = got.withColumn("rr_coverage_pct", F.when(F.col("n_blocks") > 0, 100 * F.col("n_blocks_valid") / F.col("n_blocks")).otherwise(0.0))
    said = [(F.col("n_valid") == 0, "no valid sample"), (F.col("n_breaths") == 0, "no breath found"), (F.col("n_blocks_valid") == 0, "no block with a respiratory rate")]
    return got.withColumn("warnings", F.filter(F.array(*[F.when(c, F.lit(text)) for c, text in said]), lambda x: x.isNotNull()))


def volume_distribution(found: DataFrame, keys: list[str]) -> DataFrame:
    """The histogram of the volumes with bias-corrected skewness, Sarle's coefficient and ``bimodal``: above 5/9 with a second mode."""
    shape = distribution(found, keys, "volume").select(*keys, "n", "skew", "bimodality")
    out = null_safe_join(volume_histogram(found, keys), shape, keys)
    return out.withColumn("bimodal", F.coalesce(F.col("bimodality") > 5 / 9, F.lit(False)) & (F.size("secondary") > 0))
