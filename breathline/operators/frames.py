"""Shared window primitives: centred frames, rolling aggregates with a least count, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def centred(keys: list[str], order: list[str], width: int) -> WindowSpec:
    """A centred row frame; an even width has one row more before than after."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(width // 2), (width - 1) // 2)


def rolling(value: Column, agg, frame: WindowSpec, least: int = 1) -> Column:
    """``agg`` over the frame, null where the frame has fewer than ``least`` values."""
    return F.when(F.count(value).over(frame) >= least, agg(value).over(frame))


def median(value: Column) -> Column:
    return F.percentile(value, F.lit(0.5))


def islands(df: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """Runs of consecutive rows whose boolean ``flag`` is true: keys, start, end, n (order[0] gives the ends)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__run", F.row_number().over(w) - F.sum(F.col(flag).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter(flag).groupBy(*keys, "__run").agg(F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.count(F.lit(1)).alias("n")).drop("__run")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi join on ``keys`` in which null equals null, with the keys and columns of ``left`` kept."""
    other = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [left[k].eqNullSafe(other[f"__r_{k}"]) for k in keys]
    return left.join(other, same, how).drop(*[f"__r_{k}" for k in keys])
