"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A lookup table is broadcast whole up to so many rows (of ids, hashes and counts: at most some 60 MB).
BROADCAST_ROWS = 400_000
#: A key is hot from this share of the rows on, so there are at most so many hot keys.
HOT_KEYS = 1024


def is_small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a materialised table has at most ``most`` rows."""
    return df.limit(most + 1).count() <= most


def lookup(left: DataFrame, right: DataFrame, key: str, rows_per_key: str, total: int, how: str = "inner", small: bool | None = None) -> DataFrame:
    """Join ``left`` to the unique keys of ``right`` without gathering a hot key in one task.

    ``rows_per_key`` is a column of ``right``: the number of left rows with that key.
    A small right side is broadcast after its rows were counted. Beyond that, keys
    with more than ``total / HOT_KEYS`` rows, of which there are at most HOT_KEYS,
    are broadcast; the rest is an ordinary shuffle join of small groups.
    ``how`` is inner, left or left_semi. Null keys match nothing.
    """
    if is_small(right) if small is None else small:
        return left.join(F.broadcast(right), key, how)
    bound = max(1, total // HOT_KEYS)
    hot, cold = right.filter(F.col(rows_per_key) > bound), right.filter(F.col(rows_per_key) <= bound)
    on_hot = left.join(F.broadcast(hot), key, "left_semi" if how == "left_semi" else "inner")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return on_hot.unionByName(rest.join(cold, key, how))


def text_hash(text: Column) -> Column:
    """The 128-bit hash that tells texts under one id apart."""
    return F.unhex(F.md5(text.cast("binary")))


def without(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str, by: Callable[[Column], Column] = text_hash) -> DataFrame:
    """The rows of ``docs`` whose id and text are not in the materialised table ``dropped`` (columns ``id`` and ``th``, made by ``by``).

    What to drop is broadcast after it was counted, else both sides are shuffled by
    both columns. Rows with a null id stay.
    """
    rows = dropped.select(F.col("id").alias("__dropped"), F.col("th").alias("__th"))
    if is_small(rows):
        rows = F.broadcast(rows)
    same = (docs[f"`{id_col}`"] == rows["__dropped"]) & (by(F.coalesce(docs[f"`{text_col}`"], F.lit(""))) == rows["__th"])
    return docs.join(rows, same, "left_anti")
