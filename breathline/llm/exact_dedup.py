"""Exact deduplication by a 128-bit content hash, with byte comparison inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breathline.llm.skew import is_small, lookup, without
from breathline.llm.storage import materialise


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise: Callable[[Column], Column] = lambda text: text, content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """The group of equal texts of each row: id, keep_id, group_size, kept, text_sha256.

    Texts are grouped by ``content_hash`` of the normalised text; groups of two or
    more rows are then grouped by the bytes themselves, so a hash collision never
    merges different texts. Of equal texts the row with the smallest id stays
    (``keep='max'``: the largest).

    Defined cases: a null text counts as empty; rows with equal id and equal text are
    all members of the group and all count as kept when the id is the keeper's; a null
    id never becomes keep_id unless the whole group has null ids (then keep_id is null
    and kept is false for all); an empty table gives an empty result; other columns of
    ``docs`` are ignored.
    """
    best = {"min": F.min, "max": F.max}[keep]
    text = normalise(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    hashed = rows.withColumn("hash", content_hash(F.col("text")))
    ids = materialise(hashed.select("id", "hash", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha")), "digests")
    total = ids.count()
    groups = ids.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), best("id").alias("keep_id"))
    multi = materialise(groups.filter("n > 1"), "groups")
    small = is_small(multi)

    # The bytes decide: map-side combining leaves one row per task and text, however large the group.
    members = lookup(hashed, multi.select("hash", "n"), "hash", "n", total, small=small).drop("n")
    exact = materialise(members.groupBy("hash", "text").agg(F.count(F.lit(1)).alias("n"), best("id").alias("keep_id")), "texts")
    mixed = exact.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n")).filter("texts > 1").select("hash", "n")
    mixed = materialise(mixed, "collisions")
    collided = mixed.limit(1).count() > 0

    found = lookup(ids, multi, "hash", "n", total, how="left", small=small)
    out = found.select("id", "hash", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), "sha")
    if collided:
        out = out.join(mixed.select("hash"), "hash", "left_anti")
        apart = lookup(hashed, mixed, "hash", "n", total).drop("n").withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
        apart = apart.join(exact.select("hash", "text", F.col("n").alias("group_size"), "keep_id"), ["hash", "text"])
        out = out.unionByName(apart.select("id", "hash", "keep_id", "group_size", "sha"))
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long"), F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` whose text is not a copy, with all columns.

    One row per distinct text stays, that with the smallest id (``keep='max'``: the
    largest). Rows are told apart by id and text: another text under a dropped row's id
    stays. Rows repeated under the same id and text all stay, and so do rows with a null id.
    """
    dropped = exact_groups(docs, id_col, text_col, keep).filter(F.col(id_col).isNotNull() & ~F.col("kept"))
    dropped = dropped.select(F.col(id_col).alias("id"), F.col("text_sha256").alias("th")).distinct()
    return without(docs, materialise(dropped, "copies"), id_col, text_col, by=lambda text: F.sha2(text.cast("binary"), 256))
