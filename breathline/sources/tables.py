"""CSV recordings in and out, and JSON quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

MISSING = 65535


def read_recording(spark: SparkSession, path: str, numeric: list[str] | None = None) -> DataFrame:
    """A recording's CSV: names and values stripped, bad times dropped, the missing mark null, ``seq`` in file order.

    Columns other than timestamp become doubles (those of ``numeric``, or all).
    """
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")]
    raw = raw.select(*[F.col(f"`{c}`").alias(c.strip()) for c in raw.columns], *place)
    require(raw, ["timestamp"])
    names = [c for c in raw.columns if c not in ("timestamp", "__file", "__block")]
    wanted = numeric or names
    typed = [F.col(f"`{c}`").try_cast("double").alias(c) if c in wanted else F.col(f"`{c}`") for c in names]
    # Within a split rows come in file order; splits are put in the order of file and block.
    split = F.dense_rank().over(Window.orderBy("__file", "__block"))
    splits = raw.select("__file", "__block").distinct().withColumn("__split", split - 1)
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    out = raw.select(F.col("timestamp").try_cast("timestamp_ntz").alias("timestamp"), *typed, "__file", "__block", row.alias("__row")).filter("timestamp is not null")
    out = out.join(F.broadcast(splits), ["__file", "__block"]).withColumn("seq", F.shiftleft(F.col("__split").cast("long"), 33) + F.col("__row"))
    return clean(out.drop("__file", "__block", "__split", "__row"))


def count_rejected(spark: SparkSession, path: str) -> int:
    """Rows of a recording's CSV whose time cannot be read."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.select(*[F.col(f"`{c}`").alias(c.strip()) for c in raw.columns])
    require(raw, ["timestamp"])
    return raw.filter(F.col("timestamp").try_cast("timestamp_ntz").isNull()).count()


def clean(df: DataFrame, keep: tuple[str, ...] = ("seq", "session_id")) -> DataFrame:
    """The missing mark becomes null in every numeric column but those kept."""
    marked = {f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in keep}
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit(MISSING).cast(df.schema[c].dataType)).alias(c) if c in marked else F.col(f"`{c}`") for c in df.columns])


def require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


#: Whole headers whose unit is certain, and certain and doubtful unit suffixes.
CERTAIN = ("IPAP (0.5 cmH2O)", "EPAP (0.5 cmH2O)", "IPAP", "EPAP", "spO2_pct (%)")
CERTAIN_UNITS, FLOW_UNIT, VOLUME = ("(bpm)", "(breaths/min)"), "(L/min)", "vol"


def unit_findings(columns: list[str]) -> list[tuple[str, str]]:
    """(column, uncertain or unknown) of the columns whose unit the header does not settle; case counts, except in ``vol``."""
    open_names = [c for c in columns if c not in CERTAIN and not c.endswith(CERTAIN_UNITS)]
    doubt = {c: "uncertain" if VOLUME in c.lower() else None for c in open_names if FLOW_UNIT in c}
    return [(c, doubt.get(c, "unknown")) for c in open_names if doubt.get(c, "unknown")]


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """CSV with a header, one folder per value of ``by`` if given; replaces what is there."""
    writer = df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    (writer.partitionBy(*by) if by else writer).csv(path)
