"""Scene reads: lookups, joins and latest-of selections over lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME_ORDER = ["timestamp_ns", "sequence_index", "frame_id"]


def in_range(df: DataFrame, start: int, end: int, ts: str = "timestamp_ns") -> DataFrame:
    """Half open: start <= ts < end. Both comparisons reach the scan where ts is a stored column; on a computed one they are a filter of rows."""
    return df.where((F.col(ts) >= start) & (F.col(ts) < end))


def lookup(df: DataFrame, order: list[str] | None = None, **equal) -> DataFrame:
    """Rows whose columns equal the given values, in the given order (its last column breaks ties; -name: from the greatest down)."""
    for name, value in equal.items():
        df = df.where(F.col(name) == value)
    return df.orderBy(*[F.col(c[1:]).desc() if c.startswith("-") else F.col(c) for c in order]) if order else df


def with_payload(observations: DataFrame, payloads: DataFrame) -> DataFrame:
    """Left join; an absent payload reads as 0 x 0 and an empty pixel format."""
    out = observations.join(payloads, "observation_id", "left")
    return out.withColumns({"width": F.coalesce("width", F.lit(0)), "height": F.coalesce("height", F.lit(0)), "pixel_format": F.coalesce("pixel_format", F.lit(""))})


def exists_flag(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """df with a boolean: has other a row of the same key?"""
    keys = other.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__hit", F.lit(True))
    return df.join(keys, key, "left").withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__hit")


def latest(df: DataFrame, keys: list[str], order: list[Column], where: str = "true") -> DataFrame:
    """The first row of each key by the given order among rows that meet `where` (unknown counts as not met)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.where(where).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def resolve_hashes(observations: DataFrame, artifacts: DataFrame) -> DataFrame:
    """observation -> content hash of its artifact; failure 'no_artifact_hash' where there is none."""
    out = observations.join(artifacts.select(F.col("artifact_id").alias("artifact_ref"), "content_hash"), "artifact_ref", "left")
    return out.withColumn("failure", F.when(F.col("content_hash").isNull(), "no_artifact_hash"))
