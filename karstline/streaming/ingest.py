"""Extension: append-only ingest of observations as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, id_: str, ts: str, lateness: str = "10 minutes") -> DataFrame:
    """The first arrival of each deterministic id; state is dropped once the watermark passes it."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([id_])


def counts(stream: DataFrame, ts: str, by: str, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, window), by).agg(F.count("*").alias("n"))
