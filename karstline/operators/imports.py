"""Batch import of image files: order, one reason a rejected file, deterministic ids, re-imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity as ids
from ..sources import images
from . import temporal

#: The error codes of a file, in the order in which they are tested.
REASONS = ("Unreadable", "UnsupportedFormat", "Corrupt", "SensorUnresolved", "TimestampUnresolvable")


def described(files: DataFrame, allowed: tuple[str, ...] = ("jpeg", "png", "tiff", "exr")) -> DataFrame:
    """files(..., content) as import_batch takes them: content_hash, readable, allowed and the header's geometry instead of the bytes."""
    content = F.col("content")
    facts = {"content_hash": F.sha2(content, 256), "readable": content.isNotNull(), "allowed": F.coalesce(images.detect(content).isin(*allowed), F.lit(False))}
    out = images.with_headers(files.withColumns(facts))
    return out.withColumns({c: F.col(f"header.{c}") for c in ("width", "height", "pixel_format")}).drop("header")


def in_order(files: DataFrame) -> DataFrame:
    """files(uri, pos, ...) with sequence_index by URI; equal URIs keep their order of input."""
    w = Window.partitionBy("session_id").orderBy("uri", "pos")
    return files.withColumn("sequence_index", (F.row_number().over(w) - 1).cast("long"))


def reason(known_sensor: Column) -> Column:
    """The first test that fails, in the order of REASONS; null for a file that can be imported."""
    tests = (
        F.coalesce("readable", F.lit(False)), F.coalesce("allowed", F.lit(False)),
        F.coalesce((F.col("width") >= 1) & (F.col("height") >= 1) & (F.col("pixel_format") != ""), F.lit(False)),
        known_sensor, F.coalesce(F.col("timestamp_ns") != 0, F.lit(False)),
    )
    out = F.lit(None).cast("string")
    for ok, name in reversed(list(zip(tests, REASONS))):
        out = F.when(~ok, name).otherwise(out)
    return out


def import_batch(
    files: DataFrame, sensors: DataFrame, calibrations: DataFrame, observations: DataFrame, stored: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files of a batch.

    files(session_id, uri, pos, sensor_id, timestamp_ns, content_hash, readable, allowed, width, height,
    pixel_format). Accepted rows carry sequence_index, the ids derived from sensor, time and
    content, uncalibrated (no calibration valid at capture: a warning only), reimported (the
    observation exists, nothing is written) and new_instance (the content is stored, or comes earlier
    in the batch). Of rows with one observation id the first in order is new, the rest are re-imports.
    """
    known = sensors.select("sensor_id").distinct().withColumn("__known", F.lit(True))
    every = in_order(files).join(known, "sensor_id", "left").withColumn("error", reason(F.coalesce("__known", F.lit(False)))).drop("__known")
    rejected = every.where("error is not null").select("session_id", "sequence_index", "uri", "error")
    sensor, at, content = ids.uuid5(F.col("sensor_id").cast("string")), F.col("timestamp_ns"), F.col("content_hash")
    good = every.where("error is null").drop("error").withColumns(
        {"frame_id": ids.entity_id("frame", sensor, at, content), "observation_id": ids.entity_id("observation", sensor, at, content)}
    )
    good = temporal.resolve(good.withColumn("__row", F.struct("session_id", "sequence_index")), calibrations, "sensor_id", "timestamp_ns", "__row")
    good = good.withColumn("uncalibrated", F.col("cal_valid_from_ns").isNull()).drop("__row", *[c for c in good.columns if c.startswith("cal_")])
    order = [F.col("session_id"), F.col("sequence_index")]
    again = F.row_number().over(Window.partitionBy("observation_id").orderBy(*order)) > 1
    done = observations.select("observation_id").distinct().withColumn("__done", F.lit(True))
    good = good.withColumn("__again", again).join(done, "observation_id", "left").withColumn("reimported", F.col("__again") | F.coalesce("__done", F.lit(False)))
    # the first file of a content that writes anything puts the payload, unless it is stored
    writes = F.sum(F.when(F.col("reimported"), 0).otherwise(1)).over(Window.partitionBy("content_hash").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    have = stored.select("content_hash").distinct().withColumn("__stored", F.lit(True))
    good = good.withColumn("__before", F.coalesce(writes, F.lit(0))).join(have, "content_hash", "left")
    new = ~F.col("reimported") & (F.coalesce("__stored", F.lit(False)) | (F.col("__before") > 0))
    return good.withColumn("new_instance", new).drop("__again", "__done", "__before", "__stored"), rejected
