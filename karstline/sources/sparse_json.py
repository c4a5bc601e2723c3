"""JSON documents of sparse models, in parts: rows whose texts, in the order of (model, section, id), are each model's document.

A document of many million points is never one value or one task's: every camera, image and point is a row of its own, and `save` writes a model's rows, sorted over
all tasks, as text files whose names sort in the order of the document. Ids are unique in a table of a model, as the binary format has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .sparse_model import MODELS, intrinsics

KEY = "decimal(20,0)"


def _each(df: DataFrame, section: int, key: str, entry: Column) -> DataFrame:
    return df.select("model", F.lit(section).alias("section"), F.col(key).cast(KEY).alias("id"), F.to_json(entry).alias("text"))


def _joined(entries: DataFrame) -> DataFrame:
    """A comma before every entry but the first of its section."""
    first = entries.groupBy("model", "section").agg(F.min("id").alias("first"))
    return entries.join(first, ["model", "section"]).select("model", "section", "id", F.when(F.col("id") == F.col("first"), F.col("text")).otherwise(F.concat(F.lit(","), "text")).alias("text"))


def _frame(models: DataFrame, texts: dict[int, Column]) -> DataFrame:
    """The text between the sections, a row a model and place."""
    every = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(0).cast(KEY).alias("id"), t.alias("text")) for s, t in texts.items()])
    return models.select("model", F.inline(every))


def _xyz(values: Column) -> Column:
    return F.transform(values, lambda v: v.cast("double"))


def _camera(order: list[str], **more: Column) -> Column:
    own = intrinsics(F.col("model_id"), F.col("params"))
    known = {c: own[c] for c in ("fx", "fy", "cx", "cy", "intrinsic_model", "distortion_model")} | {"distortion_coefficients": own["distortion"]}
    known |= {c: F.col(c) for c in ("camera_id", "width", "height")} | more
    return F.struct(*[known[c].alias(c) for c in order])


def sparse_parts(cameras: DataFrame, images: DataFrame, points: DataFrame) -> DataFrame:
    """(model, section, id, text) of the plain document, version 1, of the three tables of a sparse model (see sparse_source.SCHEMAS)."""
    name = F.element_at(F.array(*[F.lit(m[0]) for m in MODELS]), F.col("model_id") + 1)
    focal = _camera(["cx", "cy", "fx", "fy"])
    q = F.col("qvec_wxyz")
    cams = _each(cameras, 1, "camera_id", _camera(["camera_id", "height", "intrinsic_model", "intrinsics", "model", "width"], intrinsics=focal, model=name))
    imgs = _each(images, 3, "image_id", F.struct("camera_id", "image_id", "name", F.array(q[1], q[2], q[3], q[0]).alias("qvec_xyzw"), F.col("tvec").alias("tvec_xyz")))
    track = F.transform("track", lambda t: F.array(t["image_id"], t["point2d_idx"].cast("long")))
    pts = _each(points, 5, "point3d_id", F.struct("error", F.col("point3d_id").alias("point3D_id"), "rgb", track.alias("track"), _xyz(F.col("xyz")).alias("xyz")))
    models = cameras.select("model").union(images.select("model")).union(points.select("model")).distinct()
    between = {0: '{"cameras":[', 2: '],"images":[', 4: '],"points3D":[', 6: '],"schema_version":1}'}
    return _joined(cams.unionByName(imgs).unionByName(pts)).unionByName(_frame(models, {s: F.lit(t) for s, t in between.items()}))


#: The groups of a reconstruction's provenance, in the order of their names.
PROVENANCE = ("backend", "configuration_hash", "duration_ns", "engine_commit", "engine_version", "finished_at_ns", "git_commit", "input_artifact_hashes", "started_at_ns")
BACKEND = ("adapter_version", "name", "version")


def reconstruction_parts(heads: DataFrame, cameras: DataFrame, images: DataFrame, points: DataFrame, frames: DataFrame) -> DataFrame:
    """(model, section, id, text) of a reconstruction's document, version 2, for every model of heads.

    heads(model, reconstruction_id, scene_id, session_ids, coordinate_frame, status, created_at_ns, provenance), provenance a struct of PROVENANCE with backend a
    struct of BACKEND. cameras may have calibration_ref. frames(name, frame_id): images take the frame of their file name. Empty status, frame_id and calibration_ref are left out."""
    present = lambda c: F.nullif(c, F.lit(""))
    ref = present(F.col("calibration_ref")) if "calibration_ref" in cameras.columns else F.lit(None).cast("string")
    heads = heads.drop("__text")
    mine = heads.select("model")
    order = ["calibration_ref", "camera_id", "cx", "cy", "distortion_coefficients", "distortion_model", "fx", "fy", "height", "intrinsic_model", "width"]
    cams = _each(cameras.join(mine, "model", "left_semi"), 1, "camera_id", _camera(order, calibration_ref=ref))
    one = frames.groupBy("name").agg(F.min("frame_id").cast("string").alias("frame_id"))
    pose = g.col(g.camera_pose(F.col("qvec_wxyz"), F.col("tvec")))
    posed = images.join(mine, "model", "left_semi").join(one, "name", "left").withColumn("__p", pose)
    at = lambda part, axes: F.array(*[F.col(f"__p.{part}.{a}") for a in axes])
    image = F.struct(
        "camera_id", F.lit(True).alias("detected"), present(F.col("frame_id")).alias("frame_id"), "image_id", "name",
        F.struct(at("q", "xyzw").alias("rotation_xyzw"), at("t", "xyz").alias("translation_xyz")).alias("pose"))
    imgs = _each(posed, 3, "image_id", image)
    track = F.transform("track", lambda t: F.struct(t["image_id"].alias("image_id"), t["point2d_idx"].alias("point2d_idx")))
    pts = _each(points.join(mine, "model", "left_semi"), 5, "point3d_id", F.struct(F.col("rgb").alias("color"), "error", "point3d_id", track.alias("track"), _xyz(F.col("xyz")).alias("xyz")))
    inside = lambda *cols: F.regexp_replace(F.to_json(F.struct(*cols)), r"^\{|\}$", "")
    origin = F.struct(*[F.struct(*[F.col(f"provenance.backend.{b}").alias(b) for b in BACKEND]).alias(c) if c == "backend" else F.col(f"provenance.{c}").alias(c) for c in PROVENANCE])
    last = inside(origin.alias("provenance"), "reconstruction_id", "scene_id", F.lit(2).alias("schema_version"), "session_ids", present(F.col("status")).alias("status"))
    between = {
        0: F.lit('{"cameras":['), 2: F.concat(F.lit("],"), inside("coordinate_frame", "created_at_ns"), F.lit(',"images":[')), 4: F.lit('],"points3D":['),
        6: F.concat(F.lit("],"), last, F.lit("}"))}
    return _joined(cams.unionByName(imgs).unionByName(pts)).unionByName(_frame(heads, between))


def save(parts: DataFrame, folder: str) -> None:
    """Write each model's document under <folder>/model=<model>/: its text files, in the order of their names, are the document."""
    parts.orderBy("model", "section", "id").select("model", "text").write.partitionBy("model").option("lineSep", "\n").text(folder)
