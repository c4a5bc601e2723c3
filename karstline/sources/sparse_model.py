"""Binary sparse models (cameras, images, 3-D points) as DataFrames of nested rows.

Files come through spark.read.format("binaryFile"); one file is one row, parsed in
Arrow batches. A file that is cut off or names an unknown camera model raises.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Camera models by id: name, parameters, intrinsic model, one focal length, distortion model, kept coefficients.
MODELS = [
    ("SIMPLE_PINHOLE", 3, "pinhole", True, "none", 0),
    ("PINHOLE", 4, "pinhole", False, "none", 0),
    ("SIMPLE_RADIAL", 4, "opencv", True, "opencv_radial", 1),
    ("RADIAL", 5, "opencv", True, "opencv_radial", 2),
    ("OPENCV", 8, "opencv", False, "opencv_radial", 4),
    ("OPENCV_FISHEYE", 8, "opencv_fisheye", False, "opencv_fisheye", 4),
    ("FULL_OPENCV", 12, "custom", False, "custom", 0),
    ("FOV", 5, "fov", False, "custom", 1),
    ("SIMPLE_RADIAL_FISHEYE", 4, "opencv_fisheye", True, "opencv_fisheye", 1),
    ("RADIAL_FISHEYE", 5, "opencv_fisheye", True, "opencv_fisheye", 2),
    ("THIN_PRISM_FISHEYE", 12, "custom", False, "custom", 0),
]
CAMERAS = "camera_id bigint, model_id int, width bigint, height bigint, params array<double>"
IMAGES = "image_id bigint, qvec_wxyz array<double>, tvec array<double>, camera_id bigint, name string"
POINTS = "point3d_id decimal(20,0), xyz array<double>, rgb array<int>, error double, track array<struct<image_id:bigint,point2d_idx:bigint>>"


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, fmt: str) -> tuple:
        s = struct.Struct("<" + fmt)
        if self.at + s.size > len(self.data):
            raise ValueError(f"sparse model ends before byte {self.at + s.size}")
        self.at += s.size
        return s.unpack_from(self.data, self.at - s.size)

    def count(self) -> int:
        (n,) = self.take("Q")
        if n > len(self.data) - self.at:
            raise ValueError("a count exceeds the file")
        return n

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise ValueError("a name has no end")
        out, self.at = self.data[self.at : end].decode(), end + 1
        return out


def cameras(data: bytes) -> list[dict]:
    c, out = _Cursor(data), []
    for _ in range(c.count()):
        camera_id, model, width, height = c.take("IiQQ")
        if not 0 <= model < len(MODELS):
            raise ValueError(f"camera model {model}")
        out.append({"camera_id": camera_id, "model_id": model, "width": width, "height": height, "params": list(c.take(f"{MODELS[model][1]}d"))})
    return sorted(out, key=lambda x: x["camera_id"])


def images(data: bytes) -> list[dict]:
    c, out = _Cursor(data), []
    for _ in range(c.count()):
        (image_id,), q, t, (camera_id,) = c.take("I"), c.take("4d"), c.take("3d"), c.take("I")
        out.append({"image_id": image_id, "qvec_wxyz": list(q), "tvec": list(t), "camera_id": camera_id, "name": c.text()})
        c.take(f"{24 * c.count()}x")
    return sorted(out, key=lambda x: x["image_id"])


def points(data: bytes) -> list[dict]:
    from decimal import Decimal

    c, out = _Cursor(data), []
    for _ in range(c.count()):
        (point_id,), xyz, rgb, (error,) = c.take("Q"), c.take("3d"), c.take("3B"), c.take("d")
        flat = c.take(f"{2 * c.count()}I")
        track = [{"image_id": a, "point2d_idx": b} for a, b in zip(flat[::2], flat[1::2])]
        out.append({"point3d_id": Decimal(point_id), "xyz": list(xyz), "rgb": list(rgb), "error": error, "track": track})
    return sorted(out, key=lambda x: x["point3d_id"])


def read(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """Rows of every file under path, by one of the three parsers above."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for b in batches:
            for content in b.column(0):
                yield pa.RecordBatch.from_pylist(parse(content.as_py()), arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _case(model: Column, at: int) -> Column:
    return F.element_at(F.array(*[F.lit(m[at]) for m in MODELS]), model + 1)


def intrinsics(model: Column, params: Column) -> Column:
    """fx, fy, cx, cy, intrinsic_model, distortion_model and the kept coefficients."""
    single = _case(model, 3)
    at = lambda one, two: F.when(single, F.get(params, F.lit(one))).otherwise(F.get(params, F.lit(two)))
    return F.struct(
        at(0, 0).alias("fx"), at(0, 1).alias("fy"), at(1, 2).alias("cx"), at(2, 3).alias("cy"), _case(model, 2).alias("intrinsic_model"),
        _case(model, 4).alias("distortion_model"), F.slice(params, F.when(single, 4).otherwise(5), _case(model, 5)).alias("distortion"),
    )


def reconstruction_json(cams: DataFrame, imgs: DataFrame, frames: DataFrame) -> DataFrame:
    """One JSON document a pose: camera, frame matched by file name ('' if none), pose in the reconstruction."""
    from ..functions.geometry import camera_pose, col

    p = imgs.join(frames.select("name", "frame_id"), "name", "left")
    p = p.join(cams.select("camera_id", intrinsics(F.col("model_id"), F.col("params")).alias("intrinsics")), "camera_id", "left")
    doc = F.struct(
        "camera_id", F.coalesce("frame_id", F.lit("")).alias("frame_id"), "image_id", "intrinsics", "name",
        col(camera_pose(F.col("qvec_wxyz"), F.col("tvec"))).alias("reconstruction_from_camera"),
    )
    return p.select("image_id", F.to_json(doc).alias("document"))
