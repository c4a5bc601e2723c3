"""Sparse models as a splittable data source: spark.read.format("sparse_model").option("table", "points3d").load(folder).

A folder (or a file, by its own path) holds cameras.bin, images.bin and points3D.bin, in itself or in folders below it; each file starts with its number of records, which
have no fixed length. One pass over a file on the driver reads only the counts inside its records and skips all else, and cuts it into ranges of about `rangeBytes` bytes that begin
and end between records; each range is a task, which reads its bytes alone and decodes them by numpy. 2-D points of images are kept.

Names of images end with a zero byte, as common tools write them, or follow their length in four bytes. Option names says which ("terminated", "prefixed"); by default the
one under which the records fill the file exactly is taken. A file that is cut off, has a count beyond its size, an unknown camera model, or bytes after its last record raises,
before any row is returned.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .sparse_model import CAMERAS, MODELS

FILES = {"cameras": "cameras.bin", "images": "images.bin", "points3d": "points3D.bin"}
SCHEMAS = {
    "cameras": f"model string, {CAMERAS}",
    "images": "model string, image_id bigint, qvec_wxyz array<double>, tvec array<double>, camera_id bigint, name string, points2d array<struct<x:double,y:double,point3d_id:decimal(20,0)>>",
    "points3d": "model string, point3d_id decimal(20,0), xyz array<double>, rgb array<int>, error double, track array<struct<image_id:bigint,point2d_idx:bigint>>",
}
# Fixed layouts, little endian: what stands before the part of varying length, and one element of that.
POINT = np.dtype([("id", "<u8"), ("xyz", "<f8", 3), ("rgb", "u1", 3), ("error", "<f8"), ("n", "<u8")])
TRACK = np.dtype([("image_id", "<u4"), ("point2d_idx", "<u4")])
IMAGE = np.dtype([("id", "<u4"), ("q", "<f8", 4), ("t", "<f8", 3), ("camera_id", "<u4")])
SEEN = np.dtype([("x", "<f8"), ("y", "<f8"), ("point", "<u8")])
NO_POINT = (1 << 64) - 1


class SparseModelError(ValueError):
    pass


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    records: int
    names: str


class _Bytes:
    """Bytes of a file from `at` on, read ahead in blocks; places between them can be skipped."""

    def __init__(self, file, size: int, block: int = 1 << 20):
        self.file, self.size, self.block, self.at, self.held, self.start = file, size, block, 0, b"", 0

    def need(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.size:
            raise SparseModelError("truncated or corrupt binary data")
        i = self.at - self.start
        if i < 0 or i + n > len(self.held):
            self.held, self.start, i = self.file.read_at(min(max(n, self.block), self.size - self.at), self.at), self.at, 0
        self.at += n
        return self.held[i : i + n]

    def skip(self, n: int) -> None:
        if n > self.size - self.at:
            raise SparseModelError("truncated or corrupt binary data")
        self.at += n

    def number(self, n: int = 8) -> int:
        return int.from_bytes(self.need(n), "little")

    def name(self, names: str) -> bytes:
        if names == "prefixed":
            return self.need(self.number(4))
        out = b""
        while True:
            piece = self.need(min(64, self.size - self.at) or 1)
            end = piece.find(b"\0")
            if end >= 0:
                self.at -= len(piece) - end - 1
                return out + piece[:end]
            out += piece


def _skip_record(b: _Bytes, table: str, names: str) -> None:
    if table == "cameras":
        b.skip(4)
        model = int.from_bytes(b.need(4), "little", signed=True)
        if not 0 <= model < len(MODELS):
            raise SparseModelError(f"unknown camera model id {model}")
        b.skip(16 + 8 * MODELS[model][1])
    elif table == "images":
        b.skip(IMAGE.itemsize)
        b.name(names)
        b.skip(SEEN.itemsize * b.number())
    else:
        b.skip(POINT.itemsize - 8)
        b.skip(TRACK.itemsize * b.number())


def ranges(file, size: int, path: str, table: str, names: str, most: int) -> list[Range]:
    """Ranges of whole records of one file."""
    b = _Bytes(file, size)
    count = b.number()
    if count > size - 8:
        raise SparseModelError(f"{path}: a count exceeds the file size")
    out, start, n = [], b.at, 0
    for _ in range(count):
        _skip_record(b, table, names)
        n += 1
        if b.at - start >= most:
            out.append(Range(path, start, b.at, n, names))
            start, n = b.at, 0
    if n:
        out.append(Range(path, start, b.at, n, names))
    if b.at != size:
        raise SparseModelError(f"{path}: bytes after the last record")
    return out


def _ranges_of(file, size: int, path: str, table: str, names: str, most: int) -> list[Range]:
    if names or table != "images":
        return ranges(file, size, path, table, names or "terminated", most)
    found, errors = [], []
    for kind in ("terminated", "prefixed"):
        try:
            found.append(ranges(file, size, path, table, kind, most))
        except SparseModelError as e:
            errors.append(e)
    if not found:
        raise errors[0]
    if len(found) == 2 and found[0]:
        raise SparseModelError(f"{path}: names may be terminated or prefixed; set the option names")
    return found[0]


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), values)


def _ids(x: np.ndarray, none: bool = False) -> pa.Array:
    from decimal import Decimal

    return pa.array([None if none and v == NO_POINT else Decimal(v) for v in x.tolist()], pa.decimal128(20, 0))


def _parts(data: np.ndarray, at: np.ndarray, counts: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The elements that stand at each of `at`, counts many, one after another."""
    size = counts * kind.itemsize
    place = np.repeat(at - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(at) else np.zeros(0, np.int64)
    return data[place].view(kind)


def decode(raw: bytes, table: str, records: int, names: str, model: str) -> pa.RecordBatch:
    """Rows of a range, which holds exactly `records` records."""
    data = np.frombuffer(raw, np.uint8)
    at, i = np.zeros(records, np.int64), 0
    tail, counts, texts, cams = np.zeros(records, np.int64), np.zeros(records, np.int64), [], []
    number = struct.Struct("<Q").unpack_from
    for k in range(records):
        at[k] = i
        if table == "cameras":
            head = struct.unpack_from("<IiQQ", raw, i)
            i += 24
            cams.append((*head, list(struct.unpack_from(f"<{MODELS[head[1]][1]}d", raw, i))))
            i += 8 * len(cams[-1][4])
            continue
        if table == "images":
            i += IMAGE.itemsize
            if names == "prefixed":
                (n,) = struct.unpack_from("<I", raw, i)
                texts.append(raw[i + 4 : i + 4 + n])
                i += 4 + n
            else:
                end = raw.index(b"\0", i)
                texts.append(raw[i:end])
                i = end + 1
        else:
            i += POINT.itemsize - 8
        counts[k] = number(raw, i)[0]
        tail[k] = i = i + 8
        i += int(counts[k]) * (SEEN if table == "images" else TRACK).itemsize
    if i != len(raw):
        raise SparseModelError("a range does not end between records")
    same = pa.array([model] * records)
    if table == "cameras":
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
        return pa.record_batch([same, *[pa.array([c[j] for c in cams], t) for j, t in enumerate(kinds)]], ["model", "camera_id", "model_id", "width", "height", "params"])
    kind = IMAGE if table == "images" else POINT
    head = data[at[:, None] + np.arange(kind.itemsize)].reshape(-1).view(kind) if records else np.zeros(0, kind)
    several = lambda x: _lists(np.full(len(x), x.shape[1]), pa.array(np.ascontiguousarray(x).reshape(-1)))
    if table == "images":
        s = _parts(data, tail, counts, SEEN)
        dots = pa.StructArray.from_arrays([pa.array(s["x"].copy()), pa.array(s["y"].copy()), _ids(s["point"], True)], ["x", "y", "point3d_id"])
        names_ = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
        return pa.record_batch(
            [same, pa.array(head["id"].astype(np.int64)), several(head["q"]), several(head["t"]), pa.array(head["camera_id"].astype(np.int64)), names_, _lists(counts, dots)],
            ["model", "image_id", "qvec_wxyz", "tvec", "camera_id", "name", "points2d"])
    t = _parts(data, tail, counts, TRACK)
    track = pa.StructArray.from_arrays([pa.array(t[c].astype(np.int64)) for c in ("image_id", "point2d_idx")], ["image_id", "point2d_idx"])
    return pa.record_batch(
        [same, _ids(head["id"]), several(head["xyz"]), several(head["rgb"].astype(np.int32)), pa.array(head["error"].copy()), _lists(counts, track)],
        ["model", "point3d_id", "xyz", "rgb", "error", "track"])


class SparseModelReader(DataSourceReader):
    def __init__(self, options):
        self.table, self.path = options.get("table", "points3d").lower(), options["path"]
        if self.table not in FILES:
            raise ValueError(f"table is one of {', '.join(FILES)}")
        self.names, self.most = options.get("names", ""), int(options.get("rangeBytes", 16 << 20))

    def _files(self):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(self.path)
        info = where.get_file_info(path)
        if info.type == fs.FileType.File:
            return where, [info]
        found = where.get_file_info(fs.FileSelector(path, recursive=True))
        return where, sorted((f for f in found if f.base_name == FILES[self.table]), key=lambda f: f.path)

    def partitions(self):
        where, files = self._files()
        if not files:
            raise SparseModelError(f"no {FILES[self.table]} under {self.path}")
        out = []
        for f in files:
            with where.open_input_file(f.path) as file:
                out += _ranges_of(file, f.size, f.path, self.table, self.names, self.most)
        return out or [Range("", 0, 0, 0, "")]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if not part.records:
            return
        where, _ = fs.FileSystem.from_uri(self.path)
        with where.open_input_file(part.path) as file:
            raw = file.read_at(part.end - part.start, part.start)
        yield decode(raw, self.table, part.records, part.names, part.path.rsplit("/", 1)[0])


class SparseModelSource(DataSource):
    @classmethod
    def name(cls):
        return "sparse_model"

    def schema(self):
        return SCHEMAS[self.options.get("table", "points3d").lower()]

    def reader(self, schema):
        return SparseModelReader(self.options)


def read_model(spark: SparkSession, folder: str, table: str, **options) -> DataFrame:
    """Rows of a table of the models under an address that pyarrow.fs knows (file:///..., s3://..., hdfs://...)."""
    spark.dataSource.register(SparseModelSource)
    return spark.read.format("sparse_model").option("table", table).options(**options).load(folder)


def save_points(points: DataFrame, folder: str) -> DataFrame:
    """Write points(model, point3d_id, xyz, rgb, error, track) as <folder>/<model>/points3D.bin; returns model, records, bytes. Points of a model are sorted by id
    and streamed to one file; the count at its head is known before. Models are written in parallel, and each file is renamed once it is whole."""
    counts = points.groupBy("model").agg(F.count("*").alias("n"))
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by a hash of the model: a repartition by the join's own key would be taken as done by the join, whose skewed partitions Spark may split
    rows = points.join(counts, "model").repartition(n, F.xxhash64("model")).sortWithinPartitions("model", "point3d_id").select("model", "n", "point3d_id", "xyz", "rgb", "error", "track")

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        where, base = fs.FileSystem.from_uri(folder)
        now, out, temp, size, done = None, None, "", 0, 0

        def close():
            out.close()
            where.move(temp, f"{base}/{now}/points3D.bin")
            return pa.record_batch([pa.array([str(now)]), pa.array([done], pa.int64()), pa.array([size], pa.int64())], ["model", "records", "bytes"])

        for b in batches:
            for r in b.to_pylist():
                if r["model"] != now:
                    if out:
                        yield close()
                    now, size, done = r["model"], 8, 0
                    where.create_dir(f"{base}/{now}", recursive=True)
                    temp = f"{base}/{now}/.{TaskContext.get().taskAttemptId()}"
                    out = where.open_output_stream(temp)
                    out.write(struct.pack("<Q", r["n"]))
                record = struct.pack("<Q3d3BdQ", int(r["point3d_id"]), *r["xyz"], *r["rgb"], r["error"], len(r["track"]))
                record += b"".join(struct.pack("<II", t["image_id"], t["point2d_idx"]) for t in r["track"])
                out.write(record)
                size, done = size + len(record), done + 1
        if out:
            yield close()

    return rows.mapInArrow(run, "model string, records long, bytes long")
