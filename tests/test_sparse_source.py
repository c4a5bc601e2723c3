"""The sparse-model data source: layouts, ranges, names, damaged files, a round trip through files."""

import struct

import pytest
from pyspark.sql import functions as F

from karstline.sources import sparse_source as S


def image(i, name, dots, prefixed=False):
    text = struct.pack("<I", len(name)) + name if prefixed else name + b"\0"
    return struct.pack("<I4d3dI", i, 1.0, 0.0, 0.0, i / 2, i, 2, 3, 7) + text + struct.pack("<Q", len(dots)) + b"".join(struct.pack("<ddQ", *p) for p in dots)


def point(i, track):
    return struct.pack("<Q3d3BdQ", i, i, 2.5, -3, 9, 8, 250, 0.5, len(track)) + b"".join(struct.pack("<II", *t) for t in track)


def camera(i, model, params):
    return struct.pack("<IiQQ", i, model, 640, 480) + struct.pack(f"<{len(params)}d", *params)


def write(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, records in files.items():
        (folder / S.FILES[name]).write_bytes(struct.pack("<Q", len(records)) + b"".join(records))
    return f"file://{folder}"


@pytest.mark.parametrize("prefixed,size", [(False, 1 << 24), (False, 1), (True, 300), (True, 1)])
def test_tables(spark, tmp_path, prefixed, size):
    images = {i: (f"d/ïmg {i}.jpg", [(i + k / 4, -k, 2**64 - 1 if k % 3 == 0 else 2**63 + k) for k in range(i % 5)]) for i in range(1, 40)}
    points = {2**64 - 2 - i: [(i, k) for k in range(i % 4)] for i in range(60)}
    place = write(
        tmp_path / "m", cameras=[camera(2, 1, [100, 101, 32, 24]), camera(1, 0, [50, 5, 6]), camera(9, 10, range(12))],
        images=[image(i, n.encode(), d, prefixed) for i, (n, d) in images.items()], points3d=[point(i, t) for i, t in points.items()])
    write(tmp_path / "n" / "0", points3d=[])
    read = lambda t, where=place: S.read_model(spark, where, t, rangeBytes=size)
    got = {r.camera_id: (r.model_id, r.width, list(r.params)) for r in read("cameras").collect()}
    assert got == {2: (1, 640, [100, 101, 32, 24]), 1: (0, 640, [50, 5, 6]), 9: (10, 640, list(range(12)))}
    rows = read("images")
    assert rows.rdd.getNumPartitions() > (1 if size < 1000 else 0)
    got = {r.image_id: (r.name, [(d.x, d.y, 2**64 - 1 if d.point3d_id is None else int(d.point3d_id)) for d in r.points2d]) for r in rows.collect()}
    assert got == images and {(tuple(r.tvec), r.qvec_wxyz[3] * 2, r.camera_id) for r in rows.collect()} == {((i, 2, 3), i, 7) for i in images}
    got = {int(r.point3d_id): [(t.image_id, t.point2d_idx) for t in r.track] for r in read("points3d", f"file://{tmp_path}").collect()}
    assert got == points
    r = read("points3d").where("size(track) = 0").orderBy("point3d_id").first()
    assert list(r.rgb) == [9, 8, 250] and r.xyz[1:] == [2.5, -3.0] and r.model == f"{tmp_path}/m"
    assert S.read_model(spark, f"file://{tmp_path}/n", "points3d").collect() == []


def test_malformed_files_fail_closed(spark, tmp_path):
    good = struct.pack("<Q", 2) + point(1, [(1, 2)]) + point(2, [])
    bad = {
        "cut": good[:-1], "rest": good + b"x", "count": struct.pack("<Q", 10**9) + point(1, []), "more": struct.pack("<Q", 3) + point(1, []), "track": good[:-8] + struct.pack("<Q", 2**63), "none": b"", "short": b"\1\0\0",
    }
    for name, data in bad.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "points3D.bin").write_bytes(data)
        with pytest.raises(Exception, match="truncated|after the last|exceeds"):
            S.read_model(spark, f"file://{tmp_path}/{name}", "points3d").collect()
    with pytest.raises(Exception, match="unknown camera model"):
        S.read_model(spark, write(tmp_path / "cam", cameras=[camera(1, 99, [1.0] * 4)]), "cameras").collect()
    with pytest.raises(Exception, match="truncated"):
        S.read_model(spark, write(tmp_path / "params", cameras=[camera(1, 1, [100, 101])]), "cameras").collect()
    with pytest.raises(Exception, match="truncated"):
        S.read_model(spark, write(tmp_path / "img", images=[image(1, b"a.jpg", [])[:-2]]), "images").collect()
    with pytest.raises(Exception, match="no images.bin"):
        S.read_model(spark, write(tmp_path / "empty"), "images").collect()


def test_points_through_files(spark, tmp_path):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(500)
    pts = li.groupBy(F.concat(F.lit("m"), F.col("l_orderkey") % 3).alias("model"), F.col("l_orderkey").cast("decimal(20,0)").alias("point3d_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("l_partkey").cast("long").alias("image_id"), F.col("l_linenumber").cast("long").alias("point2d_idx")))).alias("track"))
    pts = pts.select("model", "point3d_id", F.array(F.lit(1.0), F.lit(2.0), F.col("point3d_id").cast("double")).alias("xyz"), F.array(*[F.lit(k) for k in (1, 2, 255)]).alias("rgb"), F.lit(0.25).alias("error"), "track").cache()
    saved = S.save_points(pts, f"file://{tmp_path}/models").collect()
    assert sorted(r.model for r in saved) == ["m0", "m1", "m2"] and sum(r.records for r in saved) == pts.count()
    back = S.read_model(spark, f"file://{tmp_path}/models", "points3d", rangeBytes=2000)
    key = lambda r: (r.model.rsplit("/", 1)[-1], int(r.point3d_id))
    assert {key(r): tuple(r)[2:] for r in back.collect()} == {key(r): tuple(r)[2:] for r in pts.collect()}
