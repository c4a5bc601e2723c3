"""Inserts, replayed logs, documents and levels of detail: registered queries against their SQL, operators against plain readings with odd input."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

import karstline.queries_records as R
from karstline.operators import documents, lod, records, temporal
from karstline.sources import images, sparse_json, sparse_source
from oracle import TABLES, compare

D = "/root/testdata/sf0.001"
NAMES = """sessions_inserted rejections_inserted solver_records_added task_runs_recorded cache_entries_replayed workers_upserted manifests_replayed manifest_stages_replayed sensor_pointers
calibration_documents feature_artifacts image_headers sparse_model_documents reconstruction_documents elements_under_error elements_at_level""".split()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    assert compare(spark, R.Q[name], R.SQL[name], D) > 0


def test_inserts_one_after_another(spark):
    rng = random.Random(5)
    maybe = lambda n: rng.choice([None, *range(n)])
    rows = [(i, maybe(12), maybe(5), maybe(4)) for i in range(300)]
    rng.shuffle(rows)
    there, parents, others = {3, 4}, {0, 1, 2, None}, {1, 2}
    taken, want = set(there), {}
    for seq, key, a, b in sorted(rows):
        why = "null" if key is None or a is None else "exists" if key in taken else "reference" if a not in parents or (b is not None and b not in others) else None
        want[seq] = why
        if why is None:
            taken.add(key)
    kinds = "seq long, key long, a long, b long"
    old = spark.createDataFrame([(-1 - k, k, 0, None) for k in there], kinds)
    table = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    refs = [records.Reference("a", table(parents), "id"), records.Reference("b", table([*others, *others]), "id", optional=True)]
    after, refused = records.insert_rows(old, spark.createDataFrame(rows, kinds), ["key"], "seq", refs)
    assert {r.seq: r.reason for r in refused.collect()} == {s: w for s, w in want.items() if w}
    assert {r.seq for r in after.collect()} == {s for s, w in want.items() if not w} | {-4, -5}
    empty = spark.createDataFrame([], kinds)
    assert [x.collect() for x in records.insert_rows(empty, empty, ["key"], "seq", refs)] == [[], []]


def test_manifests_write_by_write(spark):
    rng = random.Random(8)
    log = []
    for seq in range(600):
        op = rng.choice(["begin", "stage", "update", "update", "finish", "report"])
        log.append((seq, op, rng.randrange(25), rng.choice([None, 0, 1, 2]) if op == "stage" else rng.randrange(3), f"g{seq}", rng.choice("sfc"), rng.random() < 0.5, rng.choice([None, seq]), f"r{seq}"))
    manifests, stages = {}, {}
    for seq, op, m, q, g, status, hit, at, report in log:
        if op == "begin":
            manifests.setdefault(m, {"status": "running", "made": at, "done": None, "report": None})
        elif m not in manifests:
            continue
        elif op == "stage" and q is not None:
            stages.setdefault((m, q), (g, "pending", False, None))
        elif op == "update" and (m, q) in stages:
            stages[m, q] = (stages[m, q][0], status, hit, at)
        elif op == "finish":
            manifests[m] |= {"status": status, "done": at}
        elif op == "report":
            manifests[m]["report"] = report
    rng.shuffle(log)
    df = spark.createDataFrame(log, "seq long, op string, manifest_id long, sequence long, stage_id string, status string, cache_hit boolean, at_ns long, report_id string")
    ms, ss = records.replay_manifests(df, "seq")
    assert {r.manifest_id: {"status": r.status, "made": r.created_at_ns, "done": r.finished_at_ns, "report": r.quality_report_id} for r in ms.collect()} == manifests
    assert {(r.manifest_id, r.sequence): (r.stage_id, r.status, r.cache_hit, r.finished_at_ns) for r in ss.collect()} == stages
    assert [x.collect() for x in records.replay_manifests(df.limit(0), "seq")] == [[], []]


def test_entries_replayed(spark):
    log = spark.createDataFrame([(1, "a", "upsert", "x"), (2, "a", "delete", None), (3, "b", "delete", None), (4, "b", "upsert", None), (5, "c", "upsert", "y"), (6, "c", "upsert", "z")], "seq long, key string, op string, v string")
    assert {tuple(r) for r in records.replay_entries(log, "key", "seq").collect()} == {("b", None), ("c", "z")}


def test_pointers_move_to_the_last_written(spark):
    kinds = "calibration_id long, sensor_id long, version long, valid_from_ns long, valid_to_ns long"
    before = spark.createDataFrame([(1, 1, 1, 0, 10), (2, 2, 1, 0, 10)], kinds)
    # the last written is earlier in time, and has the smaller id
    batch = spark.createDataFrame([(9, 1, 50, 60, 1), (5, 1, 20, 30, 2), (6, 2, 5, 7, 3), (7, 3, 1, 2, 4), (8, 4, None, 2, 5)], "calibration_id long, sensor_id long, valid_from_ns long, valid_to_ns long, seq long")
    after, refused = temporal.append_intervals(before, batch, "sensor_id", "seq")
    assert {r.calibration_id for r in refused.collect()} == {6, 8}
    sensors = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, None, "c"), (4, None, "d"), (5, 77, "e")], "sensor_id long, calibration_id long, label string")
    out = temporal.move_pointers(sensors, before, after, "sensor_id", "calibration_id")
    assert {tuple(r) for r in out.collect()} == {(1, 5, "a"), (2, 2, "b"), (3, 7, "c"), (4, None, "d"), (5, 77, "e")}


def test_calibration_documents_of_odd_parts(spark):
    kinds = "calibration_id long, sensor_id long, version long, calibration_time_ns long, source string, intrinsic_model string, intrinsics_json string, distortion_json string, extrinsics_json string, uncertainty_json string, valid_from_ns long, valid_to_ns long"
    rows = [
        (1, 7, 1, 5, None, None, '{"fy":2,"fx":1.5,"z":{"b":[3,{"d":1,"c":null}],"a":"\\u00e9"}}', None, "", "[]", 3, None), (2, 7, 2, 5, "s", "", "", None, None, None, 3, 4),
        (3, 7, 3, 5, "s", "m", None, None, None, None, 3, 4), (4, 7, 4, 5, "s", "m", "{}", "{", "", "", 3, 4), (5, 7, 5, 5, "s", "m", '{"fx":"wide"}', "null", None, None, None, None), (6, 7, 6, 5, "s", "m", '{"a":1,"a":2}', "", "", "", 3, 4)]
    c = spark.createDataFrame(rows, kinds)
    text, error = documents.calibration_document(c)
    out = {r.calibration_id: r for r in c.select("calibration_id", text.alias("t"), error.alias("e")).withColumn("back", documents.read_calibration(F.col("t"))).collect()}
    assert out[1].t == '{"calibration_id":"1","calibration_time_ns":5,"intrinsics":{"fx":1.5,"fy":2,"z":{"a":"é","b":[3,{"c":null,"d":1}]}},"sensor_id":"7","source":"","uncertainty":[],"valid_from_ns":3,"version":1}'
    assert (out[1].back.fx, out[1].back.fy, out[1].back.cx, out[1].back.valid_to_ns) == (1.5, 2.0, None, None)
    assert {k: r.e for k, r in out.items()} == {1: None, 2: "malformed intrinsics", 3: "malformed intrinsics", 4: "malformed distortion", 5: None, 6: "malformed intrinsics"}
    assert json.loads(out[5].t) == {"calibration_id": "5", "calibration_time_ns": 5, "distortion": None, "intrinsic_model": "m", "intrinsics": {"fx": "wide"}, "sensor_id": "7", "source": "s", "version": 5}
    assert out[5].back.fx is None and out[4].t is None


def test_features_recorded_twice(spark):
    point = {"x": 1.0, "y": 2.0, "size": 3.0, "angle": 4.0, "response": 5.0}
    kinds = "seq long, frame_id string, detector string, descriptor_type string, keypoints array<struct<x:double,y:double,size:double,angle:double,response:double>>, descriptors array<array<double>>"
    rows = [(1, "f", "d", "float", [point], [[1.0]]), (2, "g", "d", "float", [point], [[1.0]]), (3, "f", "d", "float", [point], [[1.0]]), (4, "f", "d", "float", [], []), (5, "f", "d", "float", [point], []), (6, "f", "d", "float", None, None)]
    batch = spark.createDataFrame(rows, kinds)
    none = spark.createDataFrame([], "content_hash string, feature_set_id string")
    first = records.record_features(none.select("content_hash"), none.select("feature_set_id"), batch)
    got = {r.seq: r for r in first.collect()}
    assert {s: (r.payload_stored, r.record_exists, r["count"]) for s, r in got.items() if not r.error} == {1: (False, False, 1), 2: (True, False, 1), 3: (True, True, 1), 4: (False, False, 0)}
    assert {s for s, r in got.items() if r.error} == {5, 6}
    assert json.loads(got[1].document) == {"count": 1, "descriptor_type": "float", "descriptors": [[1.0]], "detector": "d", "keypoints": [point], "schema_version": 1}
    again = records.record_features(first.select("content_hash").where("content_hash is not null"), first.select("feature_set_id").where("feature_set_id is not null"), batch)
    assert all(r.payload_stored and r.record_exists for r in again.where("error is null").collect())


def _cut(elements, edges, stops):
    inner = {(p, c) for p, c in edges if p in elements and c in elements and p != c}
    front, seen, out, depth = {e for e in elements if not any(c == e for _, c in inner)}, set(), {}, 0
    while front:
        seen |= front
        down = set()
        for e in front:
            fine = [c for p, c in inner if p == e]
            if e in stops or not fine:
                out[e] = (depth, e in stops)
            else:
                down |= set(fine)
        front, depth = down - seen, depth + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cuts_through_graphs(spark, seed):
    rng = random.Random(seed)
    elements = {e: rng.choice([None, rng.random()]) for e in range(40)}
    edges = [tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)] + [(50, 1), (1, 51), (2, 2)] + [(38, 39), (39, 38)] * (seed == 2)
    edges += edges[:5]
    e = spark.createDataFrame(list(elements.items()), "element_id long, error double")
    g = spark.createDataFrame(edges, "parent long, child long")
    got = {r.element_id: (r.depth, r.exact) for r in lod.cut(e, g, lod.under_error(0.3)).collect()}
    assert got == _cut(set(elements), edges, {k for k, v in elements.items() if v is not None and v <= 0.3})
    assert {r.element_id for r in lod.cut(e, g.limit(0), lod.under_error(0.3)).collect()} == set(elements)
    assert lod.cut(e.limit(0), g, lod.under_error(0.3)).collect() == []


def test_sparse_documents_are_json(spark, tmp_path):
    rng = random.Random(3)
    cameras = spark.createDataFrame([("a", 10, 1, 64, 48, [1.0, 2.0, 3.0, 4.0]), ("a", 9, 2, 64, 48, [1.0, 3.0, 4.0, 0.5]), ("b", 1, 0, 6, 4, [1.0, 3.0, 4.0])], sparse_source.SCHEMAS["cameras"])
    images = spark.createDataFrame([("a", i, [1.0, 0.0, 0.0, 0.0], [float(i), 0.0, 0.0], 9, f'{i}"é.png', []) for i in (30, 4, 100)], sparse_source.SCHEMAS["images"])
    ids = [rng.getrandbits(64) for _ in range(50)] + [0]
    points = spark.createDataFrame([("a", i) for i in map(str, ids)], "model string, i string").select(
        "model", F.col("i").cast("decimal(20,0)").alias("point3d_id"), F.expr("array(1D, 2D, 3D)").alias("xyz"), F.expr("array(1, 2, 255)").alias("rgb"), F.lit(0.5).alias("error"),
        F.expr("array(struct(30L AS image_id, 7L AS point2d_idx))").alias("track"))

    def read(parts):
        rows = sorted(parts.collect(), key=lambda r: (r.model, r.section, r.id))
        return {m: json.loads("".join(r.text for r in rows if r.model == m)) for m in {r.model for r in rows}}

    parts = sparse_json.sparse_parts(cameras, images, points)
    plain = read(parts)
    a = plain["a"]
    assert [c["camera_id"] for c in a["cameras"]] == [9, 10] and a["cameras"][0] == {"camera_id": 9, "model": "SIMPLE_RADIAL", "intrinsic_model": "opencv", "intrinsics": {"fx": 1.0, "fy": 1.0, "cx": 3.0, "cy": 4.0}, "width": 64, "height": 48}
    assert [i["image_id"] for i in a["images"]] == [4, 30, 100] and a["images"][0]["name"] == '4"é.png' and a["images"][0]["qvec_xyzw"] == [0.0, 0.0, 0.0, 1.0]
    assert [p["point3D_id"] for p in a["points3D"]] == sorted(ids) and a["points3D"][0]["track"] == [[30, 7]]
    assert plain["b"] == {"cameras": [{"camera_id": 1, "model": "SIMPLE_PINHOLE", "intrinsic_model": "pinhole", "intrinsics": {"fx": 1.0, "fy": 1.0, "cx": 3.0, "cy": 4.0}, "width": 6, "height": 4}], "images": [], "points3D": [], "schema_version": 1}
    sparse_json.save(parts, str(tmp_path / "docs"))
    for m in "ab":
        files = sorted((tmp_path / "docs" / f"model={m}").glob("part-*"))
        assert json.loads("".join(f.read_text() for f in files)) == plain[m]

    origin = "named_struct('backend', named_struct('name', 'b', 'version', '2', 'adapter_version', '3'), 'configuration_hash', '', 'duration_ns', 1, 'engine_commit', '', 'engine_version', '', 'finished_at_ns', 1, 'git_commit', '', 'input_artifact_hashes', array('h'), 'started_at_ns', 0)"
    heads = spark.sql(f"SELECT 'a' AS model, 'r' AS reconstruction_id, 's' AS scene_id, array('x', 'y') AS session_ids, 'world' AS coordinate_frame, 'succeeded' AS status, 5L AS created_at_ns, {origin} AS provenance")
    frames = spark.createDataFrame([('30"é.png', "f30"), ('30"é.png', "f31"), ('4"é.png', "")], "name string, frame_id string")
    full = read(sparse_json.reconstruction_parts(heads, cameras.withColumn("calibration_ref", F.when(F.col("camera_id") == 9, "cal").otherwise("")), images, points, frames))
    assert set(full) == {"a"}
    doc = full["a"]
    assert doc["status"] == "succeeded" and doc["session_ids"] == ["x", "y"] and doc["provenance"]["backend"] == {"name": "b", "version": "2", "adapter_version": "3"} and doc["schema_version"] == 2
    assert [c.get("calibration_ref") for c in doc["cameras"]] == ["cal", None] and doc["cameras"][0]["distortion_coefficients"] == [0.5]
    assert [i.get("frame_id") for i in doc["images"]] == [None, "f30", None] and doc["images"][1]["pose"]["translation_xyz"] == [-30.0, 0.0, 0.0] and doc["images"][1]["detected"]
    assert [p["point3d_id"] for p in doc["points3D"]] == sorted(ids) and doc["points3D"][0] == {"point3d_id": 0, "xyz": [1.0, 2.0, 3.0], "color": [1, 2, 255], "error": 0.5, "track": [{"image_id": 30, "point2d_idx": 7}]}


def test_image_wider_than_16_bits(spark, tmp_path):
    folder = str(tmp_path)
    kinds = "event_id long, user_id long"
    spark.createDataFrame([(i, u) for i in range(1, 13) for u in (7,)] + [(12 + 6 * i, 65500 + 10 * i) for i in range(1, 20)], kinds).coalesce(1).write.parquet(f"{folder}/events.parquet")
    got = {r.event_id: (r.format, r.width, r.height) for r in R.Q["image_headers"](spark, folder).collect()}
    want = {12 + 6 * i: (None,) * 3 if (12 + 6 * i) % 31 == 0 else ("jpeg", 65516 + 10 * i, 13 + 6 * i) for i in range(1, 20)}
    assert {k: got[k] for k in want} == want
    ls = bytes.fromhex("FFD8FFF8000C0404" "00011170" "00015F90" "FFF7000B0C0000000001")
    assert {k: images.parse_header(ls)[k] for k in ("width", "height", "pixel_format")} == {"width": 90000, "height": 70000, "pixel_format": "gray12"}
    assert [images.parse_header(ls[:n]) for n in (14, 20)] == [None, None] and images.parse_header(ls[:7] + b"\x05" + ls[8:]) is None


def _shifted(spark, folder, table, **columns):
    """The folder with links to all tables of D but one, of which columns are replaced."""
    for t in TABLES:
        if t != table:
            os.symlink(f"{D}/{t}.parquet", f"{folder}/{t}.parquet")
    spark.read.parquet(f"{D}/{table}.parquet").withColumns({c: F.expr(e) for c, e in columns.items()}).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


def test_manifest_writes_beyond_64_bits(spark, tmp_path):
    d = _shifted(spark, tmp_path, "lineitem", l_orderkey="if(l_orderkey % 4 < 2, l_orderkey, l_orderkey + 8000000)", l_partkey="l_partkey + 170000")
    orders = spark.read.parquet(f"{D}/orders.parquet").withColumn("o_orderkey", F.expr("if(o_orderkey % 4 < 2, o_orderkey, o_orderkey + 8000000)"))
    os.unlink(f"{d}/orders.parquet")
    orders.write.parquet(f"{d}/orders.parquet")
    wide = lambda sql: sql.replace("1000000000000000000", "1000000000000000000::HUGEINT")
    for name in ("manifests_replayed", "manifest_stages_replayed"):
        assert compare(spark, R.Q[name], wide(R.SQL[name]), d) > 0


def test_sensor_pointers_where_ids_pass_a_million(spark, tmp_path):
    d = _shifted(spark, tmp_path, "events", event_id="event_id + 999500", user_id="if(event_id % 7 = 0, event_id + 5000, user_id)")
    assert compare(spark, R.Q["sensor_pointers"], R.SQL["sensor_pointers"], d) > 0
