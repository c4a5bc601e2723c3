"""Every engine query against its SQL, and fixed values of the semantics."""

import struct
import uuid

import oracle
import pytest
from pyspark.sql import functions as F

from karstline import queries_formats as K
from karstline.functions import geometry as g
from karstline.functions import identity as ids
from karstline.functions import scoring
from karstline.operators import graph, scene, temporal
from karstline.sources import images, sparse_model

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(K.SQL))
def test_query(spark, name):
    oracle.compare(spark, K.Q[name], K.SQL[name], D)


def test_uuid5(spark):
    names = [f"frame|{i}|é" for i in range(40)]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.uuid5(F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.UUID(ids.NAMESPACE), r.n)) for r in got)


def test_intervals(spark):
    cal = spark.createDataFrame([("s", 1, 100, 200), ("s", 2, 300, None), ("s", 3, None, None)], "sensor_id string, version long, valid_from_ns long, valid_to_ns long")
    probe = spark.createDataFrame([("s", t) for t in (99, 100, 199, 200, 250, 300, (1 << 63) - 1)] + [("x", 150)], "sensor_id string, t long").withColumn("i", F.monotonically_increasing_id())
    got = {(r.sensor_id, r.t): r.cal_version for r in temporal.resolve(probe, cal, "sensor_id", "t", "i").collect()}
    assert got == {("s", 99): None, ("s", 100): 1, ("s", 199): 1, ("s", 200): None, ("s", 250): None, ("s", 300): 2, ("s", (1 << 63) - 1): 2, ("x", 150): None}


def test_append_in_order(spark):
    old = spark.createDataFrame([("s", 1, 100, 200)], "sensor_id string, version long, valid_from_ns long, valid_to_ns long")
    new = spark.createDataFrame(
        [("s", 1, 150, 250), ("s", 2, 50, 150), ("s", 3, 200, 300), ("s", 4, None, 5), ("s", 5, 400, 400), ("s", 6, 300, None), ("t", 7, 1, None)],
        "sensor_id string, seq long, valid_from_ns long, valid_to_ns long")
    ok, bad = temporal.append_intervals(old, new, "sensor_id", "seq")
    assert {(r.sensor_id, r.valid_from_ns, r.version) for r in ok.collect()} == {("s", 100, 1), ("s", 200, 2), ("s", 300, 3), ("t", 1, 1)}
    assert sorted(r.reason for r in bad.collect()) == ["empty_interval", "missing_start", "overlap", "overlap"]


def test_half_open(spark):
    df = spark.createDataFrame([(100,), (200,), (300,)], "timestamp_ns long")
    assert scene.in_range(df, 100, 300).count() == 2


def test_poses(spark):
    a = g.pose(g.from_axis_angle(g.vec(0, 0, 1), F.lit(0.3)), g.vec(1, 2, 3))
    b = g.pose(g.quat(0, 0, 0, 1), g.vec(0.1, 0.2, 0.3))
    one = g.compose(g.compose(a, b), g.invert(g.compose(a, b)))
    r = spark.range(1).select(g.col(one).alias("p"), g.col(g.from_matrix(g.to_matrix(a.q))).alias("q"), g.col(a.q).alias("a"), g.to_matrix4(a)[0][3].alias("tx")).first()
    assert abs(r.p.q.w - 1) < 1e-12 and max(abs(r.p.t.x), abs(r.p.t.y), abs(r.p.t.z)) < 1e-12 and r.tx == 1.0
    assert max(abs(x - y) for x, y in zip(r.q, r.a)) < 1e-12


def test_graph_order_and_cycle():
    assert graph.topological_order([("a", "c"), ("b", "c"), ("a", "c")], ["b", "a", "c"]) == ["b", "a", "c"]
    with pytest.raises(ValueError):
        graph.topological_order([("a", "b"), ("b", "a")], ["a", "b"])


def test_scoring(spark):
    cfg = ['{"config":{"quality":{"thresholds":{"pass":30,"warn":40}}}}', '{"config":5}', "no json", '{"config":{"quality":{"thresholds":{"pass":"x"}}}}']
    got = spark.createDataFrame([(c,) for c in cfg], "c string").select(scoring.thresholds(F.col("c")).alias("t")).collect()
    assert [tuple(r.t) for r in got] == [(40.0, 40.0), (80.0, 50.0), (80.0, 50.0), (80.0, 50.0)]
    assert [r[0] for r in spark.range(1, 4).select(scoring.backoff(F.col("id"), 1000, 2, 30000)).collect()] == [1000, 2000, 4000]
    m = spark.createDataFrame([("00" * 32,)], "d string").select(scoring.mock_metrics(F.col("d")).alias("m")).first().m
    assert abs(m.rmse_px - (0.2 + 1.3 * (0xE220A8397B1DCDAF >> 11) / 2**53)) < 1e-15  # first draw of seed 0


def test_image_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 640, 480, 8, 6, 0, 0, 0)
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0" + struct.pack(">HBHHB", 17, 8, 48, 64, 3)
    entries = struct.pack("<HHHII", 3, 256, 3, 1, 32) + struct.pack("<HHII", 257, 3, 1, 16) + struct.pack("<HHII", 50706, 1, 4, 1)
    dng = b"II*\0" + struct.pack("<I", 8) + entries
    exr = b"\x76\x2f\x31\x01\x02\0\0\0" + b"dataWindow\0box2i\0" + struct.pack("<I4i", 16, -1, 0, 8, 4) + b"\0"
    df = spark.createDataFrame([("a", png), ("b", jpg), ("c", dng), ("d", exr), ("e", b"GIF89a.."), ("f", jpg[:9]), ("g", None)], "path string, content binary")
    got = {r.path: r.header and tuple(r.header) for r in images.with_headers(df).collect()}
    assert got == {
        "a": ("png", 640, 480, "rgba8", "image/png"), "b": ("jpeg", 64, 48, "rgb8", "image/jpeg"), "c": ("raw", 32, 16, "gray8", "image/x-adobe-dng"),
        "d": ("exr", 10, 5, "unknown", "image/x-exr"), "e": None, "f": None, "g": None}
    kinds = {r.path: r.k for r in df.select("path", images.detect(F.col("content")).alias("k")).collect()}
    assert [kinds[k] for k in "abcdef"] == ["jpeg" if k in "bf" else {"a": "png", "c": "tiff", "d": "exr", "e": "unknown"}[k] for k in "abcdef"]


def test_sparse_model(spark, tmp_path):
    data = struct.pack("<Q", 2) + struct.pack("<IiQQ5d", 7, 3, 100, 80, 50, 49, 41, 0.1, 0.2) + struct.pack("<IiQQ4d", 2, 1, 10, 8, 5, 6, 7, 8)
    (tmp_path / "cameras.bin").write_bytes(data)
    rows = sparse_model.read(spark, str(tmp_path / "cameras.bin"), sparse_model.cameras, sparse_model.CAMERAS)
    got = rows.select("camera_id", sparse_model.intrinsics(F.col("model_id"), F.col("params")).alias("i")).collect()
    assert [r.camera_id for r in got] == [2, 7] and got[1].i.fx == got[1].i.fy == 50 and list(got[1].i.distortion) == [0.1, 0.2] and got[0].i.cy == 8
    with pytest.raises(ValueError):
        sparse_model.cameras(data[:-1])
    pts = struct.pack("<Q", 1) + struct.pack("<Q3d3BdQ", 2**63 + 5, 1, 2, 3, 9, 8, 7, 0.5, 1) + struct.pack("<II", 4, 6)
    assert int(sparse_model.points(pts)[0]["point3d_id"]) == 2**63 + 5


def test_stream_dedup(spark, tmp_path):
    from karstline.streaming import ingest

    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "id long, t string").select("id", F.col("t").cast("timestamp").alias("t")).write.parquet(str(tmp_path / "in"))
    s = ingest.deduplicated(spark.readStream.schema("id long, t timestamp").parquet(str(tmp_path / "in")), "id", "t")
    q = s.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.table("seen").collect()) == [1, 2]


def test_mutations_on_repeated_keys(spark):
    from karstline.operators import store

    log = spark.createDataFrame([("A", "h1", 1), ("B", "h1", 2), ("B", "h2", 3)], "artifact_id string, content_hash string, seq long")
    assert [tuple(r) for r in store.artifact_index(log).collect()] == [("B", "h2", 3)]
    old, new = (spark.createDataFrame(x, "k long, v string") for x in ([(1, "a"), (2, "b")], [(1, "c"), (1, "d"), (3, "e"), (3, "e")]))
    assert sorted(tuple(r) for r in store.upsert(old, new, ["k"]).collect()) == [(1, "d"), (2, "b"), (3, "e")]
    assert sorted(tuple(r) for r in store.update_fields(old, new, "k").collect()) == [(1, "d"), (2, "b")]
    scenes = spark.createDataFrame([(1, 10)], "scene_id long, current_version long")
    versions = spark.createDataFrame([(1, 10, None)], "scene_id long, version_id long, parent_version long")
    asked = spark.createDataFrame([(1, 12, 6), (1, 11, 5), (9, 13, 7)], "scene_id long, version_id long, created_at_ns long")
    v, s, refused = store.new_scene_versions(scenes, versions, asked)
    assert sorted(tuple(r) for r in v.collect()) == [(1, 10, None), (1, 11, 10), (1, 12, 11)]
    assert [tuple(r) for r in s.collect()] == [(1, 12)] and [r.scene_id for r in refused.collect()] == [9]


def test_feature_and_graph_documents(spark):
    from karstline.operators import documents

    one = spark.range(1).select(F.array(F.struct(F.lit(1.0).alias("x"))).alias("k"), F.array(F.array(F.lit(0.5))).alias("d"))
    assert one.select(documents.feature_json(F.col("k"), F.col("d"))).first()[0] == '{"descriptors":[[0.5]],"keypoints":[{"x":1.0}]}'
    with pytest.raises(Exception, match="descriptors"):
        one.select(documents.feature_json(F.col("k"), F.array().cast("array<array<double>>"))).collect()
    tasks = spark.createDataFrame([(7, 2, "pending"), (7, 1, "failed"), (8, 3, "running")], "job_id long, task_id long, status string")
    edges = spark.createDataFrame([(1, 2), (1, 2)], "parent long, child long")
    t, e = documents.read_task_graph(documents.task_graph_json(tasks, edges))
    assert sorted(tuple(r) for r in t.collect()) == [(7, 1, "failed"), (7, 2, "pending"), (8, 3, "running")]
    assert [tuple(r) for r in e.collect()] == [(7, 1, 2)]


def test_mock_keypoints():
    def plain(digest, count):
        state = 0
        for i in range(0, 64, 8):
            state ^= int.from_bytes(digest[i : i + 8].encode(), "big")
        mask = (1 << 64) - 1

        def draw(m):
            nonlocal state
            state ^= state >> 12
            state ^= (state << 25) & mask
            state ^= state >> 27
            return (state * 0x2545F4914F6CDD1D & mask) % m

        side, out = 1, []
        while side * side < count:
            side += 1
        for i in range(count):
            x, y, size = ((draw(1000) / 1000) for _ in range(3))
            gap = 96.0 / side
            out.append((((i % side) * gap + x * gap * 0.25, (i // side) * gap + y * gap * 0.25, 2 + size * 4, draw(62831) / 100, draw(100000) / 100000), [draw(65536) / 65536 for _ in range(16)]))
        return out

    digests = [f"{k:064x}" for k in (1, 2**200 + 5, 77)]
    assert scoring.keypoints(digests, 7) == [plain(x, 7) for x in digests]


def test_compile(spark):
    from karstline.operators import tasks
    from karstline.plans import pipelines

    known = pipelines.built_in()
    assert known.ids() == ["feature_extraction", "mock_photogrammetry"]
    with pytest.raises(ValueError, match="already"):
        known.register(known.find("feature_extraction"))
    mock, able = known.find("mock_photogrammetry"), {"feature_extraction", "reconstruction", "validation"}
    plan = pipelines.compile_pipeline(mock, ["b", "a"], '{"x":1}', able)
    assert [s["inputs"] for s in plan["stages"]] == [["b", "a"], ["mock_photogrammetry/feature_extract/output"], ["mock_photogrammetry/reconstruct/output"]]
    assert plan == pipelines.compile_pipeline(mock, ["b", "a"], '{"x":1}', able) and plan["pipeline_hash"] != pipelines.compile_pipeline(mock, ["b"], '{"x":1}', able)["pipeline_hash"]
    row = spark.range(1).select(ids.pipeline_hash(F.lit(mock.id), F.lit(mock.version), F.lit(mock.git_commit), F.lit('{"x":1}'), F.array(F.lit("b"), F.lit("a"))).alias("p"),
                                ids.cache_key(F.lit("feature_extract"), F.array(F.lit("b"), F.lit("a")), F.lit(plan["stages"][0]["config_hash"]), F.lit(""), F.lit("")).alias("k")).first()
    assert (row.p, row.k) == (plan["pipeline_hash"], plan["stages"][0]["task_hash"])
    for args, word in (((mock, [], "", able), "input"), ((mock, ["a"], "{", able), "JSON"), ((mock, ["a"], "", {"validation"}), "capability")):
        with pytest.raises(ValueError, match=word):
            pipelines.compile_pipeline(*args)
    t, e = pipelines.tables(spark, plan)
    assert [r.task_id for r in tasks.ready(t, e).collect()] == ["feature_extract"]


def test_project(spark, tmp_path):
    from karstline.plans.project import Project

    root, id_ = f"file://{tmp_path}/p.spx", "00000000-0000-4000-8000-000000000001"
    p = Project.create(spark, root, "name", id_)
    p.write("frames", spark.range(3))
    for bad in (lambda: Project.create(spark, root, "n", id_), lambda: Project.create(spark, f"{root}x", "n", id_), lambda: Project.open(spark, f"{root}.none"),
                lambda: Project.create(spark, f"file://{tmp_path}/q.spx", "n", "00000000-0000-0000-0000-000000000000")):
        with pytest.raises((ValueError, OSError)):
            bad()
    reader = Project.open(spark, root, read_only=True)
    assert reader.info["uuid"] == id_ and reader.table("frames").count() == 3
    with pytest.raises(PermissionError):
        reader.write("frames", spark.range(1))
    p.info["schema_version"] = 5
    p.save()
    assert Project.open(spark, root).info["schema_version"] == 8 and Project.open(spark, root).migrate() == 0
    (tmp_path / "p.spx" / "logs").rmdir()
    with pytest.raises(ValueError, match="logs"):
        Project.open(spark, root)


def test_import_of_files(spark):
    from karstline.operators import imports

    png = lambda colour, n=29: (b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 640, 480, 8, colour, 0, 0, 0) + b"\0" * 9)[:n]
    rows = [("b", png(6)), ("a", png(2)), ("c", b"GIF89a.."), ("d", None), ("e", png(2, 20)), ("f", png(6)), ("g", png(2)), ("h", png(9))]
    files = spark.createDataFrame([(1, u, k, 99 if u == "g" else 5, 0 if u == "h" else 7, c) for k, (u, c) in enumerate(rows)], "session_id long, uri string, pos long, sensor_id long, timestamp_ns long, content binary")
    heads = {r.uri: (r.p, images.parse_header(bytes(r.content)) if r.content else None) for r in files.select("uri", "content", images.png_header(F.col("content")).alias("p")).collect()}
    assert all((p.asDict() if p else None) == h for p, h in heads.values()) and heads["h"][0].pixel_format == "unknown"
    cal = spark.createDataFrame([(3, 5, 1, 0, 7)], "calibration_id long, sensor_id long, version long, valid_from_ns long, valid_to_ns long")
    none, sensors = spark.createDataFrame([], "observation_id string, content_hash string"), spark.createDataFrame([(5,)], "sensor_id long")
    good, bad = imports.import_batch(imports.described(files), sensors, cal, none.select("observation_id"), none.select("content_hash"))
    assert {(r.uri, r.sequence_index, r.error) for r in bad.collect()} == {("c", 2, "UnsupportedFormat"), ("d", 3, "Unreadable"), ("e", 4, "Corrupt"), ("g", 6, "SensorUnresolved"), ("h", 7, "TimestampUnresolvable")}
    assert {(r.uri, r.reimported, r.new_instance, r.uncalibrated) for r in good.collect()} == {("a", False, False, True), ("b", False, False, True), ("f", True, False, True)}
