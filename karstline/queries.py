"""Registered queries of the capture engine and the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry as g
from .functions import identity as ids
from .functions import scoring
from .operators import graph, scene, store, tasks, temporal, trajectory, validate
from .plans import fixtures as fx

START, END = 1704672000000000000, 1705881600000000000
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = fx.DOMAIN_SQL + sql
        return f

    return add


@query(f"""SELECT o.observation_id, o.timestamp_ns, coalesce(p.width, 0) AS width, coalesce(p.height, 0) AS height,
coalesce(p.pixel_format, '') AS pixel_format, c.cal_id, c.cal_version FROM observations o LEFT JOIN payloads p USING (observation_id)
LEFT JOIN LATERAL (SELECT calibration_id AS cal_id, version AS cal_version FROM calibrations c WHERE c.sensor_id = o.sensor_id
AND c.valid_from_ns <= o.timestamp_ns AND (c.valid_to_ns IS NULL OR o.timestamp_ns < c.valid_to_ns) ORDER BY c.valid_from_ns DESC, version DESC LIMIT 1) c ON true
WHERE o.type = 'image' AND o.timestamp_ns >= {START} AND o.timestamp_ns < {END}""")
def calibrated_captures(spark: SparkSession, d: str) -> DataFrame:
    o = scene.in_range(fx.observations(spark, d, (START, END)), START, END).where("type = 'image'")
    o = scene.with_payload(o, fx.payloads(spark, d))
    o = temporal.resolve(o, fx.calibrations(spark, d), "sensor_id", "timestamp_ns", "observation_id")
    return o.select("observation_id", "timestamp_ns", "width", "height", "pixel_format", F.col("cal_calibration_id").alias("cal_id"), "cal_version").orderBy("timestamp_ns", "observation_id")


@query("SELECT artifact_id, content_hash, file_size FROM artifacts WHERE type = 'src3'")
def artifacts_by_type(spark, d):
    return scene.lookup(fx.artifacts(spark, d), type="src3").select("artifact_id", "content_hash", "file_size")


@query("SELECT artifact_id, mime_type FROM artifacts WHERE content_hash = (SELECT content_hash FROM artifacts WHERE artifact_id = 7)")
def artifact_by_hash(spark, d):
    a = fx.artifacts(spark, d)
    return a.join(a.where("artifact_id = 7").select("content_hash").distinct(), "content_hash", "left_semi").select("artifact_id", "mime_type")


@query("SELECT frame_id, timestamp_ns, sequence_index FROM frames WHERE scene_id = 4")
def frames_by_scene(spark, d):
    return scene.lookup(fx.frames(spark, d), scene.FRAME_ORDER, scene_id=4).select("frame_id", "timestamp_ns", "sequence_index")


@query("SELECT frame_id, session_id, sequence_index FROM frames WHERE sensor_id = 11")
def frames_by_sensor(spark, d):
    return scene.lookup(fx.frames(spark, d), scene.FRAME_ORDER, sensor_id=11).select("frame_id", "session_id", "sequence_index")


@query(f"SELECT frame_id, scene_id, timestamp_ns FROM frames WHERE timestamp_ns >= {START} AND timestamp_ns < {END}")
def frames_in_time_range(spark, d):
    return scene.in_range(fx.frames(spark, d), START, END).select("frame_id", "scene_id", "timestamp_ns").orderBy("timestamp_ns", "frame_id")


@query("SELECT session_id, count(*) AS frames, min(timestamp_ns) AS started_at_ns, max(timestamp_ns) AS ended_at_ns FROM frames GROUP BY session_id")
def session_bounds(spark, d):
    return fx.frames(spark, d).groupBy("session_id").agg(F.count("*").alias("frames"), F.min("timestamp_ns").alias("started_at_ns"), F.max("timestamp_ns").alias("ended_at_ns"))


@query("""SELECT o.observation_id, o.scene_id, o.type, coalesce(width, 0) AS width, coalesce(height, 0) AS height, coalesce(pixel_format, '') AS pixel_format
FROM observations o LEFT JOIN payloads USING (observation_id)""")
def observations_with_payload(spark, d):
    return scene.with_payload(fx.observations(spark, d), fx.payloads(spark, d)).select("observation_id", "scene_id", "type", "width", "height", "pixel_format")


@query("""SELECT f.frame_id, f.scene_id, 'd' || e.label AS detector, 64 AS count FROM embeddings e JOIN frames f ON f.frame_id = e.vec_id""")
def feature_sets_by_scene(spark, d):
    e = fx.raw(spark, d, "embeddings").select(F.col("vec_id").alias("frame_id"), F.concat(F.lit("d"), F.col("label").cast("string")).alias("detector"), F.lit(64).alias("count"))
    return e.join(fx.frames(spark, d).select("frame_id", "scene_id"), "frame_id").select("frame_id", "scene_id", "detector", "count")


@query("""SELECT s.sensor_id, EXISTS (SELECT 1 FROM calibrations c WHERE c.sensor_id = s.sensor_id) AS has_calibration,
EXISTS (SELECT 1 FROM calibrations c WHERE c.sensor_id = s.sensor_id AND c.valid_to_ns IS NULL) AS has_open_calibration FROM (SELECT DISTINCT user_id AS sensor_id FROM events) s""")
def sensors_with_calibration(spark, d):
    s, c = fx.raw(spark, d, "events").select(F.col("user_id").alias("sensor_id")).distinct(), fx.calibrations(spark, d)
    s = scene.exists_flag(s, c, "sensor_id", "has_calibration")
    return scene.exists_flag(s, c.where("valid_to_ns is null"), "sensor_id", "has_open_calibration").select("sensor_id", "has_calibration", "has_open_calibration")


@query("""SELECT c.c_custkey AS session_id, r.r_name AS project, n.n_name AS scene FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def session_project_scene(spark, d):
    c, n, r = (fx.raw(spark, d, t) for t in ("customer", "nation", "region"))
    out = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return out.select(F.col("c_custkey").alias("session_id"), F.col("r_name").alias("project"), F.col("n_name").alias("scene"))


@query("""SELECT o.observation_id, a.content_hash, CASE WHEN a.content_hash IS NULL THEN 'no_artifact_hash' END AS failure
FROM observations o LEFT JOIN artifacts a ON a.artifact_id = o.artifact_ref""")
def observation_hashes(spark, d):
    return scene.resolve_hashes(fx.observations(spark, d), fx.artifacts(spark, d)).select("observation_id", "content_hash", "failure")


@query("""SELECT sensor_id, calibration_id, covered_to_ns FROM (SELECT *, max(coalesce(wide, 9223372036854775807)) OVER (PARTITION BY sensor_id ORDER BY valid_from_ns, calibration_id
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered_to_ns FROM (SELECT *, valid_to_ns + 3600000000000 AS wide FROM calibrations)) WHERE covered_to_ns > valid_from_ns""")
def calibration_overlaps(spark, d):
    wide = fx.calibrations(spark, d).withColumn("valid_to_ns", F.col("valid_to_ns") + fx.HOUR)  # an hour longer, so that neighbours overlap
    return temporal.overlaps(wide, "sensor_id", "calibration_id")


@query("""SELECT s.sensor_id, coalesce(max(c.version), 0) + 1 AS next_version FROM (SELECT DISTINCT user_id AS sensor_id FROM events) s
LEFT JOIN calibrations c ON c.sensor_id = s.sensor_id GROUP BY s.sensor_id""")
def next_calibration_version(spark, d):
    return temporal.next_version(fx.calibrations(spark, d), fx.raw(spark, d, "events").select(F.col("user_id").alias("sensor_id")).distinct(), "sensor_id")


@query("""SELECT calibration_id, sensor_id, version, valid_from_ns, valid_to_ns FROM calibrations WHERE version <= 2 UNION ALL
SELECT calibration_id + 1000000, c.sensor_id, m.v + row_number() OVER (PARTITION BY c.sensor_id ORDER BY valid_from_ns), valid_from_ns, valid_to_ns
FROM calibrations c JOIN (SELECT sensor_id, max(version) AS v FROM calibrations WHERE version <= 2 GROUP BY sensor_id) m ON m.sensor_id = c.sensor_id
WHERE c.version > 2 AND NOT EXISTS (SELECT 1 FROM calibrations o WHERE o.sensor_id = c.sensor_id AND o.version <= 2 AND o.valid_from_ns < coalesce(c.valid_to_ns, 9223372036854775807)
AND c.valid_from_ns < coalesce(o.valid_to_ns, 9223372036854775807))""")
def append_calibrations(spark, d):
    c = fx.calibrations(spark, d)
    batch = c.where("version > 2").withColumns({"calibration_id": F.col("calibration_id") + 1000000, "seq": F.col("valid_from_ns")})
    return temporal.append_intervals(c.where("version <= 2"), batch, "sensor_id", "seq")[0]


@query("""SELECT frame_id, timestamp_ns - sensor_id * 10 AS nominal_ns, timestamp_ns - 2500000 AS event_ns, timestamp_ns + 7 * session_id AS synced_ns FROM frames""")
def clock_corrections(spark, d):
    t = F.col("timestamp_ns")
    return fx.frames(spark, d).select(
        "frame_id", temporal.nominal_time(t, F.col("sensor_id") * 10).alias("nominal_ns"), temporal.event_time(t, F.lit(2500000)).alias("event_ns"),
        temporal.synchronized(t, 7 * F.col("session_id")).alias("synced_ns"),
    )


def _latest(table: str, keys: str, where: str) -> str:
    id_ = table[:-1] + "_id"
    return f"SELECT {keys}, {id_}, status FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY created_at DESC, {id_} DESC) AS rn FROM {table} WHERE {where}) WHERE rn = 1"


@query(_latest("reconstructions", "scene_id", "status = 'succeeded'"))
def latest_reconstruction(spark, d):
    out = scene.latest(fx.reconstructions(spark, d), ["scene_id"], [F.col("created_at").desc(), F.col("reconstruction_id").desc()], "status = 'succeeded'")
    return out.select("scene_id", "reconstruction_id", "status")


@query(_latest("trajectorys".replace("ys", "ies"), "session_id", "status <> 'superseded'").replace("trajectorie_id", "trajectory_id"))
def latest_trajectory(spark, d):
    out = scene.latest(fx.trajectories(spark, d), ["session_id"], [F.col("created_at").desc(), F.col("trajectory_id").desc()], "status <> 'superseded'")
    return out.select("session_id", "trajectory_id", "status")


@query("""SELECT artifact_id, content_hash, type FROM artifacts a WHERE NOT EXISTS (SELECT 1 FROM artifacts b WHERE b.content_hash = a.content_hash AND b.seq > a.seq)""")
def artifact_index_current(spark, d):
    return store.artifact_index(fx.artifacts(spark, d)).select("artifact_id", "content_hash", "type")


@query("""SELECT artifact_id, (EXISTS (SELECT 1 FROM artifacts b WHERE b.artifact_id % 3 = 0 AND b.content_hash = a.content_hash) OR
EXISTS (SELECT 1 FROM artifacts b WHERE b.artifact_id % 3 <> 0 AND b.content_hash = a.content_hash AND b.seq < a.seq)) AS dedup FROM artifacts a WHERE artifact_id % 3 <> 0""")
def put_dedup(spark, d):
    a = fx.artifacts(spark, d)
    return store.put(a.where("artifact_id % 3 = 0"), a.where("artifact_id % 3 <> 0"))[1].select("artifact_id", "dedup")


@query("SELECT DISTINCT content_hash FROM artifacts WHERE content_hash NOT IN (SELECT content_hash FROM artifacts WHERE artifact_id % 5 <> 1)")
def unreferenced_payloads(spark, d):
    a = fx.artifacts(spark, d)
    return store.unreferenced(a.select("content_hash").distinct(), a.where("artifact_id % 5 <> 1"), "content_hash")


@query("""SELECT artifact_id, content_hash, mime_type, file_size FROM artifacts WHERE artifact_id % 4 <> 0 UNION ALL
SELECT artifact_id, sha256(content_hash), mime_type, file_size + 1 FROM artifacts WHERE artifact_id % 4 = 0""")
def upsert_snapshot(spark, d):
    a = fx.artifacts(spark, d).select("artifact_id", "content_hash", "mime_type", "file_size")
    new = a.where("artifact_id % 4 = 0").withColumns({"content_hash": F.sha2("content_hash", 256), "file_size": F.col("file_size") + 1, "mime_type": F.lit("changed")})
    return store.upsert(a, new, ["artifact_id"], keep=["mime_type"])


@query("""SELECT artifact_id, CASE WHEN artifact_id % 6 = 0 THEN NULL WHEN artifact_id % 6 = 1 THEN 'x' || mime_type ELSE mime_type END AS mime_type FROM artifacts""")
def update_metadata(spark, d):
    a = fx.artifacts(spark, d).select("artifact_id", "mime_type")
    new = a.where("artifact_id % 6 < 2").withColumn("mime_type", F.when(F.col("artifact_id") % 6 == 0, "").otherwise(F.concat(F.lit("x"), "mime_type")))
    return store.update_fields(a, new, "artifact_id")


@query("""SELECT n_nationkey AS scene_id, n_nationkey AS version_id, NULL AS parent_version FROM nation UNION ALL
SELECT c_nationkey, c_custkey + 1000, coalesce(lag(c_custkey + 1000) OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 7, c_custkey), c_nationkey) FROM customer WHERE c_nationkey % 2 = 0""")
def scene_versions_next(spark, d):
    n = fx.raw(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("scene_id"))
    versions = n.select("scene_id", F.col("scene_id").alias("version_id"), F.lit(None).cast("long").alias("parent_version"))
    asked = fx.raw(spark, d, "customer").where("c_nationkey % 2 = 0").selectExpr("cast(c_nationkey as long) AS scene_id", "cast(c_custkey + 1000 as long) AS version_id", "cast(c_custkey % 7 as long) AS created_at_ns")
    return store.new_scene_versions(n.withColumn("current_version", F.col("scene_id")), versions, asked)[0]


@query("""SELECT artifact_id, sha256('extract' || chr(10) || least(content_hash, mime_type) || chr(10) || greatest(content_hash, mime_type) || chr(10) || sha256(type) || chr(10) || '1.0' || chr(10) || 'abc') AS cache_key,
sha256('p|1|abc|' || sha256(type) || '|' || least(content_hash, mime_type) || '|' || greatest(content_hash, mime_type) || '|') AS pipeline_hash, 'p/s/output' AS placeholder FROM artifacts""")
def task_keys(spark, d):
    refs, cfg = F.array("content_hash", "mime_type"), F.col("type")
    return fx.artifacts(spark, d).select(
        "artifact_id", ids.cache_key(F.lit("extract"), refs, F.sha2(cfg, 256), F.lit("1.0"), F.lit("abc")).alias("cache_key"),
        ids.pipeline_hash(F.lit("p"), F.lit("1"), F.lit("abc"), cfg, refs).alias("pipeline_hash"), ids.placeholder_ref(F.lit("p"), F.lit("s")).alias("placeholder"),
    )


def uuid5_sql(name: str) -> str:
    h = f"sha1(unhex('{ids.NAMESPACE.replace('-', '')}') || encode({name}))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


_IDS = f""", named AS (SELECT o.observation_id, {uuid5_sql('CAST(o.sensor_id AS VARCHAR)')} || '|' || o.timestamp_ns || '|' || a.content_hash AS n
FROM observations o JOIN artifacts a ON a.artifact_id = o.artifact_ref) """


@query(_IDS + f"SELECT observation_id, {uuid5_sql(chr(39) + 'frame|' + chr(39) + ' || n')} AS frame_uuid, {uuid5_sql(chr(39) + 'observation|' + chr(39) + ' || n')} AS observation_uuid FROM named")
def derived_ids(spark, d):
    sensor = ids.uuid5(F.col("sensor_id").cast("string"))
    o = scene.resolve_hashes(fx.observations(spark, d), fx.artifacts(spark, d)).where("failure is null")
    return o.select(
        "observation_id", ids.entity_id("frame", sensor, F.col("timestamp_ns"), F.col("content_hash")).alias("frame_uuid"),
        ids.entity_id("observation", sensor, F.col("timestamp_ns"), F.col("content_hash")).alias("observation_uuid"),
    )


_TO_ROOT = """, up(frame_id, depth, qz, qw, tx, ty) AS (SELECT frame_id, 0, qz, qw, tx, ty FROM frame_tree WHERE parent_id IS NULL UNION ALL
SELECT c.frame_id, depth + 1, u.qw * c.qz + u.qz * c.qw, u.qw * c.qw - u.qz * c.qz, u.tx + (1 - 2 * u.qz * u.qz) * c.tx - 2 * u.qz * u.qw * c.ty,
u.ty + 2 * u.qz * u.qw * c.tx + (1 - 2 * u.qz * u.qz) * c.ty FROM frame_tree c JOIN up u ON c.parent_id = u.frame_id) """


def _tree(spark, d):
    t = fx.frame_tree(spark, d)
    return t.select("frame_id", "parent_id", g.col(g.pose(g.quat(0, 0, F.col("qz"), F.col("qw")), g.vec(F.col("tx"), F.col("ty"), 0))).alias("pose"))


@query(_TO_ROOT + "SELECT frame_id, depth, round(qz, 6) AS qz, round(qw, 6) AS qw, round(tx, 6) AS tx, round(ty, 6) AS ty FROM up")
def frame_graph_to_root(spark, d):
    r = graph.transforms_to_root(_tree(spark, d))
    return r.select("frame_id", "depth", *[F.round(F.col(f"pose.{a}.{b}"), 6).alias(f"{a}{b}") for a, b in (("q", "z"), ("q", "w"), ("t", "x"), ("t", "y"))])


@query(_TO_ROOT + """SELECT s.frame_id, round(tx + (1 - 2 * s.qz * s.qz) * 1 - 2 * s.qz * s.qw * 2, 5) AS x, round(ty + 2 * s.qz * s.qw * 1 + (1 - 2 * s.qz * s.qz) * 2, 5) AS y,
3.0 AS z, 0.0 AS back FROM up s""")
def point_in_root(spark, d):
    p = g.vec(1, 2, 3)
    r = graph.transforms_to_root(_tree(spark, d)).withColumn("p", g.col(g.transform_point(F.col("pose"), p)))
    there = g.transform_point(g.invert(F.col("pose")), F.col("p"))
    miss = F.abs(there.x - 1) + F.abs(there.y - 2) + F.abs(there.z - 3)
    return r.select("frame_id", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"), F.round("p.z", 5).alias("z"), F.round(miss, 6).alias("back"))


@query("""SELECT trajectory_id, count(*) AS node_count, round(coalesce(sum(step), 0), 4) AS total_distance, max(timestamp_ns) - min(timestamp_ns) AS duration_ns FROM
(SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM pose_nodes WINDOW w AS (PARTITION BY trajectory_id ORDER BY timestamp_ns, event_id)) GROUP BY trajectory_id""")
def path_length(spark, d):
    out = trajectory.path_length(fx.pose_nodes(spark, d), "trajectory_id", ["timestamp_ns", "event_id"], ["x", "y"])
    return out.withColumn("total_distance", F.round("total_distance", 4))


@query("""SELECT trajectory_id, round(avg(m), 6) AS mean_correction, round(max(m), 6) AS max_correction FROM
(SELECT trajectory_id, sqrt((x - x * 1.01) ** 2 + (y - (y + 1)) ** 2) AS m FROM pose_nodes) GROUP BY trajectory_id""")
def node_corrections(spark, d):
    p = fx.pose_nodes(spark, d)
    after = p.withColumns({"x": F.col("x") * 1.01, "y": F.col("y") + 1})
    out = trajectory.corrections(p, after, ["trajectory_id", "event_id"], ["x", "y"])
    return out.select("trajectory_id", F.round("mean_correction", 6).alias("mean_correction"), F.round("max_correction", 6).alias("max_correction"))


@query("""SELECT candidate_id, source, target, score FROM (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY score DESC, candidate_id) AS rn
FROM (SELECT l_orderkey * 10 + l_linenumber AS candidate_id, l_partkey % 50 AS source, l_suppkey % 50 AS target, CAST(l_discount AS DOUBLE) AS score FROM lineitem) WHERE score >= 0.05) WHERE rn = 1""")
def accepted_loop_closures(spark, d):
    c = fx.raw(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("candidate_id"), (F.col("l_partkey") % 50).alias("source"), (F.col("l_suppkey") % 50).alias("target"), F.col("l_discount").cast("double").alias("score"))
    return trajectory.best_closures(c, 0.05)


_CLOSURE = """, reach(node) AS (SELECT CAST({start} AS BIGINT) UNION SELECT e.parent FROM {edges} e JOIN reach r ON e.child = r.node) SELECT node FROM reach"""


@query(_CLOSURE.format(start=199, edges="artifact_edges"))
def provenance_closure(spark, d):
    start = spark.range(199, 200).select(F.col("id").alias("node"))
    return graph.closure(fx.artifact_edges(spark, d), start).select("node")


@query(""", lv(node, level) AS (SELECT task_id, 0 FROM tasks UNION SELECT e.child, l.level + 1 FROM lv l JOIN task_edges e ON e.parent = l.node)
SELECT node, max(level) AS level FROM lv GROUP BY node""")
def task_levels(spark, d):
    return graph.longest_levels(fx.tasks(spark, d).select(F.col("task_id").alias("node")), fx.task_edges(spark, d))


@query("""SELECT task_id FROM tasks t WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM task_edges e LEFT JOIN tasks p ON p.task_id = e.parent
WHERE e.child = t.task_id AND (p.status IS NULL OR p.status <> 'succeeded'))""")
def ready_tasks(spark, d):
    return tasks.ready(fx.tasks(spark, d).select("task_id", "status"), fx.task_edges(spark, d))


@query(""", spread(node) AS (SELECT task_id FROM tasks WHERE status IN ('failed', 'cancelled', 'skipped') UNION SELECT e.child FROM spread s JOIN task_edges e ON e.parent = s.node
JOIN tasks t ON t.task_id = e.child WHERE t.status = 'pending') SELECT t.task_id AS node, CASE WHEN t.status = 'pending' AND s.node IS NOT NULL THEN 'skipped' ELSE t.status END AS status
FROM tasks t LEFT JOIN spread s ON s.node = t.task_id""")
def failure_propagation(spark, d):
    return graph.spread_failure(fx.tasks(spark, d).select(F.col("task_id").alias("node"), "status"), fx.task_edges(spark, d))


@query("""SELECT job_id, CASE WHEN bool_or(status = 'cancelled') THEN 'cancelled' WHEN bool_or(status <> 'succeeded') THEN 'failed' ELSE 'succeeded' END AS status FROM tasks GROUP BY job_id""")
def job_status(spark, d):
    return tasks.reduce_status(fx.tasks(spark, d), "job_id")


@query("SELECT t.job_id, e.child, e.parent FROM task_edges e JOIN tasks t ON t.task_id = e.child")
def dependencies_by_job(spark, d):
    return fx.task_edges(spark, d).join(fx.tasks(spark, d).select("job_id", F.col("task_id").alias("child")), "child").select("job_id", "child", "parent")


@query("SELECT t.task_id, count(r.task_id) = 0 AS cache_hit, count(r.task_id) AS runs FROM tasks t LEFT JOIN task_runs r ON r.task_id = t.task_id AND r.attempt > 3 GROUP BY t.task_id")
def cache_hit_flags(spark, d):
    runs = fx.task_runs(spark, d).where("attempt > 3").groupBy("task_id").agg(F.count("*").alias("runs"))
    out = fx.tasks(spark, d).join(runs, "task_id", "left")
    return out.select("task_id", F.col("runs").isNull().alias("cache_hit"), F.coalesce("runs", F.lit(0)).cast("long").alias("runs"))


@query("""SELECT task_id, attempt, order_id, prev, status FROM (SELECT *, lag(status) OVER (PARTITION BY task_id ORDER BY attempt, order_id, status) AS prev FROM
(SELECT task_id, attempt, order_id, CASE l_returnflag WHEN 'A' THEN 'running' WHEN 'N' THEN 'failed' ELSE 'pending' END AS status FROM task_runs))
WHERE prev IS NOT NULL AND prev || '>' || status NOT IN ('pending>running', 'pending>cancelled', 'pending>skipped', 'pending>failed', 'running>succeeded', 'running>failed', 'running>cancelled', 'failed>pending')""")
def illegal_transitions(spark, d):
    status = F.when(F.col("l_returnflag") == "A", "running").when(F.col("l_returnflag") == "N", "failed").otherwise("pending")
    log = fx.task_runs(spark, d).withColumn("status", status)
    return tasks.illegal_history(log, "task_id", ["attempt", "order_id", "status"]).select("task_id", "attempt", "order_id", "prev", "status")


@query("""SELECT p_partkey AS task_id FROM part WHERE NOT ((p_size <= 30 AND p_partkey % 7 <= 4) OR (p_size <= 45 AND p_partkey % 7 <= 1))""")
def infeasible_tasks(spark, d):
    t = fx.raw(spark, d, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_size").alias("cpu_cores"), (F.col("p_partkey") % 7).alias("memory_bytes"), *[F.lit(0).alias(c) for c in tasks.NEEDS[2:]])
    profiles = spark.createDataFrame([(30, 4, 0, 0, 0), (45, 1, 0, 0, 0)], ", ".join(f"{c} long" for c in tasks.NEEDS))
    return tasks.infeasible(t, profiles).select("task_id")


@query("""SELECT l_partkey AS task_id, l_linenumber AS attempt, round(least(1000 * 2.0 ** (l_linenumber - 1), 30000), 3) AS delay_ms FROM lineitem""")
def retry_backoff(spark, d):
    return fx.raw(spark, d, "lineitem").select(F.col("l_partkey").alias("task_id"), F.col("l_linenumber").alias("attempt"), F.round(scoring.backoff(F.col("l_linenumber"), 1000, 2, 30000), 3).alias("delay_ms"))


_METRICS = """, m AS (SELECT l_suppkey AS run, 1.5 * avg(CAST(l_discount AS DOUBLE)) * 10 AS rmse, 100.0 * avg(CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0 END) AS complete, avg(CAST(l_tax AS DOUBLE)) * 10 AS conf FROM lineitem GROUP BY l_suppkey),
sc AS (SELECT run, 50 * greatest(0, least(1, 1 - rmse / 1.5)) + 30 * greatest(0, least(1, complete / 100)) + 20 * greatest(0, least(1, conf)) AS score FROM m) """


@query(_METRICS + "SELECT run, round(score, 4) AS score, CASE WHEN score >= 45 THEN 'pass' WHEN score >= 35 THEN 'warn' ELSE 'fail' END AS verdict FROM sc")
def quality_verdicts(spark, d):
    li = fx.raw(spark, d, "lineitem")
    m = li.groupBy(F.col("l_suppkey").alias("run")).agg(
        (1.5 * F.avg(F.col("l_discount").cast("double")) * 10).alias("rmse"), (100.0 * F.avg(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0))).alias("complete"), (F.avg(F.col("l_tax").cast("double")) * 10).alias("conf"))
    cfg = F.lit('{"config": {"quality": {"thresholds": {"pass": 45, "warn": 35.0}}}}')
    s = m.select("run", scoring.quality_score(F.col("rmse"), F.col("complete"), F.col("conf")).alias("score"), scoring.thresholds(cfg).alias("t"))
    return s.select("run", F.round("score", 4).alias("score"), scoring.verdict(F.col("score"), F.col("t.pass"), F.col("t.warn")).alias("verdict"))


# splitmix64 in 128-bit integers, modulo 2**64
_DRAWS = """, seed AS (SELECT artifact_id, ('0x' || substr(sha256(content_hash || '|quality|{}|' || least(mime_type, content_hash) || '|' || greatest(mime_type, content_hash)), 1, 16))::UBIGINT AS s FROM artifacts),
z0 AS (SELECT artifact_id, i, ((s::UHUGEINT + 11400714819323198485::UHUGEINT * i::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM seed, range(1, 6) r(i)),
z1 AS (SELECT artifact_id, i, ((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM z0),
z2 AS (SELECT artifact_id, i, ((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM z1),
u AS (SELECT artifact_id, i, (xor(z, z >> 31) >> 11)::DOUBLE / 9007199254740992::DOUBLE AS u FROM z2),
w AS (SELECT artifact_id, max(u) FILTER (i = 1) AS a, max(u) FILTER (i = 2) AS b, max(u) FILTER (i = 3) AS c, max(u) FILTER (i = 4) AS e, max(u) FILTER (i = 5) AS f FROM u GROUP BY artifact_id)
SELECT artifact_id, 0.2::DOUBLE + 1.3::DOUBLE * a AS rmse_px, 0.7::DOUBLE * (0.2::DOUBLE + 1.3::DOUBLE * a) AS mean_error_px, 80 + 20 * b AS completeness_pct, 0.2::DOUBLE + 0.3::DOUBLE * c AS baseline_ratio,
30000 + 30000 * e AS point_count, 0.5::DOUBLE + 0.5::DOUBLE * f AS mean_confidence FROM w"""


@query(_DRAWS)
def mock_quality_reports(spark, d):
    seed = ids.run_seed(F.col("content_hash"), F.lit("quality"), F.lit("{}"), F.array("mime_type", "content_hash"))
    return fx.artifacts(spark, d).select("artifact_id", scoring.mock_metrics(seed).alias("m")).select("artifact_id", "m.*")


@query("""SELECT frame_id, 'confidence' AS rule FROM frames WHERE sequence_index / 40.0 > 1 UNION ALL SELECT frame_id, 'position' FROM frames WHERE frame_id % 9 = 0""")
def schema_violations(spark, d):
    f = fx.frames(spark, d).withColumns({"confidence": F.col("sequence_index") / 40.0, "xyz": F.when(F.col("frame_id") % 9 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))})
    return validate.violations(f, "frame_id", {"confidence": validate.within("confidence", 0, 1), "position": validate.sized("xyz", 3)})


@query("""SELECT o_custkey AS scene_id, count(*) AS edge_count, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS odometry_count,
sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS loop_closure_count, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS prior_count FROM orders GROUP BY o_custkey""")
def pose_graph_edge_counts(spark, d):
    kind = F.when(F.col("o_orderstatus") == "O", "odometry").when(F.col("o_orderstatus") == "F", "loop_closure").otherwise("prior")
    return trajectory.edge_counts(fx.raw(spark, d, "orders").select(F.col("o_custkey").alias("scene_id"), kind.alias("type")), "scene_id")


@query("""SELECT l_orderkey AS point3d_id, count(*) AS observations, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS images FROM lineitem GROUP BY l_orderkey""")
def point_tracks(spark, d):
    li = fx.raw(spark, d, "lineitem")
    ref = F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ",")
    return li.groupBy(F.col("l_orderkey").alias("point3d_id")).agg(F.count("*").alias("observations"), ref.alias("images"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    return calibrated_captures(spark, d)
