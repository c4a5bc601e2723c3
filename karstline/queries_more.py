"""Further registered queries: lookups, mutations on repeated keys, frame graphs, task graphs, imports, documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import geometry as g
from .functions import identity as ids
from .functions import scoring
from .operators import documents, graph, imports, scene, store, tasks, temporal, trajectory, validate
from .plans import fixtures as fx
from .queries import _CLOSURE, _TO_ROOT, Q, SQL, _tree, query, uuid5_sql

__all__ = ["Q", "SQL"]


def _lookup(name: str, table, sql_table: str, columns: list[str], order: list[str], **equal) -> None:
    """Register a read by equality: scene.lookup over a domain table."""
    where = " AND ".join(f"{k} = {v!r}" for k, v in equal.items())

    def run(spark, d):
        return scene.lookup(table(spark, d), order, **equal).select(*columns)

    run.__name__ = name
    query(f"SELECT {', '.join(columns)} FROM {sql_table}" + (f" WHERE {where}" if where else ""))(run)


def _of(table: str, *columns: str):
    """A domain table by expressions that mean the same in Spark and in DuckDB, and its SQL."""
    return (lambda spark, d: fx.raw(spark, d, table).selectExpr(*columns)), f"(SELECT {', '.join(columns)} FROM {table})"


SCENES = _of("nation", "n_nationkey AS scene_id", "n_regionkey AS project_id", "CASE WHEN n_nationkey % 3 = 0 THEN 'closed' ELSE 'open' END AS status")
VERSIONS = _of("orders", "o_orderkey AS version_id", "o_custkey AS scene_id", "o_orderdate AS created_at")
GRAPHS = _of("orders", "o_orderkey AS pose_graph_id", "o_custkey % 100 AS trajectory_id", "o_custkey % 25 AS scene_id", "o_orderdate AS created_at")
CLOSURES = _of(
    "lineitem", "l_orderkey * 10 + l_linenumber AS closure_id", "l_suppkey AS trajectory_id", "CAST(l_discount AS DOUBLE) AS score", "l_shipdate AS created_at",
    "CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'candidate' END AS status",
)
RESULTS = _of("orders", "o_orderkey AS result_id", "o_custkey % 100 AS trajectory_id", "o_orderdate AS created_at", "CAST(o_totalprice AS DOUBLE) AS initial_error", "CAST(o_totalprice AS DOUBLE) * (o_orderkey % 10) / 10 AS final_error")
STAGES = _of("lineitem", "l_orderkey AS manifest_id", "l_linenumber AS sequence", "l_returnflag AS stage", "l_suppkey AS task_id")
MANIFESTS = _of("orders", "o_orderkey AS manifest_id", "o_orderdate AS created_at", "o_orderstatus AS status")
FEATURES = _of("embeddings", "vec_id AS feature_set_id", "vec_id % 200 AS frame_id", "label AS detector", "CASE WHEN vec_id % 3 = 0 THEN 'binary' ELSE 'float' END AS descriptor_type")
SENSORS = _of("supplier", "s_suppkey AS sensor_id", "s_nationkey AS rig_id")
CACHE = _of("part", "p_partkey AS cache_key", "p_size AS task_id", "p_type AS content_hash")

_lookup("frames_all", fx.frames, "frames", ["frame_id", "scene_id", "timestamp_ns", "sequence_index"], scene.FRAME_ORDER)
_lookup("frames_by_session", fx.frames, "frames", ["frame_id", "timestamp_ns", "sequence_index"], scene.FRAME_ORDER, session_id=11010)
_lookup("scene_version_by_id", VERSIONS[0], VERSIONS[1], ["version_id", "scene_id"], ["version_id"], version_id=7)
_lookup("scene_versions_by_scene", VERSIONS[0], VERSIONS[1], ["version_id", "created_at"], ["created_at", "version_id"], scene_id=7)
_lookup("feature_sets_by_frame", FEATURES[0], FEATURES[1], ["feature_set_id", "detector", "descriptor_type"], ["detector", "descriptor_type", "feature_set_id"], frame_id=17)
_lookup("reconstructions_by_scene", fx.reconstructions, "reconstructions", ["reconstruction_id", "status"], ["created_at", "reconstruction_id"], scene_id=7)
_lookup("trajectories_by_session", fx.trajectories, "trajectories", ["trajectory_id", "status"], ["created_at", "trajectory_id"], session_id=7)
_lookup("pose_graphs_by_trajectory", GRAPHS[0], GRAPHS[1], ["pose_graph_id", "scene_id"], ["created_at", "pose_graph_id"], trajectory_id=7)
_lookup("pose_graphs_by_scene", GRAPHS[0], GRAPHS[1], ["pose_graph_id", "trajectory_id"], ["created_at", "pose_graph_id"], scene_id=7)
_lookup("closure_candidates_by_trajectory", CLOSURES[0], CLOSURES[1], ["closure_id", "score"], ["created_at", "closure_id"], trajectory_id=7, status="candidate")
_lookup("loop_closures_by_trajectory", CLOSURES[0], CLOSURES[1], ["closure_id", "score", "status"], ["created_at", "closure_id"], trajectory_id=7)
_lookup("closures_with_status_accepted", CLOSURES[0], CLOSURES[1], ["closure_id", "score"], ["created_at", "closure_id"], trajectory_id=7, status="accepted")
_lookup("optimization_results_by_trajectory", RESULTS[0], RESULTS[1], ["result_id", "created_at"], ["created_at", "result_id"], trajectory_id=7)
_lookup("tasks_by_job", fx.tasks, "tasks", ["task_id", "status"], ["task_id"], job_id=7)
_lookup("runs_by_task", fx.task_runs, "task_runs", ["order_id", "attempt"], ["attempt", "order_id"], task_id=7)
_lookup("cache_entry_by_key", CACHE[0], CACHE[1], ["cache_key", "content_hash"], ["cache_key"], cache_key=7)
_lookup("manifest_ids", MANIFESTS[0], MANIFESTS[1], ["manifest_id", "created_at"], ["-created_at", "manifest_id"])


@query("SELECT c_custkey * 1000 + 10 AS session_id, EXISTS (SELECT 1 FROM frames f WHERE f.session_id = c_custkey * 1000 + 10) AS known FROM customer")
def session_exists(spark, d):
    asked = fx.raw(spark, d, "customer").selectExpr("cast(c_custkey * 1000 + 10 as long) AS session_id")
    return scene.exists_flag(asked, fx.frames(spark, d), "session_id", "known")


@query("SELECT o.o_orderkey AS observation_id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = o.o_orderkey)")
def observations_missing(spark, d):
    asked = fx.raw(spark, d, "orders").selectExpr("cast(o_orderkey as long) AS observation_id")
    return store.missing(asked, fx.observations(spark, d), "observation_id")


@query(f"SELECT project_id, min(scene_id) AS scene_id FROM {SCENES[1]} WHERE status = 'open' GROUP BY project_id")
def scene_by_project(spark, d):
    return scene.latest(SCENES[0](spark, d), ["project_id"], [F.col("scene_id").asc()], "status = 'open'").select("project_id", "scene_id")


@query("""SELECT session_id, sequence_index, frame_id, timestamp_ns + 5 AS rejected_at_ns FROM frames JOIN ev ON event_id = frame_id WHERE event_type = 'error' AND session_id // 1000 % 4 = 1""")
def rejections_by_session(spark, d):
    """Audit rows of the sessions that are asked for, by place in the session, then by time of the rejection."""
    bad = fx.observations(spark, d).where("type = 'imu'").select("frame_id")
    log = fx.frames(spark, d).join(bad, "frame_id", "left_semi").withColumn("rejected_at_ns", F.col("timestamp_ns") + 5)
    asked = log.where("session_id div 1000 % 4 = 1").select("session_id").distinct()
    return scene.lookup(log.join(asked, "session_id", "left_semi"), ["session_id", "sequence_index", "rejected_at_ns"]).select("session_id", "sequence_index", "frame_id", "rejected_at_ns")


@query("""SELECT task_id, status, p_size AS cpu_cores, p_brand AS tool, len(p_type) AS n_inputs FROM tasks JOIN part ON p_partkey = task_id WHERE job_id = 7""")
def task_specs_by_job(spark, d):
    """The specification that a job's tasks carry as JSON, decoded."""
    spec = F.to_json(F.struct(F.struct(F.col("p_size").alias("cpu_cores")).alias("resources"), F.col("p_brand").alias("tool"), F.split("p_type", "").alias("inputs")))
    specs = fx.raw(spark, d, "part").select(F.col("p_partkey").cast("long").alias("task_id"), spec.alias("spec_json"))
    rows = scene.lookup(fx.tasks(spark, d), ["task_id"], job_id=7).join(specs, "task_id")
    out = documents.read_task_spec(F.col("spec_json"))
    return rows.select("task_id", "status", out["resources"]["cpu_cores"].alias("cpu_cores"), out["tool"].alias("tool"), F.size(out["inputs"]).alias("n_inputs"))


@query(f"SELECT trajectory_id, pose_graph_id FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY created_at DESC, pose_graph_id DESC) AS rn FROM {GRAPHS[1]}) WHERE rn = 1")
def latest_pose_graph(spark, d):
    return scene.latest(GRAPHS[0](spark, d), ["trajectory_id"], [F.col("created_at").desc(), F.col("pose_graph_id").desc()]).select("trajectory_id", "pose_graph_id")


@query(f"SELECT trajectory_id, result_id FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY created_at DESC, result_id DESC) AS rn FROM {RESULTS[1]}) WHERE rn = 1")
def latest_optimization(spark, d):
    return scene.latest(RESULTS[0](spark, d), ["trajectory_id"], [F.col("created_at").desc(), F.col("result_id").desc()]).select("trajectory_id", "result_id")


@query(f"SELECT manifest_id, string_agg(sequence || ':' || stage, ',' ORDER BY sequence, stage) AS stages FROM {STAGES[1]} GROUP BY manifest_id")
def manifest_stages(spark, d):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "stage"))), lambda x: F.concat_ws(":", x["sequence"], x["stage"])), ",")
    return STAGES[0](spark, d).groupBy("manifest_id").agg(text.alias("stages"))


# -- mutations, on logs that repeat their keys

WRITES = _of("events", "user_id AS artifact_id", "CAST(round(value) AS BIGINT) AS content_hash", "event_id AS seq")


@query(f""", log AS (SELECT *, max(seq) OVER (PARTITION BY artifact_id) AS i, max(seq) OVER (PARTITION BY content_hash) AS h FROM {WRITES[1]})
SELECT artifact_id, content_hash, seq FROM log WHERE seq = i AND seq = h""")
def artifact_log_replay(spark, d):
    return store.artifact_index(WRITES[0](spark, d))


@query("""SELECT s_suppkey AS task_id, coalesce(n.status, 'old') AS status, 'first' AS created FROM supplier LEFT JOIN
(SELECT l_suppkey, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS status FROM lineitem WHERE l_quantity < 5 GROUP BY l_suppkey) n ON n.l_suppkey = s_suppkey""")
def upsert_repeated_tasks(spark, d):
    old = fx.raw(spark, d, "supplier").selectExpr("s_suppkey AS task_id", "'old' AS status", "'first' AS created")
    new = fx.raw(spark, d, "lineitem").where("l_quantity < 5").selectExpr("l_suppkey AS task_id", "l_returnflag AS status", "'later' AS created", "l_orderkey * 10 + l_linenumber AS seq")
    return store.upsert(old, new, ["task_id"], keep=["created"], seq="seq")


@query("""SELECT s_suppkey AS sensor_id, CASE WHEN n.f IS NULL THEN s_name WHEN n.f = 'N' THEN NULL ELSE n.f END AS label FROM supplier LEFT JOIN
(SELECT l_suppkey, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS f FROM lineitem WHERE l_quantity < 3 GROUP BY l_suppkey) n ON n.l_suppkey = s_suppkey""")
def update_repeated_sensors(spark, d):
    old = fx.raw(spark, d, "supplier").selectExpr("s_suppkey AS sensor_id", "s_name AS label")
    new = fx.raw(spark, d, "lineitem").where("l_quantity < 3").selectExpr("l_suppkey AS sensor_id", "if(l_returnflag = 'N', '', l_returnflag) AS label", "l_orderkey * 10 + l_linenumber AS seq")
    return store.update_fields(old, new, "sensor_id", seq="seq")


@query("""SELECT sensor_id, rig_id, CASE WHEN sensor_id % 3 = 0 OR n > 1 THEN 'refused' ELSE 'added' END AS outcome FROM
(SELECT l_suppkey AS sensor_id, l_partkey AS rig_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_quantity < 6)""")
def register_sensors(spark, d):
    """Every registration of a log: the first of a sensor that is not there yet comes in, all others are refused."""
    known = SENSORS[0](spark, d).where("sensor_id % 3 = 0")
    log = fx.raw(spark, d, "lineitem").where("l_quantity < 6").selectExpr("l_suppkey AS sensor_id", "l_partkey AS rig_id", "l_orderkey * 10 + l_linenumber AS seq")
    snapshot, refused = store.append_unique(known.select("sensor_id", "rig_id", F.lit(0).alias("seq")), log, ["sensor_id"], "seq")
    added = snapshot.where("sensor_id % 3 <> 0")
    return added.select("sensor_id", "rig_id", F.lit("added").alias("outcome")).unionByName(refused.select("sensor_id", "rig_id", F.lit("refused").alias("outcome")))


@query("""SELECT count(*) FILTER (event_id % 3 = 0 OR n = 1) AS stays, count(*) AS every FROM (SELECT event_id, row_number() OVER (PARTITION BY event_id % 3 = 0, user_id, k ORDER BY event_id) AS n FROM ev)""")
def observations_inserted(spark, d):
    """A batch of observations with repeated (sensor, k) keys against an empty table: how many come in, of how many."""
    e = fx.events(spark, d)
    keyed = e.select(F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("own"), F.when(F.col("event_id") % 3 != 0, F.struct("user_id", "k")).alias("shared"), "event_id")
    keyed = keyed.select(F.xxhash64("own", "shared.user_id", "shared.k").alias("observation_id"), "event_id")
    new, _ = store.append_unique(keyed.limit(0), keyed, ["observation_id"], "event_id")
    return new.agg(F.count("*").alias("stays")).crossJoin(e.agg(F.count("*").alias("every")))  # one row each


@query("SELECT l_partkey AS input, l_suppkey AS output, max(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY l_partkey, l_suppkey")
def dependency_edges_replayed(spark, d):
    return store.keep_last(fx.raw(spark, d, "lineitem").selectExpr("l_partkey AS input", "l_suppkey AS output", "l_orderkey * 10 + l_linenumber AS seq"), ["input", "output"])


_FOUND = f"""SELECT c_custkey % 8 AS project_id, coalesce(min(s.scene_id), c_custkey % 8 + 900) AS scene_id, min(s.scene_id) IS NULL AS created FROM customer
LEFT JOIN {SCENES[1]} s ON s.project_id = c_custkey % 8 AND s.status = 'open' GROUP BY c_custkey % 8"""


def _found(spark, d):
    asked = fx.raw(spark, d, "customer").selectExpr("c_custkey % 8 AS project_id").distinct()
    return store.find_or_create_scenes(SCENES[0](spark, d), asked, F.col("project_id") + 900)


@query(_FOUND)
def scenes_found_or_created(spark, d):
    return _found(spark, d)[0]


@query(f"SELECT scene_id || ':1' AS version_id, scene_id, 1::BIGINT AS version, NULL AS parent_version, project_id, 'open' AS status FROM ({_FOUND}) WHERE created")
def first_scene_versions(spark, d):
    """Versions that come with new scenes, each the current one of its scene."""
    _, scenes, versions = _found(spark, d)
    both = versions.join(scenes.withColumnRenamed("current_version", "version_id"), ["scene_id", "version_id"])
    return both.select("version_id", "scene_id", "version", "parent_version", "project_id", "status")


@query("""SELECT content_hash, count(*) AS instances, content_hash IN (SELECT content_hash FROM artifacts WHERE artifact_id % 5 <> 1) AS stays FROM artifacts GROUP BY content_hash""")
def garbage_collected(spark, d):
    """What is stored after a collection, and what is gone."""
    a = fx.artifacts(spark, d)
    stored = a.groupBy("content_hash").agg(F.count("*").alias("instances"))
    stays, gone = store.collect_garbage(stored, a.where("artifact_id % 5 <> 1"), "content_hash")
    return stays.withColumn("stays", F.lit(True)).unionByName(gone.withColumn("stays", F.lit(False)))


@query("""SELECT event_id, EXISTS (SELECT 1 FROM documents WHERE doc_id = event_id % 1500) AS stored FROM events""")
def payload_instances(spark, d):
    asked = fx.raw(spark, d, "events").selectExpr("event_id", "event_id % 1500 AS content_hash")
    new, refused = store.put_instance(fx.raw(spark, d, "documents").selectExpr("doc_id AS content_hash"), asked)
    return new.select("event_id", F.lit(True).alias("stored")).unionByName(refused.select("event_id", F.lit(False).alias("stored")))


@query("SELECT doc_id AS artifact_id, CASE WHEN doc_id % 10 = 3 THEN 'degraded' ELSE 'valid' END AS validation_status FROM documents")
def integrity_scan(spark, d):
    files = fx.raw(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("name"), F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary").alias("content"))
    bad = store.verify(files, F.col("name")).select(F.col("doc_id").alias("artifact_id"))
    index = fx.raw(spark, d, "documents").selectExpr("doc_id AS artifact_id", "'valid' AS validation_status")
    return store.quarantine(index, bad, "artifact_id")


@query("SELECT count(DISTINCT content_hash) AS payloads, count(*) AS instances FROM artifacts")
def payload_count(spark, d):
    return fx.artifacts(spark, d).agg(F.count_distinct("content_hash").alias("payloads"), F.count("*").alias("instances"))


@query("SELECT p_partkey AS manifest_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 47)")
def dangling_manifests(spark, d):
    have = fx.raw(spark, d, "part").selectExpr("p_partkey AS manifest_id")
    return store.dangling(have, fx.raw(spark, d, "lineitem").where("l_quantity > 47").selectExpr("l_partkey AS manifest_id"), "manifest_id")


# -- frame graphs

_BROKEN = """, broken AS (SELECT CAST(p_partkey AS BIGINT) AS frame_id, CAST(CASE WHEN p_partkey = 1 THEN NULL WHEN p_partkey % 50 = 0 THEN p_partkey + 1000000 WHEN p_partkey % 77 = 0 THEN p_partkey
WHEN p_partkey % 78 = 0 THEN p_partkey + 1 WHEN p_partkey % 78 = 1 THEN p_partkey - 1 ELSE p_partkey // 2 END AS BIGINT) AS parent_id FROM part),
rooted(f) AS (SELECT frame_id FROM broken WHERE parent_id IS NULL UNION SELECT b.frame_id FROM broken b JOIN rooted r ON b.parent_id = r.f),
loose(f) AS (SELECT frame_id FROM broken WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT frame_id FROM broken) UNION SELECT b.frame_id FROM broken b JOIN loose r ON b.parent_id = r.f) """


def _broken(spark, d):
    k = F.col("frame_id")
    up = F.when(k == 1, None).when(k % 50 == 0, k + 1000000).when(k % 77 == 0, k).when(k % 78 == 0, k + 1).when(k % 78 == 1, k - 1).otherwise(F.floor(k / 2))
    return fx.raw(spark, d, "part").select(F.col("p_partkey").cast("long").alias("frame_id")).withColumn("parent_id", up.cast("long"))


@query(_BROKEN + "SELECT frame_id, CASE WHEN frame_id IN (SELECT f FROM loose) THEN 'dangling' ELSE 'cycle' END AS problem FROM broken WHERE frame_id NOT IN (SELECT f FROM rooted)")
def frame_graph_problems(spark, d):
    return graph.frame_problems(_broken(spark, d))


@query("""SELECT 'broken' AS graph, false AS valid, 'cycle' AS reason UNION ALL SELECT 'tree', true, NULL UNION ALL SELECT 'empty', false, 'empty' UNION ALL SELECT 'two', false, 'multiple_roots'""")
def frame_graph_validation(spark, d):
    t = fx.frame_tree(spark, d).select("frame_id", "parent_id")
    cases = {"broken": _broken(spark, d), "tree": t, "empty": t.where("false"), "two": t.unionByName(t.where("parent_id is null").withColumn("frame_id", F.lit("second")))}
    out = [graph.validate_frames(x).select(F.lit(name).alias("graph"), "valid", "reason") for name, x in cases.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


# Frames in a shuffled order: parents in the batch or before it, unknown ones, repeated ids. The SQL adds row after row to a list of ids.
_BATCH = """, batch AS (SELECT row_number() OVER (ORDER BY (k * 7919) % 10007, k, c) AS i, 's' || k AS frame_id,
CASE WHEN (k + c) % 11 = 1 THEN 'nowhere' WHEN (k + c) % 13 = 2 THEN NULL WHEN (k + c) % 3 = 0 THEN 's' || (k // 2) ELSE 'n' || ((k + c) % 25) END AS parent_id
FROM (SELECT s_suppkey AS k FROM supplier), (VALUES (0), (1)) v(c) WHERE c = 0 OR k % 3 = 1),
steps(i, ids, frame_id, parent_id, error) AS (SELECT 0::BIGINT, list_concat(['root'], (SELECT list('n' || n_nationkey) FROM nation WHERE n_nationkey < 20)), NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR UNION ALL
SELECT b.i, CASE WHEN list_contains(ids, b.frame_id) OR (b.parent_id IS NOT NULL AND NOT list_contains(ids, b.parent_id)) THEN ids ELSE list_append(ids, b.frame_id) END, b.frame_id, b.parent_id,
CASE WHEN list_contains(ids, b.frame_id) THEN 'exists' WHEN b.parent_id IS NOT NULL AND NOT list_contains(ids, b.parent_id) THEN 'parent_not_found' END FROM steps s JOIN batch b ON b.i = s.i + 1) """


def _added(spark, d):
    n, k = F.col("k") + F.col("c"), F.col("k")
    up = F.when(n % 11 == 1, "nowhere").when(n % 13 == 2, None).when(n % 3 == 0, F.concat(F.lit("s"), F.floor(k / 2))).otherwise(F.concat(F.lit("n"), n % 25))
    rows = fx.raw(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("c")).where("c = 0 or k % 3 = 1")
    rows = rows.select(((k * 7919) % 10007 * 10**6 + k * 2 + F.col("c")).alias("seq"), F.concat(F.lit("s"), k).alias("frame_id"), up.alias("parent_id"))
    known = fx.frame_tree(spark, d).where("frame_id = 'root' or (startswith(frame_id, 'n') and cast(substr(frame_id, 2) as int) < 20)")
    return graph.add_frames(known, rows, "seq")


@query(_BATCH + "SELECT frame_id, parent_id, error FROM steps WHERE error IS NOT NULL")
def frames_refused(spark, d):
    return _added(spark, d)[1].select("frame_id", "parent_id", "error")


@query(_BATCH + "SELECT frame_id, parent_id FROM steps WHERE i > 0 AND error IS NULL")
def frames_added(spark, d):
    return _added(spark, d)[0].select("frame_id", "parent_id")


# The tree of suppliers, and beside it: a chain under an unknown frame, a cycle of three and a frame below it. Every pose beside it is a step of 1 along x.
_BESIDE = [("loose1", "nowhere"), ("loose2", "loose1"), ("loose3", "loose2"), ("ring1", "ring2"), ("ring2", "ring3"), ("ring3", "ring1"), ("tail", "ring1")]
_ENDS = ["root", "loose1", "loose3", "ring1", "ring3", "tail", "nowhere", "unheard"]


@query(_TO_ROOT + f""", beside(x, y) AS (VALUES {', '.join(map(repr, _BESIDE))}),
edge(x, y) AS (SELECT frame_id, parent_id FROM frame_tree WHERE parent_id IS NOT NULL UNION ALL SELECT x, y FROM beside), ids(x) AS (SELECT frame_id FROM frame_tree UNION ALL SELECT x FROM beside),
climb(x, y, n) AS (SELECT x, y, 1 FROM edge UNION SELECT c.x, e.y, n + 1 FROM climb c JOIN edge e ON e.x = c.y WHERE n < 12), above AS (SELECT x, y, min(n) AS n FROM climb WHERE y IN (SELECT x FROM ids) AND x <> y GROUP BY x, y),
pairs AS (SELECT 's' || s_suppkey AS frm, CASE s_suppkey % 4 WHEN 0 THEN 's' || s_suppkey WHEN 1 THEN 'root' WHEN 2 THEN 'n' || s_nationkey ELSE 'r' || (s_suppkey % 5) END AS dst FROM supplier UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
  UNION ALL SELECT a.x, b.x FROM (SELECT unnest({_ENDS!r}) AS x) a, (SELECT unnest({_ENDS!r}) AS x) b),
judged AS (SELECT p.frm, p.dst, d.n AS down, u.n AS up, CASE WHEN p.frm = p.dst THEN NULL WHEN p.frm NOT IN (SELECT x FROM ids) OR p.dst NOT IN (SELECT x FROM ids) THEN 'not_found' WHEN d.x IS NOT NULL THEN NULL
  WHEN p.dst IN ('ring1', 'ring2', 'ring3', 'tail') THEN 'cycle' WHEN u.x IS NOT NULL THEN NULL WHEN p.frm IN ('ring1', 'ring2', 'ring3', 'tail') THEN 'cycle' ELSE 'disconnected' END AS error
  FROM pairs p LEFT JOIN above d ON d.x = p.dst AND d.y = p.frm LEFT JOIN above u ON u.x = p.frm AND u.y = p.dst)
SELECT j.frm, j.dst, CASE WHEN error IS NULL THEN CASE WHEN f.frame_id IS NULL OR t.frame_id IS NULL THEN 0 ELSE round(-f.qz * t.qw + f.qw * t.qz, 6) END END AS qz,
CASE WHEN error IS NULL THEN CASE WHEN j.frm = j.dst THEN 0 WHEN f.frame_id IS NULL OR t.frame_id IS NULL THEN coalesce(down, -up) ELSE round((1 - 2 * f.qz * f.qz) * (t.tx - f.tx) + 2 * f.qz * f.qw * (t.ty - f.ty), 4) END END AS tx, error
FROM judged j LEFT JOIN up f ON f.frame_id = j.frm LEFT JOIN up t ON t.frame_id = j.dst""")
def frame_transform_pairs(spark, d):
    """Transforms of pairs up, down, equal, unknown, of other branches, and around a cycle: one row each."""
    step = g.col(g.pose(g.quat(0, 0, 0, 1), g.vec(1, 0, 0))).alias("pose")
    tree = _tree(spark, d).unionByName(spark.createDataFrame(_BESIDE, "frame_id string, parent_id string").select("*", step))
    k, s = F.col("s_suppkey"), fx.raw(spark, d, "supplier")
    dst = F.when(k % 4 == 0, F.concat(F.lit("s"), k)).when(k % 4 == 1, "root").when(k % 4 == 2, F.concat(F.lit("n"), "s_nationkey")).otherwise(F.concat(F.lit("r"), k % 5))
    few = [(a, b) for a in _ENDS for b in _ENDS]
    pairs = s.select(F.concat(F.lit("s"), k).alias("frm"), dst.alias("dst")).unionByName(s.select(F.concat(F.lit("n"), "s_nationkey").alias("frm"), F.concat(F.lit("s"), k).alias("dst"))).unionByName(spark.createDataFrame(few, "frm string, dst string"))
    out = graph.frame_transform(tree, pairs)
    return out.select("frm", "dst", F.round("pose.q.z", 6).alias("qz"), F.round("pose.t.x", 4).alias("tx"), "error")


@query(_CLOSURE.format(start=23, edges="(SELECT CAST(n_nationkey // 2 AS BIGINT) AS parent, CAST(n_nationkey AS BIGINT) AS child FROM nation WHERE n_nationkey > 0)"))
def scene_version_lineage(spark, d):
    edges = fx.raw(spark, d, "nation").where("n_nationkey > 0").selectExpr("cast(n_nationkey div 2 as long) AS parent", "cast(n_nationkey as long) AS child")
    return graph.closure(edges, spark.range(23, 24).select(F.col("id").alias("node"))).select("node")


# -- task graphs

INPUTS = _of("lineitem", "l_partkey AS task_id", "CONCAT('ref', l_suppkey % 40) AS ref")
OUTPUTS = _of("part", "p_partkey AS task_id", "CONCAT('ref', p_partkey % 40) AS ref")


@query(f""", ins AS (SELECT DISTINCT * FROM {INPUTS[1]}), made AS (SELECT e.child AS task_id, o.ref, count(*) AS n FROM task_edges e JOIN {OUTPUTS[1]} o ON o.task_id = e.parent GROUP BY ALL)
SELECT i.task_id, i.ref, CASE WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS error FROM ins i LEFT JOIN made m USING (task_id, ref) WHERE n > 1 OR (n IS NULL AND i.ref NOT IN ('ref1', 'ref2', 'ref3'))""")
def task_input_errors(spark, d):
    external = spark.createDataFrame([("ref1",), ("ref2",), ("ref3",)], "ref string")
    return tasks.input_errors(INPUTS[0](spark, d).distinct(), OUTPUTS[0](spark, d), fx.task_edges(spark, d), external)


@query(f"SELECT i.task_id, CASE WHEN n_nationkey IS NULL THEN i.ref ELSE n_name END AS ref FROM {INPUTS[1]} i LEFT JOIN nation ON 'ref' || n_nationkey = i.ref")
def task_inputs_resolved(spark, d):
    made = fx.raw(spark, d, "nation").select(F.concat(F.lit("ref"), "n_nationkey").alias("placeholder"), F.col("n_name").alias("ref"))
    return tasks.resolve_inputs(INPUTS[0](spark, d), made)


@query("""SELECT p_partkey AS task_id, array_to_string(list_sort(list_filter(['gpu', 'cpu', p_brand], lambda x: x NOT IN ('cpu', 'Brand#11', 'Brand#12', 'Brand#13'))), ',') AS missing FROM part""")
def missing_capabilities(spark, d):
    need, have = F.array(F.lit("gpu"), F.lit("cpu"), "p_brand"), F.array(*[F.lit(x) for x in ("cpu", "Brand#11", "Brand#12", "Brand#13")])
    return fx.raw(spark, d, "part").select(F.col("p_partkey").alias("task_id"), F.array_join(tasks.missing_capabilities(need, have), ",").alias("missing"))


@query("""SELECT task_id, status IN ('succeeded', 'failed', 'cancelled', 'skipped') AS terminal, CASE WHEN status = 'running' THEN 'pending' ELSE status END AS status,
CASE WHEN status = 'running' THEN 0 ELSE job_id END AS attempts FROM tasks""")
def tasks_resumed(spark, d):
    t = fx.tasks(spark, d).select("task_id", "status", F.col("job_id").alias("attempts"), tasks.terminal(F.col("status")).alias("terminal"))
    return tasks.resume(t)


@query(f"""SELECT p_partkey AS task_id, p_size % 2 = 0 AND p_size % 3 <> 0 AND EXISTS (SELECT 1 FROM {CACHE[1]} c WHERE c.cache_key = p_partkey + 3 AND c.content_hash LIKE 'STANDARD%') AS cache_hit FROM part""")
def cache_lookup(spark, d):
    t = fx.raw(spark, d, "part").selectExpr("p_partkey AS task_id", "p_partkey + 3 AS cache_key", "p_size % 2 = 0 AS deterministic", "p_size % 3 <> 0 AS cacheable")
    c = CACHE[0](spark, d)
    return tasks.cache_hits(t, c, c.where("content_hash like 'STANDARD%'").select("content_hash")).select("task_id", "cache_hit")


@query("""SELECT count(*) AS tasks, false AS cyclic FROM tasks""")
def task_graph_validation(spark, d):
    t = fx.tasks(spark, d)
    placed = graph.longest_levels(t.select(F.col("task_id").alias("node")), fx.task_edges(spark, d))
    return placed.agg(F.count("*").alias("tasks")).crossJoin(t.agg(F.count("*").alias("every"))).select("tasks", (F.col("tasks") < F.col("every")).alias("cyclic"))


@query("""SELECT t.job_id, (SELECT count(*) FROM tasks x WHERE x.job_id = t.job_id) AS tasks, (SELECT count(*) FROM task_edges e JOIN tasks x ON x.task_id = e.child WHERE x.job_id = t.job_id) AS edges FROM (SELECT DISTINCT job_id FROM tasks) t""")
def task_graph_documents(spark, d):
    t, e = documents.read_task_graph(documents.task_graph_json(fx.tasks(spark, d), fx.task_edges(spark, d)))
    t, e = t.groupBy("job_id").agg(F.count("*").alias("tasks")), e.groupBy("job_id").agg(F.count("*").alias("edges"))
    return t.join(e, "job_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)).cast("long"))


# -- identity, geometry, time, trajectories

@query(f"SELECT artifact_id, {uuid5_sql(chr(39) + 'feature_set|' + chr(39) + ' || type || ' + chr(39) + '|' + chr(39) + ' || content_hash')} AS feature_set_id FROM artifacts")
def feature_set_ids(spark, d):
    return fx.artifacts(spark, d).select("artifact_id", ids.feature_set_id(F.col("type"), F.col("content_hash")).alias("feature_set_id"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '0000000a-0000-4000-8000-00000000000f' END AS uuid FROM documents""")
def uuids_parsed(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, "0000000A-0000-4000-8000-00000000000f").when(F.col("doc_id") % 3 == 1, "0000000A00004000800000000000000f").otherwise("g000000a-0000-4000-8000-00000000000f")
    return fx.raw(spark, d, "documents").select("doc_id", ids.parse_uuid(text).alias("uuid"))


@query("""SELECT artifact_id, sha256('{"allow":"' || mime_type || '","importer":"images","version":1}') AS config_hash FROM artifacts""")
def importer_config_hash(spark, d):
    config = ids.canonical_config({"version": F.lit(1), "allow": F.col("mime_type"), "importer": F.lit("images")})
    return fx.artifacts(spark, d).select("artifact_id", ids.sha256(config).alias("config_hash"))


@query("""SELECT event_id, round(cos(value / 20), 6) AS r00, round(-sin(value / 20), 6) AS r01, round(abs(sin(value / 40)), 6) AS z, round(abs(cos(value / 40)), 6) AS w, 1.0::DOUBLE AS norm FROM events""")
def rotation_round_trip(spark, d):
    q = g.from_axis_angle(g.vec(0, 0, 1), F.col("value") / 20)
    e = fx.raw(spark, d, "events").select("event_id", g.to_matrix4(g.pose(q, g.vec(1, 2, 3))).alias("m"))
    back = g.from_matrix4(F.col("m")).q
    m = F.col("m")
    return e.select("event_id", F.round(m[0][0], 6).alias("r00"), F.round(m[0][1], 6).alias("r01"), F.round(F.abs(back.z), 6).alias("z"), F.round(F.abs(back.w), 6).alias("w"), F.round(g.norm(g.normalize(back)), 6).alias("norm"))


@query("""SELECT event_id, round(-cos(value / 10), 6) AS x, round(sin(value / 10), 6) AS y, 0.5::DOUBLE AS inverse_norm FROM events""")
def camera_poses(spark, d):
    """World-from-camera of a rotation about z by value / 10 and the translation (1, 0, 0); the inverse of a quaternion of length 2 has length 1/2."""
    half = F.col("value") / 20
    rot = F.array(F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half))
    pose = g.camera_pose(rot, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    long = g.quat(0, 0, 2 * F.sin(half), 2 * F.cos(half))
    return fx.raw(spark, d, "events").select("event_id", F.round(pose.t.x, 6).alias("x"), F.round(pose.t.y, 6).alias("y"), F.round(g.norm(g.inverse(long)), 6).alias("inverse_norm"))


@query("""SELECT frame_id, timestamp_ns + 5 * sensor_id - 5 * scene_id AS there, timestamp_ns AS back, timestamp_ns + 1500000000 AS later FROM frames""")
def clock_offsets(spark, d):
    t, a, b = F.col("timestamp_ns"), 5 * F.col("sensor_id"), -5 * F.col("scene_id")
    there = temporal.synchronized(t, temporal.composed(a, b))
    back = temporal.synchronized(there, temporal.negated(temporal.composed(a, b)))
    return fx.frames(spark, d).select("frame_id", there.alias("there"), back.alias("back"), (t + temporal.duration(seconds=1, milliseconds=500)).alias("later"))


@query(f"""SELECT result_id, round((initial_error - final_error) / initial_error, 6) AS error_reduction FROM {RESULTS[1]}""")
def error_reductions(spark, d):
    return trajectory.error_reduction(RESULTS[0](spark, d)).select("result_id", F.round("error_reduction", 6).alias("error_reduction"))


@query(""", n AS (SELECT user_id, event_id, value AS x, k AS y, 0.05 * k AS yaw, lag(event_id) OVER w AS before, lag(value) OVER w AS px, lag(k) OVER w AS py, 0.05 * lag(k) OVER w AS pyaw FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
e AS (SELECT user_id, cos(pyaw) * (x - px) + sin(pyaw) * (y - py) AS tx, cos(pyaw) * (y - py) - sin(pyaw) * (x - px) AS ty, yaw - pyaw AS turn, 0.01 * (event_id % 5) AS dx, 0.001 * (event_id % 7) AS dyaw FROM n WHERE before IS NOT NULL)
SELECT user_id, count(*) AS n_edges, round(sqrt(avg(dx * dx)), 6) AS translation_rms, round(sqrt(avg(degrees(dyaw) ** 2)), 6) AS rotation_rms_deg FROM e GROUP BY user_id""")
def pose_edge_consistency(spark, d):
    """Odometry edges of each user, measured with a known error, against the poses of their nodes."""
    e = fx.events(spark, d)
    yaw = 0.05 * F.col("k")
    nodes = e.select("user_id", "event_id", "t", g.col(g.pose(g.quat(0, 0, F.sin(yaw / 2), F.cos(yaw / 2)), g.vec(F.col("value"), F.col("k"), 0))).alias("pose"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    edges = nodes.select("user_id", F.lag("event_id").over(w).alias("source"), F.col("event_id").alias("target"), F.lag("pose").over(w).alias("before"), "pose").where("source is not null")
    off, k = 0.001 * (F.col("target") % 7), F.col("target")
    true = g.compose(g.invert(F.col("before")), F.col("pose"))
    # the measured motion, of which the error is a step along its own x and a turn about z
    wrong = g.invert(g.pose(g.quat(0, 0, F.sin(off / 2), F.cos(off / 2)), g.vec(0.01 * (k % 5), 0, 0)))
    edges = edges.select("user_id", "source", "target", g.col(g.compose(true, wrong)).alias("motion"))
    out = trajectory.edge_consistency(edges, nodes, "user_id", "event_id")
    return out.select("user_id", "n_edges", F.round("translation_rms", 6).alias("translation_rms"), F.round("rotation_rms_deg", 6).alias("rotation_rms_deg"))


_NEAR = """, c AS (SELECT o_orderkey AS candidate_id, o_custkey % 50 AS trajectory_id, o_custkey % 97 AS source, o_orderkey % 89 AS target, floor(CAST(o_totalprice AS DOUBLE) / 10000) AS score FROM orders),
o AS (SELECT *, source * 10 AS s_ns, target * 10 AS t_ns, least(source, target) * 10 AS early, greatest(source, target) * 10 AS late, row_number() OVER (PARTITION BY trajectory_id ORDER BY score DESC, candidate_id) AS i FROM c),
pick(trajectory_id, i, taken, candidate_id, good) AS (SELECT DISTINCT trajectory_id, 0::BIGINT, [{'e': -1000000::BIGINT, 'l': -1000000::BIGINT}], NULL::BIGINT, NULL::BOOLEAN FROM o UNION ALL
SELECT o.trajectory_id, o.i, CASE WHEN len(list_filter(taken, lambda x: abs(x.e - o.early) <= 30 AND abs(x.l - o.late) <= 30)) > 0 THEN taken ELSE list_append(taken, {'e': o.early::BIGINT, 'l': o.late::BIGINT}) END,
o.candidate_id, len(list_filter(taken, lambda x: abs(x.e - o.early) <= 30 AND abs(x.l - o.late) <= 30)) = 0 FROM pick p JOIN o ON o.trajectory_id = p.trajectory_id AND o.i = p.i + 1) """


@query(_NEAR + "SELECT trajectory_id, candidate_id, CASE WHEN good THEN 'accepted' ELSE 'rejected' END AS status FROM pick WHERE i > 0")
def closures_without_near_duplicates(spark, d):
    c = fx.raw(spark, d, "orders").selectExpr(
        "o_orderkey AS candidate_id", "o_custkey % 50 AS trajectory_id", "o_custkey % 97 AS source", "o_orderkey % 89 AS target", "cast(floor(cast(o_totalprice as double) / 10000) as double) AS score")
    c = c.withColumns({"source_ns": F.col("source") * 10, "target_ns": F.col("target") * 10})
    return trajectory.distinct_closures(c, "trajectory_id", 30).select("trajectory_id", "candidate_id", "status")


@query(f"""SELECT p.trajectory_id, round(mean_uncertainty, 6) AS mean_uncertainty, round(max_uncertainty, 6) AS max_uncertainty, round(coalesce(n, 0) / nullif(dist, 0), 6) AS closure_density FROM
(SELECT trajectory_id, avg(abs(y)) AS mean_uncertainty, max(abs(y)) AS max_uncertainty, sum(step) AS dist FROM (SELECT *, abs(x - lag(x) OVER w) AS step FROM pose_nodes WINDOW w AS (PARTITION BY trajectory_id ORDER BY timestamp_ns, event_id)) GROUP BY trajectory_id) p
LEFT JOIN (SELECT trajectory_id, count(*) AS n FROM {CLOSURES[1]} WHERE status = 'accepted' GROUP BY trajectory_id) c USING (trajectory_id)""")
def trajectory_uncertainty(spark, d):
    nodes = fx.pose_nodes(spark, d).withColumn("uncertainty", F.abs("y"))
    out = trajectory.uncertainty(nodes, CLOSURES[0](spark, d).where("status = 'accepted'"), "trajectory_id", ["timestamp_ns", "event_id"], ["x"])
    return out.select("trajectory_id", *[F.round(c, 6).alias(c) for c in ("mean_uncertainty", "max_uncertainty", "closure_density")])


# -- imports and documents

_FILES = """, files AS (SELECT user_id AS session_id, 'u' || (event_id * 7 % 13) || '/' || event_id AS uri, event_id AS pos, user_id % 60 AS sensor_id, CASE WHEN event_id % 17 = 0 THEN 0 ELSE t - t % 3600000000000 END AS timestamp_ns,
sha256(CAST(event_id % 40 AS VARCHAR)) AS content_hash, event_id % 29 <> 0 AS readable, event_id % 23 <> 0 AS allowed, k AS width, 480 AS height, 'rgb8' AS pixel_format FROM ev),
ordered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY uri, pos) - 1 AS sequence_index, CASE WHEN NOT readable THEN 'Unreadable' WHEN NOT allowed THEN 'UnsupportedFormat' WHEN coalesce(width, 0) < 1 THEN 'Corrupt'
WHEN sensor_id >= 50 THEN 'SensorUnresolved' WHEN timestamp_ns = 0 THEN 'TimestampUnresolvable' END AS error FROM files) """


def _files(spark, d):
    e = fx.events(spark, d)
    k = F.col("event_id")
    return e.select(
        F.col("user_id").alias("session_id"), F.concat(F.lit("u"), k * 7 % 13, F.lit("/"), k).alias("uri"), k.alias("pos"), (F.col("user_id") % 60).alias("sensor_id"),
        F.when(k % 17 == 0, F.lit(0)).otherwise(F.col("t") - F.col("t") % fx.HOUR).cast("long").alias("timestamp_ns"), F.sha2((k % 40).cast("string"), 256).alias("content_hash"),
        (k % 29 != 0).alias("readable"), (k % 23 != 0).alias("allowed"), F.col("k").alias("width"), F.lit(480).alias("height"), F.lit("rgb8").alias("pixel_format"),
    )


def _imported(spark, d):
    sensors = spark.range(50).select(F.col("id").alias("sensor_id"))
    none = spark.createDataFrame([], "observation_id string")
    stored = spark.range(10).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    return imports.import_batch(_files(spark, d), sensors, fx.calibrations(spark, d), none, stored)


@query(_FILES + "SELECT session_id, sequence_index, uri, error FROM ordered WHERE error IS NOT NULL")
def import_rejections(spark, d):
    return _imported(spark, d)[1]


@query(_FILES + f""", good AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, timestamp_ns, content_hash ORDER BY session_id, sequence_index) > 1 AS reimported FROM ordered WHERE error IS NULL)
SELECT uri, sequence_index, {uuid5_sql("'frame|' || " + uuid5_sql("CAST(sensor_id AS VARCHAR)") + " || '|' || timestamp_ns || '|' || content_hash")} AS frame_id, reimported,
NOT EXISTS (SELECT 1 FROM calibrations c WHERE c.sensor_id = g.sensor_id AND c.valid_from_ns <= g.timestamp_ns AND (c.valid_to_ns IS NULL OR g.timestamp_ns < c.valid_to_ns)) AS uncalibrated,
NOT reimported AND (content_hash IN (SELECT sha256(CAST(i AS VARCHAR)) FROM range(10) r(i)) OR coalesce(sum(CASE WHEN reimported THEN 0 ELSE 1 END) OVER (PARTITION BY content_hash ORDER BY session_id, sequence_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0) AS new_instance FROM good g""")
def import_accepted(spark, d):
    return _imported(spark, d)[0].select("uri", "sequence_index", "frame_id", "reimported", "uncalibrated", "new_instance")


@query("""SELECT artifact_id, CASE artifact_id % 5 WHEN 0 THEN 'a,b' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN mime_type ELSE '' END AS refs FROM artifacts""")
def reference_arrays(spark, d):
    k = F.col("artifact_id") % 5
    text = F.when(k == 0, '["a", 1, "b", null]').when(k == 1, "[broken").when(k == 2, '{"a": 1}').when(k == 3, documents.refs_json(F.array("mime_type")))
    return fx.artifacts(spark, d).select("artifact_id", F.array_join(documents.refs(text), ",").alias("refs"))


@query("""SELECT artifact_id, CASE artifact_id % 3 WHEN 0 THEN 'feature_extractor,matcher,mapper' WHEN 1 THEN 'feature_extractor,mapper' ELSE 'matcher' END AS plan FROM artifacts""")
def stage_plans(spark, d):
    k = F.col("artifact_id") % 3
    on = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("mapper"), F.lit("feature_extractor"))).otherwise(F.array(F.lit("matcher"), F.lit("other")))
    return fx.artifacts(spark, d).select("artifact_id", F.array_join(documents.stage_plan(on), ",").alias("plan"))


@query("""SELECT artifact_id, CASE artifact_id % 4 WHEN 1 THEN 'missing verdict' WHEN 2 THEN 'not valid JSON' END AS error, CASE WHEN artifact_id % 4 IN (0, 3) THEN file_size / 8.0::DOUBLE END AS rmse_px,
CASE WHEN artifact_id % 4 IN (0, 3) THEN 'warn' END AS verdict FROM artifacts""")
def quality_report_documents(spark, d):
    zero = [F.lit(0.5).alias(c) for c in ("mean_error_px", "completeness_pct", "baseline_ratio", "point_count", "mean_confidence", "quality_score")]
    a = fx.artifacts(spark, d).select("artifact_id", F.col("content_hash").alias("pipeline_hash"), F.col("type").alias("stage_id"), (F.col("file_size") / 8.0).alias("rmse_px"), *zero,
                                      F.lit("warn").alias("verdict"), F.lit("").alias("generated_at"), *[F.lit("x").alias(f"engine_{c}") for c in ("name", "version", "git_commit")])
    text = documents.report_json(a, F.struct(F.lit(80.0).alias("pass"), F.lit(50.0).alias("warn")))
    k = F.col("artifact_id") % 4
    a = a.withColumn("text", F.when(k == 1, F.regexp_replace(text, '"verdict"', '"other"')).when(k == 2, F.lit("{broken")).otherwise(text))
    report, error = documents.read_report(F.col("text"))
    return a.select("artifact_id", report["rmse_px"].alias("rmse_px"), report["verdict"].alias("verdict"), error.alias("error"))


@query("""SELECT artifact_id, content_hash, '' AS configuration_hash, file_size FROM artifacts""")
def manifest_documents(spark, d):
    a = fx.artifacts(spark, d).select("artifact_id", F.col("artifact_id").cast("string").alias("artifact_uuid"), "content_hash", "type", "file_size", F.lit("").alias("config_hash"))
    manifest, _ = documents.read_manifest(store.manifest_json(a.drop("artifact_id")))
    return a.select("artifact_id", manifest["content_hash"].alias("content_hash"), manifest["configuration_hash"].alias("configuration_hash"), manifest["file_size"].alias("file_size"))


@query("""SELECT calibration_id, sha256('{"calibration_id":' || calibration_id || ',"sensor_id":' || sensor_id || ',"valid_from_ns":' || valid_from_ns || CASE WHEN valid_to_ns IS NULL THEN '' ELSE ',"valid_to_ns":' || valid_to_ns END || ',"version":' || version || '}') AS content_hash FROM calibrations""")
def calibration_artifacts(spark, d):
    return fx.calibrations(spark, d).select("calibration_id", F.sha2(documents.calibration_json(), 256).alias("content_hash"))


@query("""SELECT event_id, rule FROM (SELECT event_id, 'position' AS rule FROM events WHERE event_id % 7 = 0 UNION ALL SELECT event_id, 'rotation' FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, 'covariance' FROM events WHERE event_id % 3 = 0)""")
def pose_node_violations(spark, d):
    k = F.col("event_id")
    part = lambda n, bad: F.when(bad, F.array_repeat(F.lit(1.0), n - 1)).otherwise(F.array_repeat(F.lit(1.0), n))
    nodes = fx.raw(spark, d, "events").select("event_id", part(3, k % 7 == 0).alias("position_xyz"), part(4, k % 5 == 0).alias("rotation_xyzw"), part(6, k % 3 == 0).alias("covariance_position"))
    return validate.violations(nodes, "event_id", validate.pose_node_rules())


@query("""SELECT l_orderkey * 10 + l_linenumber AS edge_id, 'confidence' AS rule FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'hash' FROM lineitem WHERE l_linenumber = 3""")
def edge_violations(spark, d):
    e = fx.raw(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), (F.col("l_quantity") / 40).cast("double").alias("confidence"), F.lit(None).cast("array<double>").alias("information_matrix_6x6"),
        F.when(F.col("l_linenumber") == 3, "no hash").otherwise(F.sha2(F.lit("x"), 256)).alias("content_hash"))
    return validate.violations(e, "edge_id", validate.edge_rules())


_RUNS = """, runs AS (SELECT l_partkey AS task_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS attempt,
CASE WHEN l_quantity > 20 THEN 'succeeded' ELSE 'failed' END AS outcome, l_returnflag <> 'R' AS recoverable FROM lineitem),
last AS (SELECT task_id, min(attempt) AS attempt FROM runs WHERE outcome <> 'failed' OR NOT recoverable OR attempt >= 3 GROUP BY task_id),
done AS (SELECT r.task_id, coalesce(any_value(CASE WHEN r.attempt = l.attempt THEN r.outcome END), 'pending') AS status, coalesce(any_value(l.attempt), max(r.attempt)) AS attempts FROM runs r LEFT JOIN last l USING (task_id) GROUP BY r.task_id) """


def _done(spark, d):
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber")
    runs = fx.raw(spark, d, "lineitem").select(
        F.col("l_partkey").alias("task_id"), F.row_number().over(order).alias("attempt"), F.when(F.col("l_quantity") > 20, "succeeded").otherwise("failed").alias("outcome"), (F.col("l_returnflag") != "R").alias("recoverable"))
    return tasks.dispatched(runs, 3)


@query(_RUNS + "SELECT task_id, status, attempts FROM done")
def task_dispatches(spark, d):
    return _done(spark, d)


@query(_RUNS + """, res AS (SELECT t.task_id, coalesce(d.status, 'succeeded') AS status FROM tasks t LEFT JOIN done d USING (task_id)),
badly(n) AS (SELECT e.child FROM task_edges e JOIN res r ON r.task_id = e.parent AND r.status NOT IN ('succeeded', 'pending') UNION SELECT e.child FROM badly b JOIN task_edges e ON e.parent = b.n),
waits(n) AS (SELECT e.child FROM task_edges e JOIN res r ON r.task_id = e.parent AND r.status = 'pending' UNION SELECT e.child FROM waits b JOIN task_edges e ON e.parent = b.n)
SELECT task_id AS node, CASE WHEN task_id IN (SELECT n FROM badly) THEN 'skipped' WHEN task_id IN (SELECT n FROM waits) THEN 'pending' ELSE status END AS status FROM res""")
def scheduler_run(spark, d):
    t = fx.tasks(spark, d).select("task_id").join(_done(spark, d), "task_id", "left")
    return graph.executed(t.select(F.col("task_id").alias("node"), F.coalesce("status", F.lit("succeeded")).alias("status")), fx.task_edges(spark, d))


@query("SELECT artifact_id, sha256(type || '|{}|' || mime_type || '|' || content_hash) AS payload_hash FROM artifacts")
def mock_payloads(spark, d):
    return fx.artifacts(spark, d).select("artifact_id", ids.sha256(ids.mock_payload(F.col("type"), F.lit("{}"), F.array("mime_type", "content_hash"))).alias("payload_hash"))


@query()
def mock_features(spark, d):
    """Not in SQL: a stream of 64-bit draws a row. Tests hold it against a plain reading."""
    a = fx.artifacts(spark, d).select("artifact_id", scoring.mock_keypoints(F.col("content_hash"), (F.col("artifact_id") % 9).cast("long")).alias("f"))
    return a.select("artifact_id", F.size("f.keypoints").alias("points"), F.sha2(documents.feature_json(F.col("f.keypoints"), F.col("f.descriptors")), 256).alias("content_hash"))
