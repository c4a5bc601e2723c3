"""Domain tables of a capture project, laid over the raw tables.

Each function takes (spark, dir) and returns one lazy DataFrame; nothing is inferred
or collected. DOMAIN_SQL states the same definitions once more for DuckDB.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000_000


def raw(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nanos(ts: str) -> Column:
    """Nanoseconds of a time without zone, read as UTC whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz")) * 1000


def _at(ns: int) -> Column:
    return F.lit(datetime.fromtimestamp(ns // 10**9, timezone.utc).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def events(spark: SparkSession, d: str, between: tuple[int, int] | None = None) -> DataFrame:
    """between: whole seconds (as nanoseconds) that bound the stored time, so that the scan can skip row groups; rows outside go."""
    e = raw(spark, d, "events")
    if between:
        kind = dict(e.dtypes)["ts"]
        e = e.where((F.col("ts") >= _at(between[0]).cast(kind)) & (F.col("ts") < _at(between[1]).cast(kind)))
    return e.select(
        "event_id", "user_id", "event_type", "value", nanos("ts").alias("t"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), F.dayofyear("ts").alias("day"),
    )


def frames(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("session_id", F.col("user_id") * 1000 + F.col("day"))
    w = Window.partitionBy("session_id").orderBy("t", "event_id")
    return e.select(
        F.col("event_id").alias("frame_id"), F.col("user_id").alias("sensor_id"), (F.col("user_id") % 25).alias("scene_id"), "session_id",
        F.col("t").alias("timestamp_ns"), (F.row_number().over(w) - 1).cast("long").alias("sequence_index"),
    )


def observations(spark: SparkSession, d: str, between: tuple[int, int] | None = None) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])
    return events(spark, d, between).select(
        F.col("event_id").alias("observation_id"), F.col("event_id").alias("frame_id"), F.col("user_id").alias("sensor_id"),
        (F.col("user_id") % 25).alias("scene_id"), (F.col("user_id") * 1000 + F.col("day")).alias("session_id"),
        F.col("t").alias("timestamp_ns"), kind[F.col("event_type")].alias("type"), (F.col("event_id") % 1200).alias("artifact_ref"),
    )


#: Which event stands for which kind of observation.
KINDS = {"view": "image", "click": "lidar", "error": "imu", "purchase": "gnss", "signup": "depth"}


def payloads(spark: SparkSession, d: str) -> DataFrame:
    fmt = F.when(F.col("k") % 3 == 0, "rgb8").when(F.col("k") % 3 == 1, "gray8").otherwise("rgba16")
    return events(spark, d).where("event_id % 5 <> 0").select(
        F.col("event_id").alias("observation_id"), (640 + 8 * F.col("k")).alias("width"), (480 + 6 * F.col("k")).alias("height"), fmt.alias("pixel_format")
    )


def calibrations(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = events(spark, d).where("event_type = 'purchase'").withColumns({"nxt": F.lead("t").over(w), "version": F.row_number().over(w).cast("long")})
    return e.select(
        F.col("event_id").alias("calibration_id"), F.col("user_id").alias("sensor_id"), "version", F.col("t").alias("valid_from_ns"),
        F.when(F.col("nxt").isNotNull(), F.least("nxt", F.col("t") + 36 * HOUR)).alias("valid_to_ns"),
    )


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d, "documents").select(
        F.col("doc_id").alias("artifact_id"), F.sha2("text", 256).alias("content_hash"), F.col("source").alias("type"),
        F.col("lang").alias("mime_type"), F.col("n_chars").cast("long").alias("file_size"), F.col("doc_id").alias("seq"),
    )


def halves(df: DataFrame, key: str) -> DataFrame:
    """Edges (parent, child) from every key to its half and its third."""
    k = F.col(key)
    both = F.array(F.floor(k / 2).cast("long"), F.floor(k / 3).cast("long"))
    return df.select(F.explode(F.array_distinct(both)).alias("parent"), k.cast("long").alias("child")).where("parent <> child")


def artifact_edges(spark: SparkSession, d: str) -> DataFrame:
    return halves(raw(spark, d, "documents").select("doc_id"), "doc_id")


def task_edges(spark: SparkSession, d: str) -> DataFrame:
    return halves(raw(spark, d, "part").select("p_partkey"), "p_partkey")


#: The states of a task.
STATES = ("pending", "running", "succeeded", "failed", "cancelled", "skipped")


def tasks(spark: SparkSession, d: str) -> DataFrame:
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.col("p_size") % 6 + 1).cast("int"))
    return raw(spark, d, "part").select(F.col("p_partkey").cast("long").alias("task_id"), (F.col("p_partkey") % 40).cast("long").alias("job_id"), state.alias("status"))


def task_runs(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d, "lineitem").select(
        F.col("l_partkey").cast("long").alias("task_id"), F.col("l_orderkey").cast("long").alias("order_id"),
        F.col("l_linenumber").cast("long").alias("attempt"), "l_returnflag",
    )


def trajectories(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "building").when(F.col("o_orderstatus") == "F", "optimized").otherwise("superseded")
    return raw(spark, d, "orders").select(
        F.col("o_orderkey").cast("long").alias("trajectory_id"), F.col("o_custkey").cast("long").alias("session_id"),
        F.col("o_orderdate").alias("created_at"), status.alias("status"),
    )


def reconstructions(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "reconstructing").otherwise("failed")
    return raw(spark, d, "orders").select(
        F.col("o_orderkey").cast("long").alias("reconstruction_id"), F.col("o_custkey").cast("long").alias("scene_id"),
        F.col("o_orderdate").alias("created_at"), status.alias("status"),
    )


def pose_nodes(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.col("user_id").alias("trajectory_id"), "event_id", F.col("t").alias("timestamp_ns"), F.col("value").alias("x"), F.col("k").cast("double").alias("y"))


def frame_tree(spark: SparkSession, d: str) -> DataFrame:
    """root -> region -> nation -> supplier: id, parent, rotation about z by 0.1 * key, translation."""
    part = lambda df, key, id_, parent: df.select(
        id_.alias("frame_id"), parent.alias("parent_id"), F.sin(F.col(key) * 0.05).alias("qz"), F.cos(F.col(key) * 0.05).alias("qw"),
        F.col(key).cast("double").alias("tx"), (F.col(key) / 2).cast("double").alias("ty"),
    )
    name = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    root = spark.range(1).select(F.lit("root").alias("frame_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0.0).alias("qz"), F.lit(1.0).alias("qw"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"))
    r = part(raw(spark, d, "region"), "r_regionkey", name("r", "r_regionkey"), F.lit("root"))
    n = part(raw(spark, d, "nation"), "n_nationkey", name("n", "n_nationkey"), name("r", "n_regionkey"))
    s = part(raw(spark, d, "supplier"), "s_suppkey", name("s", "s_suppkey"), name("n", "s_nationkey"))
    return root.unionByName(r).unionByName(n).unionByName(s)


DOMAIN_SQL = """
WITH RECURSIVE ev AS (SELECT event_id, user_id, event_type, value, epoch_ns(ts) AS t, dayofyear(ts) AS day,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
frames AS (SELECT event_id AS frame_id, user_id AS sensor_id, user_id % 25 AS scene_id, user_id * 1000 + day AS session_id, t AS timestamp_ns,
  row_number() OVER (PARTITION BY user_id * 1000 + day ORDER BY t, event_id) - 1 AS sequence_index FROM ev),
observations AS (SELECT event_id AS observation_id, event_id AS frame_id, user_id AS sensor_id, user_id % 25 AS scene_id,
  user_id * 1000 + day AS session_id, t AS timestamp_ns, CASE event_type WHEN 'view' THEN 'image' WHEN 'click' THEN 'lidar'
  WHEN 'error' THEN 'imu' WHEN 'purchase' THEN 'gnss' WHEN 'signup' THEN 'depth' END AS type, event_id % 1200 AS artifact_ref FROM ev),
payloads AS (SELECT event_id AS observation_id, 640 + 8 * k AS width, 480 + 6 * k AS height,
  CASE k % 3 WHEN 0 THEN 'rgb8' WHEN 1 THEN 'gray8' ELSE 'rgba16' END AS pixel_format FROM ev WHERE event_id % 5 <> 0),
calibrations AS (SELECT event_id AS calibration_id, user_id AS sensor_id, row_number() OVER w AS version, t AS valid_from_ns,
  CASE WHEN lead(t) OVER w IS NOT NULL THEN least(lead(t) OVER w, t + 36 * 3600000000000) END AS valid_to_ns
  FROM ev WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
artifacts AS (SELECT doc_id AS artifact_id, sha256(text) AS content_hash, source AS type, lang AS mime_type, CAST(n_chars AS BIGINT) AS file_size,
  doc_id AS seq FROM documents),
artifact_edges AS (SELECT DISTINCT doc_id // x AS parent, doc_id AS child FROM documents, (VALUES (2), (3)) v(x) WHERE doc_id // x <> doc_id),
task_edges AS (SELECT DISTINCT CAST(p_partkey // x AS BIGINT) AS parent, CAST(p_partkey AS BIGINT) AS child FROM part, (VALUES (2), (3)) v(x) WHERE p_partkey // x <> p_partkey),
tasks AS (SELECT CAST(p_partkey AS BIGINT) AS task_id, CAST(p_partkey % 40 AS BIGINT) AS job_id,
  ['pending', 'running', 'succeeded', 'failed', 'cancelled', 'skipped'][CAST(p_size % 6 + 1 AS INTEGER)] AS status FROM part),
task_runs AS (SELECT CAST(l_partkey AS BIGINT) AS task_id, CAST(l_orderkey AS BIGINT) AS order_id, CAST(l_linenumber AS BIGINT) AS attempt, l_returnflag FROM lineitem),
trajectories AS (SELECT CAST(o_orderkey AS BIGINT) AS trajectory_id, CAST(o_custkey AS BIGINT) AS session_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'O' THEN 'building' WHEN 'F' THEN 'optimized' ELSE 'superseded' END AS status FROM orders),
reconstructions AS (SELECT CAST(o_orderkey AS BIGINT) AS reconstruction_id, CAST(o_custkey AS BIGINT) AS scene_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'reconstructing' ELSE 'failed' END AS status FROM orders),
pose_nodes AS (SELECT user_id AS trajectory_id, event_id, t AS timestamp_ns, value AS x, CAST(k AS DOUBLE) AS y FROM ev),
frame_tree AS (SELECT 'root' AS frame_id, NULL AS parent_id, 0.0::DOUBLE AS qz, 1.0::DOUBLE AS qw, 0.0::DOUBLE AS tx, 0.0::DOUBLE AS ty
  UNION ALL SELECT 'r' || r_regionkey, 'root', sin(r_regionkey * 0.05::DOUBLE), cos(r_regionkey * 0.05::DOUBLE), r_regionkey, r_regionkey / 2 FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, sin(n_nationkey * 0.05::DOUBLE), cos(n_nationkey * 0.05::DOUBLE), n_nationkey, n_nationkey / 2 FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, sin(s_suppkey * 0.05::DOUBLE), cos(s_suppkey * 0.05::DOUBLE), s_suppkey, s_suppkey / 2 FROM supplier)
"""
