"""Further registered queries: text and binary formats, schemas and configurations, clocks, error codes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import errors
from .operators import clocks, json_schema
from .operators.graph import shared_folder
from .plans import fixtures as fx
from .plans import schemas
from .queries_more import _FILES, _imported, query
from .queries_space import Q, SQL
from .sources import sparse_source, trajectory_text

__all__ = ["Q", "SQL"]

# A trajectory file a user, of one of three formats; some lines lack a field, hold a word, a zero quaternion, or are of another format.
_TEXT = """, l AS (SELECT 'user' || user_id AS file, event_id AS line_no, t, value, k, event_id AS e, CASE WHEN event_id % 23 = 0 OR user_id % 3 = 0 THEN 'tum' WHEN user_id % 3 = 1 THEN 'kitti' ELSE 'euroc' END AS own FROM ev WHERE event_id % 29 <> 0),
f AS (SELECT file, arg_min(own, line_no) AS format FROM l WHERE e % 17 <> 0 GROUP BY file),
j AS (SELECT l.*, format, CASE WHEN e % 17 = 0 THEN 'fields' WHEN own <> format THEN 'format' WHEN e % 13 = 0 THEN 'number' WHEN e % 19 = 0 THEN 'rotation' END AS reason FROM l JOIN f USING (file)) """


def _lines(spark, d):
    e = fx.events(spark, d)
    k, text = F.col("event_id"), lambda c: c.cast("string")
    own = F.when((k % 23 == 0) | (F.col("user_id") % 3 == 0), "tum").when(F.col("user_id") % 3 == 1, "kitti").otherwise("euroc")
    word = F.when(k % 13 == 0, F.lit("oops")).otherwise(text(F.col("k")))
    w = F.when(k % 19 == 0, "0").otherwise("1")
    seconds = F.concat(text(F.expr("t div 1000000000")), F.lit("."), F.lpad(text(F.col("t") % 10**9), 9, "0"))
    parts = {
        "tum": [seconds, text(F.col("value")), word, F.lit("0.5"), F.lit("0"), F.lit("0"), F.lit("0"), w],
        "kitti": [*[F.lit(x) for x in ("0", "-1", "0")], text(F.col("value")), w, F.lit("0"), F.lit("0"), word, *[F.lit(x) for x in ("0", "0", "1", "0.5")]],
        "euroc": [text(F.col("t")), text(F.col("value")), word, F.lit("0.5"), w, *[F.lit("0")] * 3],
    }
    cut = lambda xs, sep: F.concat_ws(sep, F.slice(F.array(*xs), 1, F.lit(len(xs)) - F.when(k % 17 == 0, 1).otherwise(0)))
    value = F.when(own == "tum", cut(parts["tum"], "  ")).when(own == "kitti", cut(parts["kitti"], "\t")).otherwise(cut(parts["euroc"], ", "))
    value = F.when(k % 29 == 0, F.when(k % 2 == 0, "# timestamp x y").otherwise("")).otherwise(value)
    return e.select(F.concat(F.lit("user"), "user_id").alias("file"), k.alias("line_no"), value.alias("value"))


@query(_TEXT + """SELECT file, line_no, format, CASE WHEN own <> 'kitti' THEN t END AS timestamp_ns, round(value, 6) AS x, k AS y, 0.5::DOUBLE AS z,
CASE WHEN own = 'kitti' THEN round(sqrt(0.5::DOUBLE), 6) ELSE 0 END AS qz, CASE WHEN own = 'kitti' THEN round(sqrt(0.5::DOUBLE), 6) ELSE 1 END AS qw FROM j WHERE reason IS NULL""")
def trajectory_text_poses(spark, d):
    poses, _ = trajectory_text.parse(_lines(spark, d))
    return poses.select("file", "line_no", "format", "timestamp_ns", F.round("t.x", 6).alias("x"), F.col("t.y").alias("y"), F.col("t.z").alias("z"), F.round("q.z", 6).alias("qz"), F.round("q.w", 6).alias("qw"))


@query(_TEXT + "SELECT file, line_no, reason FROM j WHERE reason IS NOT NULL")
def trajectory_text_rejects(spark, d):
    return trajectory_text.parse(_lines(spark, d))[1].select("file", "line_no", "reason")


@query("""SELECT 'm' || l_orderkey % 7 AS model, l_orderkey AS point3d_id, round(l_orderkey / 2.0, 3) AS x, l_orderkey % 256 AS blue, count(*) AS track_length, CAST(sum(l_partkey) AS BIGINT) AS images, CAST(max(l_linenumber) AS BIGINT) AS last_index FROM lineitem GROUP BY l_orderkey""")
def sparse_model_points(spark, d):
    """3-D points written as binary models, one file each, and read back in ranges of bytes."""
    track = F.sort_array(F.collect_list(F.struct(F.col("l_partkey").cast("long").alias("image_id"), F.col("l_linenumber").cast("long").alias("point2d_idx"))))
    p = fx.raw(spark, d, "lineitem").groupBy("l_orderkey").agg(track.alias("track"))
    k = F.col("l_orderkey")
    p = p.select(F.concat(F.lit("m"), k % 7).alias("model"), k.cast("decimal(20,0)").alias("point3d_id"), F.array(k / 2, F.lit(0.0), F.lit(1.0)).alias("xyz"), F.array(F.lit(0), F.lit(1), (k % 256).cast("int")).alias("rgb"), F.lit(0.5).alias("error"), "track")
    base = shared_folder(spark)
    folder = f"{base if ':' in base else 'file://' + base}/models-{uuid.uuid4().hex}"
    sparse_source.save_points(p, folder).write.format("noop").mode("overwrite").save()
    back = sparse_source.read_model(spark, folder, "points3d", rangeBytes=1 << 20)
    images = F.aggregate("track", F.lit(0).cast("long"), lambda a, t: a + t["image_id"])
    return back.select(
        F.regexp_extract("model", "[^/]+$", 0).alias("model"), F.col("point3d_id").cast("long").alias("point3d_id"), F.round(F.col("xyz")[0], 3).alias("x"), F.col("rgb")[2].alias("blue"), F.size("track").alias("track_length"),
        images.alias("images"), F.array_max(F.transform("track", lambda t: t["point2d_idx"])).alias("last_index"))


_BREACHES = """SELECT event_id, '$.schema_version' AS path, 'const' AS rule FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, '$.nodes[1].frame_id', 'required' FROM events WHERE event_id % 7 = 0
UNION ALL SELECT event_id, '$.nodes[0].position_xyz', 'minItems' FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, '$.nodes[0].rotation_xyzw[2]', 'type' FROM events WHERE event_id % 11 = 0
UNION ALL SELECT event_id, '$.nodes[1].extra', 'additionalProperties' FROM events WHERE event_id % 13 = 0 UNION ALL SELECT event_id, '$.trajectory_id', 'format' FROM events WHERE event_id % 17 = 0
UNION ALL SELECT event_id, '$.nodes[1].sequence_index', 'minimum' FROM events WHERE event_id % 19 = 0"""


@query(f"SELECT * FROM ({_BREACHES}) WHERE event_id % 23 <> 0 UNION ALL SELECT event_id, '$', 'json' FROM events WHERE event_id % 23 = 0")
def document_violations(spark, d):
    """Trajectory documents, of which some break the format in one place or several."""
    k = F.col("event_id")
    pick = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    id_ = "123e4567-e89b-42d3-a456-426614174000"
    node = lambda *more: F.concat(F.lit('{"timestamp_ns":'), fx.nanos("ts").cast("string"), *more, F.lit("}"))
    one = node(F.lit(f',"frame_id":"{id_}","sequence_index":0,"position_xyz":'), pick(3, "[1,2]", "[1,2,3.5]"), F.lit(',"rotation_xyzw":[0,0,'), pick(11, '"z"', "0"), F.lit(",1]"))
    two = node(pick(7, "", f',"frame_id":"{id_}"'), F.lit(',"sequence_index":'), pick(19, "-1", "1"), F.lit(',"position_xyz":[0,0,0],"rotation_xyzw":[0,0,0,1]'), pick(13, ',"extra":null', ""))
    text = F.concat(F.lit('{"schema_version":'), pick(5, "2", "1"), F.lit(',"trajectory_id":"'), pick(17, "no id", id_), F.lit('","nodes":['), one, F.lit(","), two, pick(23, "", "]}"))
    return json_schema.all_violations(fx.raw(spark, d, "events").select("event_id", text.alias("text")), "event_id", "text", schemas.TRAJECTORY)


_CONFIG = """SELECT p_partkey, '$.threads' AS path, 'threads' AS rule FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, '$.matcher.max_ratio', 'type' FROM part WHERE p_partkey % 7 = 0
UNION ALL SELECT p_partkey, '$.matcher.deep', 'unknown_key' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, '$.matcher.deep.list[1].fx', 'calibration' FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, '$.enabled_stages[1]', 'duplicate_stage' FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT p_partkey, '$.enabled_stages[2]', 'unknown_stage' FROM part WHERE p_partkey % 13 = 0"""


@query(f"SELECT * FROM ({_CONFIG}) WHERE p_partkey % 17 <> 0 AND p_partkey % 19 <> 0 UNION ALL SELECT p_partkey, '$', 'json' FROM part WHERE p_partkey % 17 = 0 AND p_partkey % 19 <> 0")
def configuration_violations(spark, d):
    """Adapter configurations, plain or in a pipeline's envelope, some broken, some blank, some with calibrations hidden in them."""
    k = F.col("p_partkey")
    pick = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    text = F.concat(
        F.lit('{"threads":'), pick(5, "0", "4"), F.lit(',"seed":"s","matcher":{"max_ratio":'), pick(7, '"high"', "0.8"), pick(3, ',"deep":{"list":[1,{"fx":2}]}', ""), F.lit('},"enabled_stages":["mapper",'),
        pick(11, '"mapper"', '"matcher"'), pick(13, ',"other"', ""), F.lit("]"), pick(17, "", "}"))
    wrapped = F.when(k % 2 == 0, F.concat(F.lit('{"pipeline_id":"p","pipeline_version":"1","stage":"s","config":'), text, F.lit("}"))).otherwise(text)
    docs = fx.raw(spark, d, "part").select("p_partkey", F.when(k % 19 == 0, F.lit(" \n")).otherwise(wrapped).alias("text"))
    return json_schema.config_violations(docs, "p_partkey", "text")


# Clocks: a platform domain a nation, suppliers in chains of every 25th below it; one chain contradicts itself, one has lost its link to the platform.
@query("""SELECT s_suppkey AS domain, CASE WHEN s_suppkey % 25 <> 9 THEN -1 - s_suppkey % 25 END AS root, CASE WHEN s_suppkey % 25 NOT IN (7, 9) THEN 10 * (s_suppkey % 25 * (s_suppkey // 25 + 1) + 25 * (s_suppkey // 25) * (s_suppkey // 25 + 1) // 2) END AS offset_ns,
CASE s_suppkey % 25 WHEN 7 THEN 'contradictory' WHEN 9 THEN 'unresolvable' END AS error FROM supplier UNION ALL
SELECT -1 - n_nationkey, -1 - n_nationkey, CASE WHEN n_nationkey <> 7 THEN 0 END, CASE WHEN n_nationkey = 7 THEN 'contradictory' END FROM nation""")
def clock_domains(spark, d):
    s, n = fx.raw(spark, d, "supplier").selectExpr("cast(s_suppkey as long) AS k"), fx.raw(spark, d, "nation").selectExpr("cast(n_nationkey as long) AS k")
    domains = s.selectExpr("k AS domain", "false AS is_platform").unionByName(n.selectExpr("-1 - k AS domain", "true AS is_platform"))
    links = s.where("k <> 9").selectExpr("k AS a", "if(k >= 25, k - 25, -1 - k) AS b", "k * 10 AS offset_ns")
    odd = s.where("k % 25 = 7 and k < 50").selectExpr("k AS a", "-8L AS b", "5L AS offset_ns")
    return clocks.resolve_clocks(domains, links.unionByName(odd))


@query(_FILES + """SELECT session_id, sequence_index, CASE error WHEN 'Unreadable' THEN 6001 WHEN 'Corrupt' THEN 6002 WHEN 'UnsupportedFormat' THEN 6003 WHEN 'SensorUnresolved' THEN 6005 ELSE 6006 END AS error_code,
CASE error WHEN 'Unreadable' THEN 'IMPORT_UNREADABLE' WHEN 'Corrupt' THEN 'IMPORT_CORRUPT' WHEN 'UnsupportedFormat' THEN 'IMPORT_UNSUPPORTED_FORMAT' WHEN 'SensorUnresolved' THEN 'IMPORT_SENSOR_UNRESOLVED' ELSE 'IMPORT_TIMESTAMP_UNRESOLVABLE' END AS error_name
FROM ordered WHERE error IS NOT NULL""")
def import_rejection_codes(spark, d):
    return errors.with_code(_imported(spark, d)[1], "error", "IMPORT").select("session_id", "sequence_index", "error_code", "error_name")
