"""Further registered queries: association by time, accuracy of trajectories and clouds, visibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import geometry as g
from .operators import association, evaluation, visibility
from .plans import fixtures as fx
from .queries_more import Q, SQL, _of, query

__all__ = ["Q", "SQL"]

SECOND = 1_000_000_000
SIX_HOURS = 6 * fx.HOUR

_BY_TIME = f""", l AS (SELECT user_id, event_id, t FROM ev WHERE event_type = 'click'), r AS (SELECT user_id, event_id, t FROM ev WHERE event_type = 'view'),
near AS (SELECT l.event_id AS a, r.event_id AS b, r.t - l.t AS delta, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.t - l.t), r.t, r.event_id) AS i,
row_number() OVER (PARTITION BY r.event_id ORDER BY abs(r.t - l.t), l.t, l.event_id) AS j FROM l JOIN r ON r.user_id = l.user_id AND abs(r.t - l.t) <= {SIX_HOURS}) """


def _sides(spark, d):
    e = fx.events(spark, d)
    return (e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name), F.col("t")) for kind, name in (("click", "lidar_id"), ("view", "image_id")))


@query(_BY_TIME + "SELECT l.event_id AS lidar_id, b AS image_id, delta FROM l LEFT JOIN near ON a = l.event_id AND i = 1")
def nearest_image_of_lidar(spark, d):
    left, right = _sides(spark, d)
    return association.nearest(left, right, "user_id", "t", SIX_HOURS, "image_id").select("lidar_id", F.col("match_id").alias("image_id"), "delta")


@query(_BY_TIME + "SELECT user_id, a AS lidar_id, b AS image_id, delta FROM near JOIN l ON event_id = a WHERE i = 1 AND j = 1")
def lidar_image_pairs(spark, d):
    left, right = _sides(spark, d)
    return association.associate(left, right, "user_id", "t", SIX_HOURS, "lidar_id", "image_id")


# A trajectory a user: the reference from value and k; the estimate turned, scaled, shifted, disturbed, its clock up to 3 seconds off, with gaps.

_ANGLE, _SCALE = "0.3 * (user_id % 10)", 1.1
_NOISE = "0.5 * sin(event_id * 1.0)", "0.5 * cos(event_id * 2.0)"
_TRACKS = f""", ref AS (SELECT user_id, event_id, t AS ts, CAST(value AS DOUBLE) AS x, CAST(k AS DOUBLE) AS y, 0.05 * k AS yaw FROM ev),
est AS (SELECT user_id, event_id, t + (event_id % 7 - 3) * {SECOND} AS ts, {_SCALE} * (cos({_ANGLE}) * value - sin({_ANGLE}) * k) + user_id + {_NOISE[0]} AS x,
{_SCALE} * (sin({_ANGLE}) * value + cos({_ANGLE}) * k) - user_id + {_NOISE[1]} AS y, 0.05 * k + {_ANGLE} + 0.02 * sin(event_id * 3.0) AS yaw FROM ev WHERE event_id % 11 <> 0),
cand AS (SELECT e.user_id, e.ts, e.x AS ex, e.y AS ey, e.yaw AS eyaw, r.x AS rx, r.y AS ry, r.yaw AS ryaw, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(r.ts - e.ts), r.ts, r.event_id) AS i,
row_number() OVER (PARTITION BY r.event_id ORDER BY abs(r.ts - e.ts), e.ts, e.event_id) AS j FROM est e JOIN ref r ON r.user_id = e.user_id AND abs(r.ts - e.ts) <= {5 * SECOND}),
pairs AS (SELECT * FROM cand WHERE i = 1 AND j = 1) """


def _pose(x, y, yaw):
    q = g.quat(0, 0, F.sin(yaw / 2), F.cos(yaw / 2))
    return g.col(q).alias("q"), g.col(g.vec(x, y, 0.0)).alias("t")


def _pairs(spark, d):
    e = fx.events(spark, d).withColumn("user_id", F.col("user_id").cast("long"))
    ref = e.select("user_id", F.col("event_id").alias("ref_id"), F.col("t").alias("ts"), F.struct(*_pose(F.col("value"), F.col("k"), 0.05 * F.col("k"))).alias("ref"))
    x, y = (F.expr(f"{_SCALE}D * ({a} * value {sign} {b} * k) {shift} user_id + {noise}") for a, sign, b, shift, noise in (
        (f"cos({_ANGLE})", "-", f"sin({_ANGLE})", "+", _NOISE[0]), (f"sin({_ANGLE})", "+", f"cos({_ANGLE})", "-", _NOISE[1])))
    yaw = F.expr(f"0.05D * k + {_ANGLE} + 0.02D * sin(event_id * 3.0)")
    est = e.where("event_id % 11 <> 0").select("user_id", F.col("event_id").alias("est_id"), (F.col("t") + (F.col("event_id") % 7 - 3) * SECOND).alias("ts"), F.struct(*_pose(x, y, yaw)).alias("est"))
    found = association.associate(est, ref, "user_id", "ts", 5 * SECOND, "est_id", "ref_id")
    return found.join(est.select("est_id", "ts", "est"), "est_id").join(ref.select("ref_id", "ref"), "ref_id")


@query(_TRACKS + """, m AS (SELECT user_id, count(*) AS n, avg(ex) AS ax, avg(ey) AS ay, avg(rx) AS bx, avg(ry) AS by_ FROM pairs GROUP BY user_id),
s AS (SELECT p.user_id, sum((ex - ax) * (rx - bx) + (ey - ay) * (ry - by_)) AS a, sum((ex - ax) * (ry - by_) - (ey - ay) * (rx - bx)) AS b, sum((ex - ax) ** 2 + (ey - ay) ** 2) AS v FROM pairs p JOIN m USING (user_id) GROUP BY p.user_id),
f AS (SELECT user_id, n, ax, ay, bx, by_, atan2(b, a) AS th, CASE WHEN v > 0 THEN sqrt(a * a + b * b) / v ELSE 1 END AS k FROM m JOIN s USING (user_id)),
e AS (SELECT user_id, n, k, (rx - bx - k * (cos(th) * (ex - ax) - sin(th) * (ey - ay))) ** 2 + (ry - by_ - k * (sin(th) * (ex - ax) + cos(th) * (ey - ay))) ** 2 AS d FROM pairs JOIN f USING (user_id))
SELECT user_id, n AS n_pairs, round(any_value(k), 5) AS scale, round(sqrt(avg(d)), 4) AS ate_rmse, round(avg(sqrt(d)), 4) AS ate_mean, round(sqrt(max(d)), 4) AS ate_max FROM e GROUP BY user_id, n""")
def trajectory_absolute_error(spark, d):
    out = evaluation.absolute_error(_pairs(spark, d), "user_id")
    return out.select("user_id", "n_pairs", F.round("scale", 5).alias("scale"), *[F.round(c, 4).alias(c) for c in ("ate_rmse", "ate_mean", "ate_max")])


@query(_TRACKS + """, w AS (SELECT user_id, eyaw, ryaw, ex - lag(ex) OVER o AS dex, ey - lag(ey) OVER o AS dey, lag(eyaw) OVER o AS e0, rx - lag(rx) OVER o AS drx, ry - lag(ry) OVER o AS dry, lag(ryaw) OVER o AS r0
FROM pairs WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
v AS (SELECT user_id, (cos(e0) * dex + sin(e0) * dey - cos(r0) * drx - sin(r0) * dry) ** 2 + (cos(e0) * dey - sin(e0) * dex - cos(r0) * dry + sin(r0) * drx) ** 2 AS t2,
abs(degrees(atan2(sin(eyaw - e0 - ryaw + r0), cos(eyaw - e0 - ryaw + r0)))) AS a FROM w WHERE e0 IS NOT NULL)
SELECT user_id, count(*) AS n_steps, round(sqrt(avg(t2)), 4) AS rpe_translation, round(sqrt(avg(a * a)), 4) AS rpe_rotation_deg, round(max(a), 4) AS rpe_rotation_max_deg FROM v GROUP BY user_id""")
def trajectory_relative_error(spark, d):
    out = evaluation.relative_error(_pairs(spark, d), "user_id", "ts", ["ts", "est_id"], 48 * fx.HOUR)
    return out.select("user_id", "n_steps", *[F.round(c, 4).alias(c) for c in ("rpe_translation", "rpe_rotation_deg", "rpe_rotation_max_deg")])


CLOUD = _of("orders", "o_custkey % 3 AS scene_id", "o_orderkey AS point_id", "CAST(o_orderkey % 101 AS DOUBLE) / 10 AS x", "CAST(o_custkey % 89 AS DOUBLE) / 10 AS y", "CAST(o_orderkey % 7 AS DOUBLE) AS z")
TRUTH = _of("customer", "c_custkey % 3 AS scene_id", "c_custkey AS point_id", "CAST(c_custkey % 103 AS DOUBLE) / 10 AS x", "CAST(c_custkey % 97 AS DOUBLE) / 10 AS y", "CAST(c_custkey % 8 AS DOUBLE) AS z")
_REACH = 0.75
_DISTANCE = f"""SELECT a.scene_id, a.point_id, b.point_id AS other_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS distance FROM {{}} a JOIN {{}} b ON a.scene_id = b.scene_id
AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= {_REACH}"""


@query(f""", d AS ({_DISTANCE.format(TRUTH[1], CLOUD[1])}), n AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, other_id) AS i FROM d)
SELECT p.point_id, n.other_id, round(distance, 6) AS distance FROM {TRUTH[1]} p LEFT JOIN n ON n.point_id = p.point_id AND i = 1""")
def nearest_points_of_truth(spark, d):
    out = evaluation.nearest_points(TRUTH[0](spark, d), CLOUD[0](spark, d), "scene_id", "point_id", _REACH)
    return out.select("point_id", "other_id", F.round("distance", 6).alias("distance"))


@query(f""", a AS (SELECT point_id, min(distance) AS e FROM ({_DISTANCE.format(CLOUD[1], TRUTH[1])}) GROUP BY point_id), c AS (SELECT point_id, min(distance) AS e FROM ({_DISTANCE.format(TRUTH[1], CLOUD[1])}) GROUP BY point_id),
p AS (SELECT scene_id, count(*) AS n_points, 100.0::DOUBLE * count(*) FILTER (e < {_REACH}) / count(*) AS accuracy, avg(e) FILTER (e < {_REACH}) AS mean_error FROM {CLOUD[1]} LEFT JOIN a USING (point_id) GROUP BY scene_id),
q AS (SELECT scene_id, count(*) AS n_truth, 100.0::DOUBLE * count(*) FILTER (e < {_REACH}) / count(*) AS completeness FROM {TRUTH[1]} LEFT JOIN c USING (point_id) GROUP BY scene_id)
SELECT scene_id, n_points, n_truth, round(accuracy, 6) AS accuracy, round(completeness, 6) AS completeness, round(mean_error, 6) AS mean_error,
round(2 * accuracy * completeness / (accuracy + completeness), 6) AS fscore FROM p JOIN q USING (scene_id)""")
def cloud_accuracy(spark, d):
    out = evaluation.cloud_scores(CLOUD[0](spark, d), TRUTH[0](spark, d), "scene_id", "point_id", _REACH)
    return out.select("scene_id", "n_points", "n_truth", *[F.round(c, 6).alias(c) for c in ("accuracy", "completeness", "mean_error", "fscore")])


_ELEMENTS = "p_partkey AS element_id", "CAST(p_partkey % 97 AS DOUBLE) AS mx", "CAST(p_size AS DOUBLE) AS my", "CAST(p_partkey % 53 AS DOUBLE) AS mz", "0.25 * (p_partkey % 5) AS h"
_EYES = "s_suppkey AS camera_id", "CAST(s_suppkey % 10 AS DOUBLE) * 10 AS x", "CAST(s_suppkey % 7 AS DOUBLE) * 7 AS y", "CAST(s_suppkey % 5 AS DOUBLE) * 10 AS z", "CAST(s_suppkey AS DOUBLE) / 10 AS th"


def _elements(spark, d):
    e = fx.raw(spark, d, "part").selectExpr(*_ELEMENTS)
    end = lambda sign: g.col(g.vec(*[F.col(f"m{c}") + sign * F.col("h") for c in "xyz"]))
    return e.select("element_id", end(-1).alias("lo"), end(1).alias("hi"))


@query(f""", e AS (SELECT {', '.join(_ELEMENTS)} FROM part), c AS (SELECT {', '.join(_EYES)} FROM supplier),
corner AS (SELECT camera_id, element_id, mx + i * h - x AS dx, my + j * h - y AS dy, mz + k * h - z AS dz, th FROM e, c, (VALUES (-1), (1)) a(i), (VALUES (-1), (1)) b(j), (VALUES (-1), (1)) f(k)),
seen AS (SELECT camera_id, element_id, cos(th) * dx - sin(th) * dz AS u, dy AS v, sin(th) * dx + cos(th) * dz AS w, dx, dy, dz FROM corner),
ray AS (SELECT camera_id, z * (cos(th) * i + sin(th)) AS fx, z * j AS fy, z * (cos(th) - sin(th) * i) AS fz FROM (SELECT camera_id, th FROM c) c, (VALUES (-0.64::DOUBLE), (0.64::DOUBLE)) a(i), (VALUES (-0.48::DOUBLE), (0.48::DOUBLE)) b(j), (VALUES (1), (30)) f(z)),
around AS (SELECT camera_id, min(fx) AS x0, max(fx) AS x1, min(fy) AS y0, max(fy) AS y1, min(fz) AS z0, max(fz) AS z1 FROM ray GROUP BY camera_id)
SELECT camera_id, element_id FROM seen JOIN around USING (camera_id) GROUP BY camera_id, element_id, x0, x1, y0, y1, z0, z1
HAVING min(dx) <= x1 AND max(dx) >= x0 AND min(dy) <= y1 AND max(dy) >= y0 AND min(dz) <= z1 AND max(dz) >= z0 AND max(w) >= 1 AND min(w) <= 30 AND max(500 * u + 320 * w) >= 0 AND max(-500 * u + 320 * w) >= 0 AND max(500 * v + 240 * w) >= 0 AND max(-500 * v + 240 * w) >= 0""")
def elements_visible_from_cameras(spark, d):
    q = g.from_axis_angle(g.vec(0, 1, 0), F.col("th"))
    fixed = {"fx": 500.0, "fy": 500.0, "cx": 320.0, "cy": 240.0, "width": 640.0, "height": 480.0, "near": 1.0, "far": 30.0}
    cameras = fx.raw(spark, d, "supplier").selectExpr(*_EYES).select("camera_id", g.col(q).alias("q"), g.col(g.vec(F.col("x"), F.col("y"), F.col("z"))).alias("t"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    return visibility.visible_from(cameras, _elements(spark, d), 8.0)


@query(f""", e AS (SELECT {', '.join(_ELEMENTS)} FROM part), c AS (SELECT {', '.join(_EYES)}, 2.0 + s_suppkey % 6 AS reach FROM supplier),
g AS (SELECT camera_id, element_id, reach, sqrt(greatest(mx - h - x, 0, x - mx - h) ** 2 + greatest(my - h - y, 0, y - my - h) ** 2 + greatest(mz - h - z, 0, z - mz - h) ** 2) AS distance FROM e, c)
SELECT camera_id AS observation_id, element_id, round(distance, 6) AS distance FROM g WHERE distance <= reach""")
def elements_observed(spark, d):
    o = fx.raw(spark, d, "supplier").selectExpr(*_EYES, "2.0D + s_suppkey % 6 AS reach")
    o = o.select(F.col("camera_id").alias("observation_id"), g.col(g.vec(F.col("x"), F.col("y"), F.col("z"))).alias("t"), "reach")
    return visibility.observed_by(o, _elements(spark, d), 8.0, digits=6)
