"""Association, alignment, clouds and visibility against plain readings, with ties, nulls, crowded places and empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from karstline.operators import association, evaluation, visibility


def frame(spark, rows, kinds):
    return spark.createDataFrame(rows, kinds)


@pytest.mark.parametrize("tolerance,buckets", [(10, 1), (10, 16), (0, 4), (7, 3)])
def test_nearest_and_pairs(spark, tolerance, buckets):
    rng = np.random.default_rng(tolerance + buckets)
    left = [(int(i), int(rng.integers(0, 3)), int(t)) for i, t in enumerate(rng.integers(-300, 300, 150))] + [(900, None, 5), (901, 1, None), (902, 7, 5)]
    right = [(int(i), int(rng.integers(0, 3)), int(t)) for i, t in enumerate(rng.integers(-300, 300, 120))] + [(800, None, 5), (801, 1, None)]
    a, b = frame(spark, left, "a long, k long, t long"), frame(spark, right, "b long, k long, t long")

    def best(row, others):
        near = [(abs(t - row[2]), t, i) for i, k, t in others if None not in (k, t, row[1], row[2]) and k == row[1] and abs(t - row[2]) <= tolerance]
        return (min(near)[2], min(near)[1] - row[2]) if near else (None, None)

    got = {r.a: (r.match_id, r.delta) for r in association.nearest(a, b, "k", "t", tolerance, "b", buckets).collect()}
    assert got == {row[0]: best(row, right) for row in left}
    # each other's nearest; rows at one time stand behind the smallest id of that time
    want = {(row[0], m) for row in left if (m := best(row, right)[0]) is not None and best(next(r for r in right if r[0] == m), left)[0] == row[0]}
    pairs = association.associate(a, b, "k", "t", tolerance, "a", "b").collect()
    assert {(r.a, r.b) for r in pairs} == want and len(pairs) == len(want)
    assert association.nearest(a, b.limit(0), "k", "t", tolerance, "b").where("match_id is not null").count() == 0
    assert association.associate(a.limit(0), b, "k", "t", tolerance, "a", "b").collect() == []


def test_with_previous(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.choice([0, 0, 0, 1, 2], 400), rng.integers(-500, 500, 400)))]
    got = {r.i: r.prev_i for r in association.with_previous(frame(spark, rows, "k long, t long, i long"), "k", "t", ["t", "i"], ["i"], 30).collect()}
    want, last = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i], last[k] = last.get(k), i
    assert got == want


def umeyama(a, b):
    """Scale, rotation and shift by singular values, the usual way."""
    ma, mb = a.mean(0), b.mean(0)
    u, d, v = np.linalg.svd((b - mb).T @ (a - ma) / len(a))
    s = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(v))])
    r = u @ s @ v
    k = np.trace(np.diag(d) @ s) / ((a - ma) ** 2).sum(1).mean()
    return k, r, mb - k * r @ ma


def pair_rows(k, a, b):
    return [(k, (tuple(map(float, p)),), (tuple(map(float, q)),)) for p, q in zip(a, b)]


PAIRS = "k int, est struct<t: struct<x: double, y: double, z: double>>, ref struct<t: struct<x: double, y: double, z: double>>"


def test_alignment(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(30):
        n = int(rng.integers(4, 40))
        a = rng.standard_normal((n, 3)) * 10.0 ** rng.integers(-2, 3)
        q, _ = np.linalg.qr(rng.standard_normal((3, 3)))
        q *= np.sign(np.linalg.det(q)) if k % 5 else -np.sign(np.linalg.det(q))  # every fifth is a mirror image, which no rotation can undo
        b = (rng.random() + 0.5) * a @ q.T + rng.standard_normal(3) * 100 + rng.standard_normal((n, 3)) * 0.01 * np.abs(a).max()
        if k == 7:
            a, b = a + 5e6, b + 5e6  # as far from the origin as coordinates of a country's grid
        s, r, t = umeyama(a, b)
        e = np.linalg.norm(b - (s * a @ r.T + t), axis=1)
        want[k] = n, s, math.sqrt((e**2).mean()), e.mean(), e.max()
        rows += pair_rows(k, a, b)
    got = {r.k: tuple(r)[1:] for r in evaluation.absolute_error(frame(spark, rows, PAIRS), "k").collect()}
    for k, w in want.items():
        assert got[k] == pytest.approx(w, rel=1e-6, abs=1e-7), k


def test_alignment_without_a_unique_rotation(spark):
    line = np.outer(np.arange(6.0), [1, 2, 2])
    turned = np.outer(np.arange(6.0), [0, 0, -6]) + [1, 2, 3]
    plane = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [3, 2, 0.0]])
    cases = {0: (line, turned), 1: (line, line[::-1]), 2: (plane, plane[:, [1, 0, 2]]), 3: (line[:1], turned[:1]), 4: (np.zeros((5, 3)), line[:5]), 5: (line, np.zeros((6, 3)))}
    rows = [r for k, (a, b) in cases.items() for r in pair_rows(k, a, b)]
    rows += [(6, ((None, 1.0, 2.0),), ((0.0, 0.0, 0.0),)), (0, ((float("nan"), 1.0, 2.0),), ((0.0, 0.0, 0.0),)), (0, None, None)]
    got = {r.k: r for r in evaluation.absolute_error(frame(spark, rows, PAIRS), "k").collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5} and got[0].n_pairs == 6
    assert [round(got[k].ate_rmse, 9) for k in (0, 1, 2, 3)] == [0, 0, 0, 0] and got[0].scale == pytest.approx(2)
    spread = math.sqrt(((line[:5] - line[:5].mean(0)) ** 2).sum(1).mean())
    assert got[4].ate_rmse == pytest.approx(spread) and got[4].scale == 1 and got[3].scale == 1
    assert evaluation.absolute_error(frame(spark, [], PAIRS), "k").collect() == []


def test_relative_error(spark):
    """Steps of random poses against matrices; a common motion of all estimates changes nothing; q and -q are one rotation."""
    rng = np.random.default_rng(8)

    def matrix(q, t):
        x, y, z, w = q
        m = np.eye(4)
        m[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
        m[:3, 3] = t
        return m

    n = 60
    q, t = rng.standard_normal((2, n, 4)), rng.standard_normal((2, n, 3))
    q /= np.linalg.norm(q, axis=2, keepdims=True)
    m = [[matrix(q[s][i], t[s][i]) for i in range(n)] for s in (0, 1)]
    shift, turn = [], []
    for i in range(1, n):
        d = np.linalg.inv(np.linalg.inv(m[1][i - 1]) @ m[1][i]) @ np.linalg.inv(m[0][i - 1]) @ m[0][i]
        shift.append(np.linalg.norm(d[:3, 3]))
        turn.append(math.degrees(math.acos(min(1, max(-1, (np.trace(d[:3, :3]) - 1) / 2)))))
    pose = lambda s, i, sign=1.0: (tuple(map(float, sign * q[s][i])), tuple(map(float, t[s][i])))
    rows = [(1, i * 10, i, pose(0, i, (-1.0) ** i), pose(1, i)) for i in range(n)] + [(2, 0, 0, pose(0, 0), pose(1, 0)), (1, 5, 99, None, pose(1, 0))]
    kinds = "k int, ts long, i long, est struct<q: struct<x: double, y: double, z: double, w: double>, t: struct<x: double, y: double, z: double>>, ref struct<q: struct<x: double, y: double, z: double, w: double>, t: struct<x: double, y: double, z: double>>"
    (got,) = evaluation.relative_error(frame(spark, rows, kinds), "k", "ts", ["ts", "i"], 35).collect()  # one pose makes no step
    rms = lambda v: math.sqrt(np.mean(np.square(v)))
    assert tuple(got) == pytest.approx((1, n - 1, rms(shift), rms(turn), max(turn)), rel=1e-6)


POINT = "scene int, id long, x double, y double, z double"


@pytest.mark.parametrize("levels,most", [(1, 512), (3, 4), (4, 1)])
def test_nearest_points_and_scores(spark, levels, most):
    rng = np.random.default_rng(levels)
    cloud = lambda n: [(int(s), i, *map(float, p)) for i, (s, p) in enumerate(zip(rng.integers(0, 2, n), np.round(rng.random((n, 3)) * 4, 1)))]
    a, b = cloud(250), cloud(200)
    # a third of either side in two small heaps, copies among them; places without coordinates; a scene on one side only
    a += [(0, 1000 + i, 10.0 + i % 3 * 0.01, 10.0, 10.0) for i in range(120)] + [(0, 2000, None, 1.0, 1.0), (0, 2001, float("nan"), 1.0, 1.0), (1, 2002, 1e300, 0.0, 0.0), (5, 2003, 0.0, 0.0, 0.0), (None, 2004, 0.0, 0.0, 0.0), (0, 2005, -0.0, 4.05, 0.0)]
    b += [(0, 1000 + i, 10.0 + i % 4 * 0.01, 10.3, 10.0) for i in range(100)] + [(0, 2000, None, 1.0, 1.0), (1, 2001, float("inf"), 0.0, 0.0), (6, 2002, 0.0, 0.0, 0.0)]
    radius = 0.5

    def best(p, others):
        ok = lambda r: r[0] is not None and all(v is not None and abs(v) < 1e100 for v in r[2:])
        d = [(math.sqrt((p[2] - r[2]) ** 2 + (p[3] - r[3]) ** 2 + (p[4] - r[4]) ** 2), r[1]) for r in others if ok(p) and ok(r) and r[0] == p[0]]
        m = min(d, default=(9, None))
        return m if m[0] <= radius else (None, None)

    got = {(r.scene, r.id): (r.distance, r.other_id) for r in evaluation.nearest_points(frame(spark, a, POINT), frame(spark, b, POINT), "scene", "id", radius, levels, most).collect()}
    assert got == {(p[0], p[1]): best(p, b) for p in a}
    scores = {r.scene: r for r in evaluation.cloud_scores(frame(spark, a, POINT), frame(spark, b, POINT), "scene", "id", radius, levels=levels, most=most).collect()}
    assert set(scores) == {0, 1, 5, 6}
    for s in scores:
        p, t = [r for r in a if r[0] == s], [r for r in b if r[0] == s]
        acc = 100 * sum((best(r, b)[0] or 0 if best(r, b)[1] is not None else 9) < radius for r in p) / len(p) if p else 0
        com = 100 * sum((best(r, a)[0] or 0 if best(r, a)[1] is not None else 9) < radius for r in t) / len(t) if t else 0
        assert (scores[s].n_points, scores[s].n_truth) == (len(p), len(t))
        assert (scores[s].accuracy, scores[s].completeness, scores[s].fscore) == pytest.approx((acc, com, 2 * acc * com / (acc + com) if acc + com else 0))
    assert evaluation.cloud_scores(frame(spark, [], POINT), frame(spark, [], POINT), "scene", "id", radius).collect() == []


BOX = "id long, lo struct<x: double, y: double, z: double>, hi struct<x: double, y: double, z: double>"


@pytest.mark.parametrize("size,most", [(3.0, 512), (1.0, 5), (50.0, 7)])
def test_meeting(spark, size, most):
    rng = np.random.default_rng(int(size))

    def boxes(n):
        lo = np.round(rng.random((n, 3)) * 10 - 5, 1)
        hi = lo + np.round(rng.random((n, 3)) * 3, 1) * (rng.random((n, 1)) < 0.8)
        return [(i, tuple(map(float, u)), tuple(map(float, v))) for i, (u, v) in enumerate(zip(lo, hi))]

    a, b = boxes(80) + [(900, (0.0, 0.0, 0.0), (-1.0, 1.0, 1.0)), (901, None, (1.0, 1.0, 1.0)), (902, (0.0, float("nan"), 0.0), (1.0, 1.0, 1.0))], boxes(90)
    got = [(r.i, r.j) for r in visibility.meeting(frame(spark, a, BOX), frame(spark, b, BOX), size, most).selectExpr("a.id AS i", "b.id AS j").collect()]
    meets = lambda p, q: all(p[1][k] <= q[2][k] and q[1][k] <= p[2][k] for k in range(3))
    assert sorted(got) == sorted((p[0], q[0]) for p in a[:80] for q in b if meets(p, q))


def test_visibility(spark):
    """Boxes around points that project into the image are seen, whatever the camera's pose; those behind it are not."""
    rng = np.random.default_rng(3)
    rows, want = [], set()
    cams = []
    for c in range(12):
        q = rng.standard_normal(4)
        q /= np.linalg.norm(q)
        x, y, z, w = q
        r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        t = rng.standard_normal(3) * 5
        cams.append((c, tuple(map(float, q)), tuple(map(float, t)), r, t))
    points = rng.standard_normal((200, 3)) * 8
    for c, _, _, r, t in cams:
        local = (points - t) @ r
        for i, (u, v, w) in enumerate(local):
            if 1 <= w <= 12 and 0 <= 400 * u / w + 300 <= 640 and 0 <= 420 * v / w + 250 <= 480:
                want.add((c, i))
    cameras = frame(spark, [c[:3] for c in cams], "camera_id long, q struct<x: double, y: double, z: double, w: double>, t struct<x: double, y: double, z: double>")
    cameras = cameras.withColumns({k: F.lit(v) for k, v in {"fx": 400, "fy": 420, "cx": 300, "cy": 250, "width": 640, "height": 480, "near": 1, "far": 12}.items()})
    dots = frame(spark, [(i, tuple(map(float, p)), tuple(map(float, p))) for i, p in enumerate(points)], BOX).withColumnRenamed("id", "element_id")
    assert {tuple(r) for r in visibility.visible_from(cameras, dots, 4.0).collect()} == want  # a point has no size, so the sides are exact
    seen = frame(spark, [(1, (0.0, 0.0, 0.0), 2.0), (2, (0.0, 0.0, 0.0), 0.0), (3, (0.0, 0.0, 0.0), -1.0), (4, (0.0, 0.0, 0.0), None)], "observation_id long, t struct<x: double, y: double, z: double>, reach double")
    cubes = frame(spark, [(1, (1.0, 1.0, 1.0), (2.0, 2.0, 2.0)), (2, (-1.0, -1.0, -1.0), (1.0, 1.0, 1.0)), (3, (2.0, 0.0, 0.0), (3.0, 0.0, 0.0)), (4, (2.0, 0.1, 0.0), (3.0, 1.0, 0.0))], BOX).withColumnRenamed("id", "element_id")
    got = {(r.observation_id, r.element_id): round(r.distance, 6) for r in visibility.observed_by(seen, cubes, 1.5).collect()}
    assert got == {(1, 1): round(math.sqrt(3), 6), (1, 2): 0.0, (1, 3): 2.0, (2, 2): 0.0}


def test_visibility_is_dealt(spark, monkeypatch):
    """Tables of one task are joined in several; measurements from one place and elements of one box are compared once, and come back all."""
    turned = lambda c: (0.0, math.sin(c / 20), 0.0, math.cos(c / 20))
    cameras = frame(spark, [(c, turned(c), (float(c % 4), 0.0, 0.0)) for c in range(40)], "camera_id long, q struct<x: double, y: double, z: double, w: double>, t struct<x: double, y: double, z: double>")
    cameras = cameras.withColumns({k: F.lit(v) for k, v in {"fx": 500, "fy": 500, "cx": 320, "cy": 240, "width": 640, "height": 480, "near": 1, "far": 30}.items()}).coalesce(1)
    corner = lambda e, r: (e % 5 + r, r, 2 * (e % 10) + r)
    elements = frame(spark, [(e, corner(e, -0.5), corner(e, 0.5)) for e in range(200)], BOX).withColumnRenamed("id", "element_id").coalesce(1)
    seen = visibility.visible_from(cameras, elements, 4.0)
    assert seen.select(F.spark_partition_id()).distinct().count() > 1

    real, sizes = visibility.met, []
    monkeypatch.setattr(visibility, "met", lambda a, b, *more: sizes.append((a.count(), b.count())) or real(a, b, *more))
    got = visibility.observed_by(cameras.selectExpr("camera_id AS observation_id", "t", "3D AS reach"), elements, 4.0, digits=6, most=3).collect()
    want = []
    for o in range(40):
        for e in range(200):
            gaps = [max(abs(o % 4 - e % 5) - 0.5, 0), 0, max(2 * (e % 10) - 0.5, 0)]
            if (far := sum(x * x for x in gaps) ** 0.5) <= 3:
                want.append((o, e, round(far, 6)))
    assert sorted(tuple(r) for r in got) == want and sizes == [(4, 10)]
