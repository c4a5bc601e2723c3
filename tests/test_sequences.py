"""Operators that stand for one-after-another rules, against loops that follow the rules."""

import random

import pytest
from pyspark.sql import functions as F

from karstline.operators import graph, store, trajectory


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_add_frames(spark, seed):
    rng = random.Random(seed)
    names = [f"f{i}" for i in range(25)]
    rows = [(i, rng.choice(names), rng.choice([None, "root", "gone", *names])) for i in range(90)]
    rows += [(200 + i, f"chain{i}", f"chain{i - 1}" if i else "root") for i in range(12)] + [(300, "self", "self"), (301, "late", "later"), (302, "later", "root"), (303, "late", "later")]
    have, bad = {"root", "f0"}, {}
    for i, f, up in rows:
        bad[i] = "exists" if f in have else "parent_not_found" if up is not None and up not in have else None
        if not bad[i]:
            have.add(f)
    batch = spark.createDataFrame(rows, "seq long, frame_id string, parent_id string").withColumn("first", F.lit(7))
    known = spark.createDataFrame([("root",), ("f0",)], "frame_id string")
    good, refused = graph.add_frames(known, batch.repartition(7), "seq")
    assert {r.seq for r in good.collect()} == {i for i in bad if not bad[i]} and good.columns == batch.columns
    assert {r.seq: r.error for r in refused.collect()} == {i: e for i, e in bad.items() if e}
    for x in graph.add_frames(known, batch.limit(0), "seq"):
        assert x.collect() == []


POSE = "struct<q: struct<x: double, y: double, z: double, w: double>, t: struct<x: double, y: double, z: double>>"


def test_frame_transform_answers_every_pair(spark):
    rng = random.Random(5)
    up = {f"f{i}": f"f{rng.randrange(i)}" if i else None for i in range(30)} | {"a": "nowhere", "b": "a", "c": "b", "r1": "r2", "r2": "r1", "tail": "r1"}
    turn = (0.0, 0.0, 2**-0.5, 2**-0.5)  # a quarter about z: (x, y) goes to (-y, x)
    rows = [(f, p, (turn, (float(i % 5), float(i % 3), 1.0))) for i, (f, p) in enumerate(up.items())]
    shift = {f: t for f, _, (_, t) in rows}

    def climb(frm, dst):
        """Origin of dst in frm, if frm is above dst."""
        x, y, z, at, seen = 0.0, 0.0, 0.0, dst, set()
        while up.get(at) is not None:
            if at in seen:
                return "cycle"
            seen.add(at)
            sx, sy, sz = shift[at]
            x, y, z, at = -y + sx, x + sy, z + sz, up[at]
            if at == frm:
                return x, y, z
        return None

    def answer(frm, dst):
        if frm == dst:
            return None, (0.0, 0.0, 0.0)
        if frm not in up or dst not in up:
            return "not_found", None
        down = climb(frm, dst)
        if down == "cycle" or down:
            return ("cycle", None) if down == "cycle" else (None, down)
        back = climb(dst, frm)
        if back == "cycle" or not back:
            return back or "disconnected", None
        steps, at = 0, frm
        while at != dst:
            steps, at = steps + 1, up[at]
        x, y, z = (-v for v in back)
        for _ in range(steps):
            x, y = y, -x  # the inverse turn, a quarter back a step
        return None, (x, y, z)

    ask = [(a, b) for a in [*up, "zz"] for b in [*up, "zz"] if rng.random() < 0.5 or a in ("a", "c", "r1", "tail") or b in ("tail", "r2", "zz")]
    tree = spark.createDataFrame(rows, f"frame_id string, parent_id string, pose {POSE}")
    got = graph.frame_transform(tree, spark.createDataFrame(ask + ask[:3], "frm string, dst string")).collect()
    assert len(got) == len(ask) + 3
    for r in got:
        error, t = answer(r.frm, r.dst)
        assert r.error == error, (r.frm, r.dst)
        assert (r.pose is None) == (t is None)
        if t:
            assert (r.pose.t.x, r.pose.t.y, r.pose.t.z) == pytest.approx(t, abs=1e-9), (r.frm, r.dst)


def test_first_of_a_key_comes_in(spark):
    old = spark.createDataFrame([(1, 0, "old")], "k int, seq int, v string")
    new = spark.createDataFrame([(1, 1, "a"), (2, 5, "b"), (2, 2, "c"), (2, 9, "d"), (3, 4, None)], "k int, seq int, v string")
    snapshot, refused = store.append_unique(old, new, ["k"], "seq")
    assert sorted(map(tuple, snapshot.collect())) == [(1, 0, "old"), (2, 2, "c"), (3, 4, None)]
    assert sorted(r.v for r in refused.collect()) == ["a", "b", "d"]
    keep, gone = store.collect_garbage(new.select("k").distinct(), old, "k", dry_run=True)
    assert keep.count() == 3 and sorted(r.k for r in gone.collect()) == [2, 3]


@pytest.mark.parametrize("window,n,span", [(5, 300, 60), (0, 200, 20), (50, 200, 60), (3, 400, 8)])
def test_distinct_closures(spark, window, n, span):
    rng = random.Random(window + n)
    time = {f: rng.randrange(-span, span) for f in range(40)} | {40: None}
    rows = []
    for i in range(n):
        a, b = rng.randrange(41), rng.randrange(41)
        rows.append((i, rng.choice(["t1", "t1", "t2"]), a, b, time[a], time[b], rng.choice([None, 0.1, 0.5, 0.9, rng.random()])))
    taken, want = {"t1": [], "t2": []}, {}
    for i, k, a, b, ta, tb, score in sorted(rows, key=lambda r: (-r[6] if r[6] is not None else float("inf"), r[0])):
        ends = sorted((ta, tb)) if None not in (ta, tb) else None
        near = lambda c: c[0] == {a, b} or (ends and c[1] and abs(ends[0] - c[1][0]) <= window and abs(ends[1] - c[1][1]) <= window)
        want[i] = "rejected" if any(map(near, taken[k])) else "accepted"
        if want[i] == "accepted":
            taken[k].append(({a, b}, ends))
    df = spark.createDataFrame(rows, "candidate_id long, trajectory string, source long, target long, source_ns long, target_ns long, score double")
    out = trajectory.distinct_closures(df, "trajectory", window)
    assert {r.candidate_id: r.status for r in out.collect()} == want
    assert trajectory.distinct_closures(df.limit(0), "trajectory", window).collect() == []
