"""Accuracy of trajectories and point clouds against a reference.

Trajectories come as pairs of poses (estimate, reference) as association.associate makes them; moments, transforms
and residuals are aggregates, one row a trajectory, so a long trajectory is summed in parts. Nothing leaves the expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import association
from .graph import forget, written

AXES = "xyz"


def alignment(pairs: DataFrame, key: str, scale: bool = True) -> DataFrame:
    """key, n_pairs, scale, q, t of the similarity that takes the estimated positions to the reference with the least sum of squares.

    pairs(key, est, ref) with structs est.t and ref.t of x, y, z; rows with a null or non-finite coordinate don't count. The rotation maximises the
    trace with the cross-covariance (geometry.best_rotation), which comes from covariances that merge stably, not from raw sums. Where positions
    lie on a line, or all in one point, many rotations fit equally and one of them is returned; an estimate of one point only has scale 1."""
    p = {a: F.col(f"est.t.{a}") for a in AXES}
    r = {a: F.col(f"ref.t.{a}") for a in AXES}
    cross = [F.covar_pop(p[a], r[b]).alias(f"s{a}{b}") for a in AXES for b in AXES]
    means = [F.avg(c[a]).alias(f"{side}{a}") for side, c in (("p", p), ("r", r)) for a in AXES]
    spread = [sum(F.var_pop(c[a]) for a in AXES).alias(f"v{side}") for side, c in (("p", p), ("r", r))]
    m = pairs.where(finite(*p.values(), *r.values())).groupBy(key).agg(F.count("*").alias("n_pairs"), *cross, *means, *spread)
    # a column a step, so that each is computed once
    m = m.withColumn("v", g.best_rotation({a + b: F.col(f"s{a}{b}") for a in AXES for b in AXES}, F.sqrt(F.col("vp") * F.col("vr"))))
    m = m.withColumn("length", F.sqrt(sum(F.col("v")[i] * F.col("v")[i] for i in range(4))))
    m = m.withColumns({f"q{c}": F.col("v")[i] / F.col("length") for i, c in enumerate("xyzw")})
    q = g.Quat(*[F.col(f"q{c}") for c in "xyzw"])
    m = m.withColumns({f"m{c}": v for c, v in zip(AXES, g.rotate(q, g.vec(F.col("px"), F.col("py"), F.col("pz"))))})
    # sum of r . R p: column a of the rotation matrix, R on that axis, against the row of the cross-covariance
    for a, e in zip(AXES, ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))):
        m = m.withColumns({f"r{a}{b}": v for b, v in zip(AXES, g.rotate(q, g.vec(*e)))})
    m = m.withColumn("dot", sum(F.col(f"r{a}{b}") * F.col(f"s{a}{b}") for a in AXES for b in AXES))
    m = m.withColumn("scale", F.when((F.col("vp") > 0) & (F.col("dot") > 0), F.col("dot") / F.col("vp")).otherwise(F.lit(1.0)) if scale else F.lit(1.0))
    t = g.vec(*[F.col(f"r{a}") - F.col("scale") * F.col(f"m{a}") for a in AXES])
    return m.select(key, "n_pairs", "scale", g.col(q).alias("q"), g.col(t).alias("t"))


def finite(*columns: Column) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok &= c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok


def absolute_error(pairs: DataFrame, key: str, scale: bool = True) -> DataFrame:
    """key, n_pairs, scale, ate_rmse, ate_mean, ate_max over the distances that are left after alignment."""
    a = alignment(pairs, key, scale)
    both = pairs.where(finite(*[F.col(f"{s}.t.{c}") for s in ("est", "ref") for c in AXES])).join(a, key)
    p = g.add(g.scale(g.rotate(F.col("q"), F.col("est.t")), F.col("scale")), F.col("t"))
    square = sum(F.pow(F.col(f"ref.t.{c}") - getattr(p, c), 2) for c in AXES)
    both = both.select(key, "n_pairs", "scale", square.alias("__e"))
    return both.groupBy(key).agg(
        F.first("n_pairs").alias("n_pairs"), F.first("scale").alias("scale"), F.sqrt(F.avg("__e")).alias("ate_rmse"), F.avg(F.sqrt("__e")).alias("ate_mean"), F.sqrt(F.max("__e")).alias("ate_max"),
    )


def relative_error(pairs: DataFrame, key: str, ts: str, order: list[str], width: int) -> DataFrame:
    """key, n_steps, rpe_translation (root mean square), rpe_rotation_deg (root mean square) and rpe_rotation_max_deg over consecutive pairs.

    The error of a step is the estimated motion seen from the true one, inverse(ref motion) * est motion; poses are taken as they are, without alignment, which
    a common rigid motion would not change. Rotations count as unit quaternions; q and -q are the same. Pairs with a null in a pose are left out before steps are made."""
    ok = finite(*[F.col(f"{s}.t.{c}") for s in ("est", "ref") for c in AXES], *[F.col(f"{s}.q.{c}") for s in ("est", "ref") for c in "xyzw"])
    steps = association.with_previous(pairs.where(ok).select(key, *order, "est", "ref"), key, ts, order, ["est", "ref"], width).where("prev_est is not null")
    pose = lambda c: g.pose(g.normalize(F.col(f"{c}.q")), F.col(f"{c}.t"))
    motion = lambda side: g.compose(g.invert(pose(f"prev_{side}")), pose(side))
    steps = steps.select(key, g.col(motion("est")).alias("e"), g.col(motion("ref")).alias("r"))
    steps = steps.select(key, g.col(g.compose(g.invert(F.col("r")), F.col("e"))).alias("d"))
    length = lambda *cs: F.sqrt(sum(c * c for c in cs))
    q = "d.q."
    # the angle by atan2: exact for small ones too, where the cosine is flat
    angle = F.degrees(2 * F.atan2(length(*[F.col(q + c) for c in AXES]), F.abs(F.col(q + "w"))))
    steps = steps.select(key, sum(F.pow(F.col(f"d.t.{c}"), 2) for c in AXES).alias("__t"), angle.alias("__a"))
    return steps.groupBy(key).agg(
        F.count("*").alias("n_steps"), F.sqrt(F.avg("__t")).alias("rpe_translation"), F.sqrt(F.avg(F.pow("__a", F.lit(2)))).alias("rpe_rotation_deg"), F.max("__a").alias("rpe_rotation_max_deg"),
    )


def nearest_points(points: DataFrame, others: DataFrame, key: str, id_: str, radius: float, levels: int = 3, most: int = 512) -> DataFrame:
    """points(key, id_, x, y, z) with distance and other_id of the nearest of others (same columns) of the same key within `radius`, null if there is
    none; of several at one distance the smallest id. Points with a null or non-finite coordinate, or one beyond 2**50 radii, have none and are none.

    Points at the same place count once on either side. Rounds go from fine cells to coarse ones, radius / 2**(levels - 1) up to radius: a point is compared with the others in the 27
    cells around it, and what lies within a cell's edge is its nearest for certain, so only points without a near neighbour go on to the larger cells. Others of a cell are dealt
    to blocks of about `most`, and a point is sent to each block: a cell with a third of all points becomes many units of work. Distances are reduced to the
    least of each point before they are shuffled; pairs are never stored. Rounds are written, so calling this runs jobs."""
    place = ["x", "y", "z"]
    ok = finite(*[F.col(c) for c in place])
    for c in place:
        ok &= F.abs(F.col(c)) < radius * 2.0**50  # beyond that, neighbouring doubles are further apart than the radius
    todo = written(points.where(ok & F.col(key).isNotNull()).select(key, *place).distinct())
    there = written(others.where(ok & F.col(key).isNotNull()).groupBy(key, *place).agg(F.min(id_).alias("other_id")))
    done = None
    for k in range(levels - 1, -1, -1):
        size = radius / 2**k
        cell = lambda c: F.floor(F.col(c) / F.lit(size))
        own = there.select(F.col(key).alias("k"), *[cell(c).alias(f"c{c}") for c in place], *[F.col(c).alias(f"o{c}") for c in place], "other_id")
        full = own.groupBy("k", "cx", "cy", "cz").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("blocks"))
        own = own.join(full, ["k", "cx", "cy", "cz"]).withColumn("block", F.pmod(F.xxhash64("other_id"), F.col("blocks")).cast("int")).drop("blocks")
        around = [F.explode(F.sequence(cell(c) - 1, cell(c) + 1)).alias(f"c{c}") for c in place]
        probe = todo.select(F.col(key).alias("k"), *place)
        for spread in around:
            probe = probe.select("*", spread)
        probe = probe.join(full, ["k", "cx", "cy", "cz"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        d2 = sum((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in place)
        pairs = probe.join(own, ["k", "cx", "cy", "cz", "block"]).select("k", *place, d2.alias("d2"), "other_id").where(F.sqrt("d2") <= size)
        least = pairs.groupBy("k", *place).agg(F.min(F.struct("d2", "other_id")).alias("m"))
        found = written(least.select(F.col("k").alias(key), *place, F.sqrt("m.d2").alias("distance"), "m.other_id"))
        done = found if done is None else done.unionByName(found)
        rest = written(todo.join(found.select(key, *place), [key, *place], "left_anti")) if k else None
        forget(todo)
        todo = rest
    forget(there)
    return points.join(done, [key, *place], "left").select(*points.columns, "distance", "other_id")


def cloud_scores(cloud: DataFrame, truth: DataFrame, key: str, id_: str, threshold: float, **how) -> DataFrame:
    """key, n_points, n_truth, accuracy (percent of the cloud's points with a true point closer than the threshold), completeness (percent of the
    true points with one of the cloud closer than that), fscore (harmonic mean of both, 0 if both are 0), mean_error of the points that have one within the
    threshold. A key that only one side has scores 0; points with a null or non-finite coordinate count as far away."""
    def side(a, b, names):
        d = nearest_points(a.select(key, id_, *AXES), b.select(key, id_, *AXES), key, id_, threshold, **how)
        near = F.coalesce(F.col("distance") < threshold, F.lit(False))
        return d.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(names[0]), (100.0 * F.count_if(near) / F.count("*")).alias(names[1]), F.avg(F.when(near, F.col("distance"))).alias(names[2]))

    a = side(cloud, truth, ("n_points", "accuracy", "mean_error"))
    c = side(truth, cloud, ("n_truth", "completeness", "__unused")).drop("__unused")
    out = a.join(c, key, "full").fillna(0, ["n_points", "n_truth"]).fillna(0.0, ["accuracy", "completeness"])
    total = F.col("accuracy") + F.col("completeness")
    return out.withColumn("fscore", F.when(total > 0, 2 * F.col("accuracy") * F.col("completeness") / total).otherwise(F.lit(0.0)))
