"""Quaternions (x, y, z, w) and rigid transforms (q, t) as Column expressions.

A pose named a_from_b maps coordinates of b into a. Functions take struct columns or
the tuples below and return tuples of plain Columns, so that nested calls build one
flat expression a component; col() makes a struct of a result. All stay inside code
generation.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Quat(NamedTuple):
    x: Column
    y: Column
    z: Column
    w: Column


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column


class Pose(NamedTuple):
    q: Quat
    t: Vec


def col(v) -> Column:
    """Struct column of a tuple."""
    if isinstance(v, Column):
        return v
    return F.struct(*[col(part).alias(name) for name, part in zip(v._fields, v)])


def _double(v) -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast("double")


def quat(x, y, z, w) -> Quat:
    return Quat(*map(_double, (x, y, z, w)))


def vec(x, y, z) -> Vec:
    return Vec(*map(_double, (x, y, z)))


def multiply(a, b) -> Quat:
    """Hamilton product a b: first b's rotation, then a's."""
    return quat(
        a.w * b.x + a.x * b.w + a.y * b.z - a.z * b.y,
        a.w * b.y - a.x * b.z + a.y * b.w + a.z * b.x,
        a.w * b.z + a.x * b.y - a.y * b.x + a.z * b.w,
        a.w * b.w - a.x * b.x - a.y * b.y - a.z * b.z,
    )


def norm(q) -> Column:
    return F.sqrt(q.x * q.x + q.y * q.y + q.z * q.z + q.w * q.w)


def normalize(q) -> Quat:
    """Unit quaternion; the zero quaternion gives null."""
    n = norm(q)
    return Quat(*[F.when(n > 0, v / n) for v in (q.x, q.y, q.z, q.w)])


def conjugate(q) -> Quat:
    return quat(-q.x, -q.y, -q.z, q.w)


def inverse(q) -> Quat:
    n = q.x * q.x + q.y * q.y + q.z * q.z + q.w * q.w
    return Quat(*[F.when(n > 0, v / n) for v in (-q.x, -q.y, -q.z, q.w)])


def cross(a, b) -> Vec:
    return vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def add(a, b) -> Vec:
    return vec(a.x + b.x, a.y + b.y, a.z + b.z)


def scale(a, k) -> Vec:
    return vec(a.x * k, a.y * k, a.z * k)


def rotate(q, v) -> Vec:
    """v turned by the unit quaternion q."""
    u = vec(q.x, q.y, q.z)
    c = scale(cross(u, v), 2.0)
    return add(add(v, scale(c, q.w)), cross(u, c))


def from_axis_angle(axis, angle: Column) -> Quat:
    s = F.sin(angle / 2)
    return quat(axis.x * s, axis.y * s, axis.z * s, F.cos(angle / 2))


def to_matrix(q) -> Column:
    """Rows of the 3 x 3 rotation matrix of a unit quaternion."""
    x, y, z, w = q.x, q.y, q.z, q.w
    return F.array(
        F.array(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        F.array(2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        F.array(2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )


def from_matrix(m: Column) -> Quat:
    """Unit quaternion of rotation rows, from the largest of its four squared components."""
    a = lambda i, j: m[i][j]
    four = [1 + a(0, 0) - a(1, 1) - a(2, 2), 1 - a(0, 0) + a(1, 1) - a(2, 2), 1 - a(0, 0) - a(1, 1) + a(2, 2), 1 + a(0, 0) + a(1, 1) + a(2, 2)]
    top = F.greatest(*four)
    r = F.sqrt(top) / 2
    d = [a(2, 1) - a(1, 2), a(0, 2) - a(2, 0), a(1, 0) - a(0, 1)]
    s = {(0, 1): a(1, 0) + a(0, 1), (0, 2): a(0, 2) + a(2, 0), (1, 2): a(2, 1) + a(1, 2)}
    pick = lambda i, j: s[min(i, j), max(i, j)] / (4 * r)
    cases = [[r if j == i else (d[i] / (4 * r) if j == 3 else pick(i, j)) for j in range(4)] for i in range(3)]
    last = [*[x / (4 * r) for x in d], r]
    parts = []
    for j in range(4):
        part = F.when(four[3] >= top, last[j])
        for i in range(3):
            part = part.when(four[i] >= top, cases[i][j])
        parts.append(part)
    return Quat(*parts)


def pose(q, t) -> Pose:
    return Pose(q, t)


def compose(a, b) -> Pose:
    """a_from_b and b_from_c give a_from_c."""
    return pose(multiply(a.q, b.q), add(rotate(a.q, b.t), a.t))


def invert(a) -> Pose:
    q = conjugate(a.q)
    return pose(q, rotate(q, scale(a.t, -1.0)))


def transform_point(a, p) -> Vec:
    return add(rotate(a.q, p), a.t)


def to_matrix4(a) -> Column:
    m = to_matrix(a.q)
    rows = [F.concat(m[i], F.array(getattr(a.t, c))) for i, c in enumerate("xyz")]
    return F.array(*rows, F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]))


def from_matrix4(m: Column) -> Pose:
    """Pose of a 4 x 4 matrix in rows; its last row is not looked at."""
    return pose(from_matrix(m), vec(*[m[i][3] for i in range(3)]))


def camera_pose(qvec_wxyz: Column, tvec: Column) -> Pose:
    """World-from-camera pose of a stored camera-from-world rotation (w first) and translation."""
    return invert(pose(quat(qvec_wxyz[1], qvec_wxyz[2], qvec_wxyz[3], qvec_wxyz[0]), vec(tvec[0], tvec[1], tvec[2])))


def best_rotation(s: dict[str, Column], bound: Column) -> Column:
    """[x, y, z, w], not yet of length 1, of the rotation R that maximises the sum of b . R a, from s["xy"] = sum of a.x * b.y and so on. Keep it in a
    column of its own before using its parts, else it is computed once for each use.

    bound: at least the largest magnitude that sum can have, as sqrt(sum |a|^2 * sum |b|^2) is; where it is 0 nothing turns. The quaternion is the main eigenvector of a symmetric
    4 x 4 matrix of these sums. With bound added on its diagonal no eigenvalue is negative, and squaring the matrix again and again, at a trace of 1, leaves the projection on the
    main eigenspace: of any dimension, so that ties (points on a line or in a plane) need no case of their own; its largest column is an eigenvector."""
    zero = F.lit(0.0)
    add = lambda a, b: s[a] + s[b]
    sub = lambda a, b: s[a] - s[b]
    half = [
        [s["xx"] + s["yy"] + s["zz"], sub("yz", "zy"), sub("zx", "xz"), sub("xy", "yx")],
        [zero, s["xx"] - s["yy"] - s["zz"], add("xy", "yx"), add("zx", "xz")],
        [zero, zero, s["yy"] - s["xx"] - s["zz"], add("yz", "zy")],
        [zero, zero, zero, s["zz"] - s["xx"] - s["yy"]],
    ]
    n = F.array(*[half[min(i, j)][max(i, j)] + (bound if i == j else zero) for i in range(4) for j in range(4)])

    def squared(m: Column, _: Column) -> Column:
        trace = m[0] + m[5] + m[10] + m[15]
        return F.array(*[sum(m[4 * i + k] * m[4 * k + j] for k in range(4)) / (trace * trace) for i in range(4) for j in range(4)])

    def column(m: Column) -> Column:
        top = F.greatest(m[0], m[5], m[10], m[15])
        out = None
        for j in range(4):
            c = F.array(*[m[4 * i + j] for i in (1, 2, 3, 0)])
            out = F.when(m[5 * j] >= top, c) if out is None else out.when(m[5 * j] >= top, c)
        return out

    return F.when(bound > 0, F.aggregate(F.sequence(F.lit(1), F.lit(48)), n, squared, column)).otherwise(F.array(zero, zero, zero, F.lit(1.0)))
