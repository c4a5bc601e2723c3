"""Which elements a camera can see, and which a measurement reaches: joins of boxes over grid cells, then exact tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .evaluation import AXES, finite


def meeting(a: DataFrame, b: DataFrame, size: float, most: int = 512) -> DataFrame:
    """Pairs of rows of a(lo, hi, ...) and b(lo, hi, ...) whose boxes meet (structs of x, y, z; borders belong to a box), as structs a and b. See `met`."""
    return met(a.select(F.struct("*").alias("a"), "lo", "hi"), b.select(F.struct("*").alias("b"), "lo", "hi"), size, most).select("a", "b")


def met(a: DataFrame, b: DataFrame, size: float, most: int = 512) -> DataFrame:
    """Columns of a(lo, hi, ...) and of b(lo, hi, ...), but lo and hi, of pairs of rows whose boxes meet; no other name may stand in both.

    Both sides go to the cells of a grid of edge `size` that they touch and meet there; a pair counts only in one of the cells that they share, that
    of the greater of their lower corners, so each comes once and nothing has to be told apart later. Rows of b in a cell are dealt to blocks of about `most` and a's go to each
    block, so a crowded cell becomes many units of work, dealt over all cores: the pairs grow with the product of the tables, however small these are.
    Rows with a null or non-finite corner, or with lo above hi, meet nothing. Corners are columns of their own without nulls: tests of fields of structs make methods too long for the JVM to compile."""
    n = tasks(a)

    def cells(df: DataFrame, name: str) -> DataFrame:
        corner = {f"__{name}{e}{c}": F.col(f"{e}.{c}").cast("double") for e in ("lo", "hi") for c in AXES}
        df = df.where(finite(*corner.values()) & (F.col("lo.x") <= F.col("hi.x")) & (F.col("lo.y") <= F.col("hi.y")) & (F.col("lo.z") <= F.col("hi.z")))
        df = df.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in corner.items()}).drop("lo", "hi").repartition(n)
        cell = lambda e, c: F.floor(F.col(f"__{name}{e}{c}") / F.lit(size))
        df = df.withColumns({f"__{name}first{c}": cell("lo", c) for c in AXES})
        for c in AXES:
            df = df.withColumn(f"__c{c}", F.explode(F.sequence(F.col(f"__{name}first{c}"), cell("hi", c))))
        return df

    keys = [f"__c{c}" for c in AXES]
    there = cells(b, "b")
    full = there.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("__blocks"))
    own = [c for c in there.columns if c not in keys]
    there = there.join(full, keys).withColumn("__block", F.pmod(F.xxhash64(*own), F.col("__blocks")).cast("int")).drop("__blocks")
    here = cells(a, "a").join(full, keys).withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).drop("__blocks")
    once, meets = F.lit(True), F.lit(True)
    for c in AXES:
        once &= F.col(f"__c{c}") == F.greatest(F.col(f"__afirst{c}"), F.col(f"__bfirst{c}"))
        meets &= (F.col(f"__alo{c}") <= F.col(f"__bhi{c}")) & (F.col(f"__blo{c}") <= F.col(f"__ahi{c}"))
    on = [*keys, "__block"]
    # held by cell and block: estimates are those of the small tables before they are dealt to cells, by which all of one side would be sent everywhere
    pairs = here.repartition(n, *on).join(there.repartition(n, *on).hint("shuffle_hash"), on).where(once & meets)
    return pairs.select(*[c for df in (a, b) for c in df.columns if c not in ("lo", "hi")])


def tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


SIDES = ("near", "far", "left", "right", "top", "bottom")


def frustums(cameras: DataFrame) -> DataFrame:
    """cameras with lo and hi, the box around what they can see (0 < near <= far), and the sides of that as columns near_side and so on: x, y, z, d, of
    which x * px + y * py + z * pz + d >= 0 holds for points p inside, taken from the camera's place.

    cameras(q, t, fx, fy, cx, cy, width, height, near, far): q and t take camera coordinates (x right, y down, z ahead) to the world's."""
    own, f = cameras.columns, lambda name: F.col(name).cast("double")
    for axis, unit in (("u", (1, 0, 0)), ("v", (0, 1, 0)), ("w", (0, 0, 1))):  # the camera's axes in the world, a column each
        cameras = cameras.withColumns({f"__{axis}{c}": v for c, v in zip(AXES, g.rotate(F.col("q"), g.vec(*unit)))})
    ends = {"u": [(e - f("cx")) / f("fx") for e in (F.lit(0.0), f("width"))], "v": [(e - f("cy")) / f("fy") for e in (F.lit(0.0), f("height"))]}
    cameras = cameras.withColumns({f"__{axis}{i}": v for axis, both in ends.items() for i, v in enumerate(both)})
    ray = lambda i, j, c: F.col(f"__u{i}") * F.col(f"__u{c}") + F.col(f"__v{j}") * F.col(f"__v{c}") + F.col(f"__w{c}")
    cameras = cameras.withColumns({f"__{end}{c}": pick(*[ray(i, j, c) for i in (0, 1) for j in (0, 1)]) for end, pick in (("lo", F.least), ("hi", F.greatest)) for c in AXES})
    # depths are positive, so the extremes lie at the nearest or the farthest end of the extreme rays
    corner = lambda end, pick: g.col(g.vec(*[F.col(f"t.{c}") + pick(F.col(f"__{end}{c}") * f("near"), F.col(f"__{end}{c}") * f("far")) for c in AXES])).alias(end)
    zero, one = F.lit(0.0), F.lit(1.0)
    weights = [
        (zero, zero, one, -f("near")), (zero, zero, -one, f("far")), (f("fx"), zero, f("cx"), zero), (-f("fx"), zero, f("width") - f("cx"), zero),
        (zero, f("fy"), f("cy"), zero), (zero, -f("fy"), f("height") - f("cy"), zero),
    ]
    sides = [
        F.struct(*[(u * F.col(f"__u{c}") + v * F.col(f"__v{c}") + w * F.col(f"__w{c}")).alias(c) for c in AXES], d.alias("d")).alias(f"{name}_side")
        for name, (u, v, w, d) in zip(SIDES, weights)
    ]
    # through a generator of one row: conditions on these columns stop there, instead of going down to the scan with all of the above written out in them
    return cameras.select(F.inline(F.array(F.struct(*own, corner("lo", F.least), corner("hi", F.greatest), *sides))))


def visible_from(cameras: DataFrame, elements: DataFrame, size: float) -> DataFrame:
    """camera_id, element_id of the elements whose box meets the box around the camera's frustum, and that no single side of the frustum shuts out.

    elements(element_id, lo, hi). The six sides are taken one by one, as culling does: a box near an edge of the frustum can pass all six and still lie outside; nothing that is inside is left out."""
    value = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    parts = {f"__{s}{c}": F.col(f"{s}_side.{c}") for s in SIDES for c in (*AXES, "d")} | {f"__t{c}": F.col(f"t.{c}") for c in AXES}
    seen = frustums(cameras.repartition(tasks(cameras))).select("camera_id", "lo", "hi", *[v.alias(k) for k, v in parts.items()]).dropna(subset=list(parts))
    seen = seen.select("camera_id", "lo", "hi", *[value(k).alias(k) for k in parts], *[F.abs(value(f"__{s}{c}")).alias(f"__{s}{c}_abs") for s in SIDES for c in AXES])
    # of a box its middle and half its edges, without nulls as its corners are
    box = {f"__middle{c}": (F.col(f"lo.{c}") + F.col(f"hi.{c}")) / 2 for c in AXES} | {f"__half{c}": (F.col(f"hi.{c}") - F.col(f"lo.{c}")) / 2 for c in AXES}
    pairs = met(seen, elements.select("element_id", "lo", "hi", *[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in box.items()]), size)
    # the point of a box that lies deepest inside a side: at its centre, plus what its half edges can add
    for s in SIDES:
        deepest = sum(F.col(f"__{s}{c}") * (F.col(f"__middle{c}") - F.col(f"__t{c}")) + F.col(f"__{s}{c}_abs") * F.col(f"__half{c}") for c in AXES)
        pairs = pairs.where(deepest + F.col(f"__{s}d") >= 0)
    return pairs.select("camera_id", "element_id")


def observed_by(observations: DataFrame, elements: DataFrame, size: float, digits: int | None = None, most: int = 512) -> DataFrame:
    """observation_id, element_id, distance of the elements that come within reach of a measurement: observations(observation_id, t, reach), a point and a radius;
    distances are rounded to `digits` if given.

    Measurements from one place with one reach, and elements of one box, are compared once; pairs of places and boxes then meet their members, dealt to blocks of about `most`."""
    n, place, corners = tasks(elements), [*[f"__t{c}" for c in AXES], "reach"], [f"__{e}{c}" for e in ("lo", "hi") for c in AXES]
    around = lambda k: g.col(g.vec(*[F.col(f"__t{c}") + k * F.col("reach") for c in AXES]))
    seen = observations.where("reach >= 0").select("observation_id", *[F.col(f"t.{c}").cast("double").alias(f"__t{c}") for c in AXES], F.col("reach").cast("double").alias("reach"))
    boxes = elements.select("element_id", *[F.col(f"{e}.{c}").cast("double").alias(f"__{e}{c}") for e in ("lo", "hi") for c in AXES])
    corner = lambda e: F.struct(*[F.col(f"__{e}{c}").alias(c) for c in AXES]).alias(e)
    pairs = met(seen.select(*place).distinct().select(*place, around(-1).alias("lo"), around(1).alias("hi")), boxes.select(*corners).distinct().select(*corners, corner("lo"), corner("hi")), size)
    gap = lambda c: F.greatest(F.col(f"__lo{c}") - F.col(f"__t{c}"), F.lit(0.0), F.col(f"__t{c}") - F.col(f"__hi{c}"))
    distance = F.sqrt(sum(gap(c) * gap(c) for c in AXES))
    pairs = pairs.withColumn("distance", distance).where("distance <= reach")
    if digits is not None:
        pairs = pairs.withColumn("distance", F.round("distance", digits))
    pairs = pairs.join(boxes.hint("shuffle_hash"), corners).drop(*corners)
    blocks = seen.groupBy(*place).agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("__blocks"))
    seen = seen.join(blocks, place).withColumn("__block", F.pmod(F.xxhash64("observation_id"), F.col("__blocks")).cast("int")).drop("__blocks")
    pairs = pairs.join(blocks, place).withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).drop("__blocks")
    on = [*place, "__block"]
    return pairs.repartition(n, *on).join(seen.repartition(n, *on).hint("shuffle_hash"), on).select("observation_id", "element_id", "distance")
