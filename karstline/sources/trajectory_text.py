"""Trajectories as text lines: three formats, told by their fields; bad lines are set apart with a reason.

tum: `seconds x y z qx qy qz qw` by white space; kitti: the 12 numbers of a 3 x 4 matrix, rows first, without times; euroc: nanoseconds, position and quaternion with w
first, by commas, further fields ignored. All come out as nanoseconds (null for kitti), position t and unit quaternion q as x, y, z, w.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

FORMATS = ("tum", "kitti", "euroc")
NUMBER = "decimal(38,9)"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), value of every line of the files. Files are split as Spark splits text; a line's number is its place in its split and the lines of
    the file's splits before it, of which one row each is summed up."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("__at"))
    blocks = lines.groupBy("file", "block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("__at") - F.col("__first") + F.col("__before")).alias("line_no"), "value")


def _fields(value: Column) -> tuple[Column, Column]:
    """(fields, whether they stand between commas)"""
    comma = value.contains(",")
    return F.when(comma, F.transform(F.split(value, ","), lambda x: F.trim(x))).otherwise(F.split(F.trim(F.regexp_replace(value, "\\s+", " ")), " ")), comma


def parse(lines: DataFrame, fmt: str | None = None, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(poses, bad lines) of lines(file, line_no, value): poses are file, line_no, format, timestamp_ns, t, q; bad lines file, line_no, value, reason.

    Empty lines and those that start with # are neither. Without fmt each line's format is told by its commas and number of fields, and a file's is that of its first line that has one; lines of
    another format are bad. Reasons: fields (no format has that many), format (not the file's), number, timestamp (not within 64-bit nanoseconds), rotation (a quaternion of length 0, or a matrix whose rows are not orthonormal within
    tolerance and right-handed). Quaternions are scaled to length 1."""
    f = lines.where("value is not null").withColumn("__v", F.trim(F.regexp_replace("value", "[\\r\\n\\t]", " "))).where("__v <> '' and not startswith(__v, '#')")
    fields, comma = _fields(F.col("__v"))
    f = f.withColumns({"__f": fields, "__comma": comma}).withColumn("__n", F.size("__f"))
    own = F.when(F.col("__comma") & (F.col("__n") >= 8), "euroc").when(~F.col("__comma") & (F.col("__n") == 8), "tum").when(~F.col("__comma") & (F.col("__n") == 12), "kitti")
    f = f.withColumn("__own", own)
    if fmt:
        f = f.withColumn("format", F.lit(fmt))
    else:
        first = f.where("__own is not null").groupBy("file").agg(F.min_by("__own", "line_no").alias("format"))
        f = f.join(first, "file", "left")
    x = lambda i: F.expr(f"try_cast(get(__f, {i}) as double)")
    used = F.when(F.col("format") == "kitti", 12).otherwise(8)
    f = f.withColumn("__x", F.array(*[x(i) for i in range(12)]))
    good = F.forall(F.slice("__x", 1, used), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    exact = F.expr(f"try_cast(get(__f, 0) as {NUMBER})")
    ns = F.when(F.col("format") == "tum", F.expr(f"try_cast(round(try_multiply(try_cast(get(__f, 0) as {NUMBER}), 1000000000BD), 0) as bigint)")).when(F.col("format") == "euroc", F.when(exact == F.floor(exact), exact.try_cast("bigint")))
    at = lambda i: F.col("__x")[i]
    f = f.withColumns({"timestamp_ns": ns, "__good": good})
    # one column a number, so that each is computed once
    order = {"tum": (4, 5, 6, 7), "euroc": (5, 6, 7, 4)}
    f = f.withColumns({f"__q{c}": F.when(F.col("format") == "tum", at(order["tum"][i])).otherwise(at(order["euroc"][i])) for i, c in enumerate("xyzw")})
    rows = [[at(4 * i + j) for j in range(3)] for i in range(3)]
    dot = lambda a, b: sum(u * v for u, v in zip(a, b))
    unit = F.greatest(*[F.abs(dot(rows[i], rows[j]) - (1.0 if i == j else 0.0)) for i in range(3) for j in range(i, 3)]) <= tolerance
    right = dot(rows[0], [rows[1][1] * rows[2][2] - rows[1][2] * rows[2][1], rows[1][2] * rows[2][0] - rows[1][0] * rows[2][2], rows[1][0] * rows[2][1] - rows[1][1] * rows[2][0]]) > 0
    length = F.sqrt(sum(F.col(f"__q{c}") * F.col(f"__q{c}") for c in "xyzw"))
    f = f.withColumn("__turn", F.when(F.col("format") == "kitti", unit & right).otherwise(length > 0))
    reason = (
        F.when(F.col("__own").isNull(), "fields").when(F.col("__own") != F.col("format"), "format").when(~F.col("__good"), "number")
        .when((F.col("format") != "kitti") & F.col("timestamp_ns").isNull(), "timestamp").when(~F.coalesce("__turn", F.lit(False)), "rotation")
    )
    f = f.withColumn("reason", reason)
    matrix = g.from_matrix(F.array(*[F.array(*r) for r in rows]))
    q = [F.when(F.col("format") == "kitti", getattr(matrix, c)).otherwise(F.col(f"__q{c}")) for c in "xyzw"]
    ok = f.where("reason is null").withColumns({f"__r{c}": v for c, v in zip("xyzw", q)})
    size = F.sqrt(sum(F.col(f"__r{c}") * F.col(f"__r{c}") for c in "xyzw"))
    ok = ok.withColumn("__size", size)
    place = lambda i, k: F.when(F.col("format") == "kitti", at(k)).otherwise(at(i))
    t = g.vec(place(1, 3), place(2, 7), place(3, 11))
    poses = ok.select("file", "line_no", "format", "timestamp_ns", g.col(t).alias("t"), F.struct(*[(F.col(f"__r{c}") / F.col("__size")).alias(c) for c in "xyzw"]).alias("q"))
    return poses, f.where("reason is not null").select("file", "line_no", "value", "reason")


def line(fmt: str) -> Column:
    """The text line of a pose of columns timestamp_ns, t, q; what it says reads back as the same numbers."""
    if fmt == "kitti":
        m = g.to_matrix(F.col("q"))
        return F.concat_ws(" ", *[x.cast("string") for i, c in enumerate("xyz") for x in (m[i][0], m[i][1], m[i][2], F.col(f"t.{c}"))])
    if fmt == "tum":
        seconds = (F.col("timestamp_ns").cast("decimal(20,0)") / F.lit(10**9).cast("decimal(11,0)")).cast("decimal(30,9)")
        return F.concat_ws(" ", seconds.cast("string"), *[F.col(f"t.{c}").cast("string") for c in "xyz"], *[F.col(f"q.{c}").cast("string") for c in "xyzw"])
    if fmt == "euroc":
        return F.concat_ws(",", F.col("timestamp_ns").cast("string"), *[F.col(f"t.{c}").cast("string") for c in "xyz"], *[F.col(f"q.{c}").cast("string") for c in "wxyz"])
    raise ValueError(f"format is one of {', '.join(FORMATS)}")
