"""Validity intervals: as-of resolution, overlap, versioned appends, clocks."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = (1 << 63) - 1
NEVER = -(1 << 63)


def resolve(left: DataFrame, intervals: DataFrame, key: str, ts: str, row_id: str) -> DataFrame:
    """left with the interval (prefix cal_) valid at ts: half open, a null end is open, a null
    start never matches; of several the one that starts last, then the higher version.

    An equi join on key with the range as residual, so it shuffles on key or is
    broadcast by size. One sensor's intervals multiply with its rows only where
    intervals overlap, which append_intervals rules out.
    """
    right = intervals.select(F.col(key).alias("__k"), *[F.col(c).alias(f"cal_{c}") for c in intervals.columns if c != key])
    cond = (F.col(key) == F.col("__k")) & (F.col("cal_valid_from_ns") <= F.col(ts)) & (F.col("cal_valid_to_ns").isNull() | (F.col(ts) < F.col("cal_valid_to_ns")))
    w = Window.partitionBy(row_id).orderBy(F.col("cal_valid_from_ns").desc_nulls_last(), F.col("cal_version").desc_nulls_last())
    return left.join(right, cond, "left").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__k")


def overlaps(intervals: DataFrame, key: str, id_: str) -> DataFrame:
    """Intervals that begin before an earlier one of the same key ends: (key, id_, earlier end)."""
    end = F.coalesce("valid_to_ns", F.lit(FOREVER))
    w = Window.partitionBy(key).orderBy("valid_from_ns", id_).rowsBetween(Window.unboundedPreceding, -1)
    return intervals.where("valid_from_ns is not null").withColumn("covered_to_ns", F.max(end).over(w)).where("covered_to_ns > valid_from_ns").select(key, id_, "covered_to_ns")


def append_intervals(existing: DataFrame, batch: DataFrame, key: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, rejected rows with reason) of a batch in arrival order `seq`.

    A row needs a start, an end after it, and no overlap with what is there or was
    accepted before it; a rejected row blocks nothing. Acceptance depends on the rows
    before, so each key's batch is walked in one pandas group; keys run in parallel.
    """
    names = [c for c in existing.columns]
    a = existing.withColumns({"__old": F.lit(True), "__seq": F.lit(-1).cast("long")})
    b = batch.select(*[c for c in names if c != "version"], F.lit(None).cast("long").alias("version"), F.col(seq).cast("long").alias("__seq")).withColumn("__old", F.lit(False))
    both = a.unionByName(b.select(*a.columns))

    # Whole numbers with nulls would reach pandas as floats, which can't hold nanoseconds: nulls travel as sentinels.
    sent = {"valid_from_ns": NEVER, "valid_to_ns": FOREVER, "version": 0}
    both = both.withColumns({f"__{c}": F.coalesce(c, F.lit(v)) for c, v in sent.items()})

    def walk(pdf):
        pdf = pdf.sort_values(["__old", "__seq"], ascending=[False, True])
        # accepted time as disjoint intervals in order: a row overlaps some accepted one exactly if it overlaps their union
        starts, ends, top, reason, version = [], [], 0, [], []
        for s, e, old, v in zip(pdf["__valid_from_ns"].tolist(), pdf["__valid_to_ns"].tolist(), pdf["__old"], pdf["__version"].tolist()):
            why = None
            if old:
                top = max(top, v)
            elif s == NEVER:
                why = "missing_start"
            elif e <= s:
                why = "empty_interval"
            elif (k := bisect.bisect_left(starts, e)) and ends[k - 1] > s:
                why = "overlap"
            else:
                top += 1
                v = top
            if why is None and s != NEVER and s < e:
                i, j = bisect.bisect_left(ends, s), bisect.bisect_right(starts, e)
                starts[i:j], ends[i:j] = [min([s, *starts[i:j][:1]])], [max([e, *ends[i:j][-1:]])]
            version.append(v)
            reason.append(why)
        return pdf.assign(__new=version, reason=reason)[[key, *carried, "__new", "reason"]]

    rest = [c for c in names if c not in (*sent, key)]
    carried = [*rest, "__valid_from_ns", "__valid_to_ns", "__old"]
    slim = both.select(key, *carried, "__seq", "__version")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(key, *carried).schema)
    done = slim.groupBy(key).applyInPandas(walk, f"{kinds}, __new long, reason string")
    done = done.select(
        key, *rest, F.nullif("__valid_from_ns", F.lit(NEVER)).alias("valid_from_ns"), F.nullif("__valid_to_ns", F.lit(FOREVER)).alias("valid_to_ns"),
        F.when(F.col("reason").isNull(), F.nullif("__new", F.lit(0))).alias("version"), "reason",
    )
    return done.where("reason is null").select(*names), done.where("reason is not null").select(*names, "reason")


def next_version(intervals: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    top = intervals.groupBy(key).agg(F.max("version").alias("v"))
    return keys.join(top, key, "left").select(key, (F.coalesce("v", F.lit(0)) + 1).alias("next_version"))


def move_pointers(sensors: DataFrame, before: DataFrame, after: DataFrame, key: str, id_: str) -> DataFrame:
    """sensors with the pointer `id_` at the calibration that was written last, where `after` has versions that `before` lacks; all others keep theirs.
    Versions grow by one a write, so the last written is the highest. Resolving at a time never reads the pointer."""
    top = lambda df, name: df.groupBy(key).agg(F.max(F.struct("version", id_)).alias(name))
    j = sensors.join(top(after, "__new"), key, "left").join(top(before, "__old"), key, "left")
    moved = F.col("__new.version") > F.coalesce("__old.version", F.lit(0))
    return j.withColumn(id_, F.when(moved, F.col(f"__new.{id_}")).otherwise(F.col(id_))).select(*sensors.columns)


def nominal_time(reading: Column, offset: Column) -> Column:
    return reading - offset


def event_time(sample: Column, fixed_latency: Column) -> Column:
    return sample - fixed_latency


def synchronized(source: Column, offset: Column) -> Column:
    return source + offset


def negated(offset: Column) -> Column:
    return -offset


def composed(a: Column, b: Column) -> Column:
    """The offset that applies a, then b."""
    return a + b


def duration(seconds: int = 0, milliseconds: int = 0, microseconds: int = 0, nanoseconds: int = 0) -> Column:
    """A duration in nanoseconds."""
    return F.lit(((seconds * 1000 + milliseconds) * 1000 + microseconds) * 1000 + nanoseconds).cast("long")
