"""Association of rows by time: nearest within a tolerance, and the row before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, key: str, ts: str, tolerance: int, right_id: str, buckets: int = 16) -> DataFrame:
    """left with the nearest row of right of the same key: right_id, its time (match_ts) and delta (its time less the left's), null if none lies
    within `tolerance` (itself included). Of two at the same distance the earlier counts, of several at one time the smallest right_id.

    Both sides shrink to distinct (key, time) first, so repeated times cost one row. Time is cut into buckets of `buckets` tolerances, and right
    times within a tolerance of a bucket's border are copied over it: every left time then finds the one before and the one after it in its own bucket, by one
    sort of both sides together, never by pairs. A sensor with a third of all rows spreads over its buckets. Rows whose key or
    time is null find nothing."""
    width = max(1, tolerance * buckets)
    at = F.col(ts)
    once = right.where(F.col(key).isNotNull() & at.isNotNull() & F.col(right_id).isNotNull()).groupBy(key, ts).agg(F.min(right_id).alias("__id"))
    spread = F.sequence(F.floor((at - tolerance) / F.lit(width)), F.floor((at + tolerance) / F.lit(width)))
    copies = once.select(key, F.explode(spread).alias("__b"), at.alias("__t"), at.alias("__r"), F.col("__id"))
    times = left.where(F.col(key).isNotNull() & at.isNotNull()).select(key, ts).distinct()
    probe = times.select(key, F.floor(at / F.lit(width)).alias("__b"), at.alias("__t"), F.lit(None).cast("long").alias("__r"), F.lit(None).cast(dict(right.dtypes)[right_id]).alias("__id"))
    both = copies.unionByName(probe)
    # at one time, the right row comes first: then it is the one before
    order = Window.partitionBy(key, "__b").orderBy("__t", F.col("__r").asc_nulls_last())
    hit = F.when(F.col("__r").isNotNull(), F.struct("__r", "__id"))
    both = both.withColumns({
        "__p": F.last(hit, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "__n": F.first(hit, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)),
    }).where("__r is null")
    back, ahead = F.col("__t") - F.col("__p.__r"), F.col("__n.__r") - F.col("__t")
    best = F.when(back.isNotNull() & (ahead.isNull() | (back <= ahead)), F.col("__p")).otherwise(F.col("__n"))
    found = both.select(key, F.col("__t").alias(ts), best.alias("__m")).where(F.abs(F.col("__m.__r") - F.col(ts)) <= tolerance)
    found = found.select(F.col(key).alias("__k"), F.col(ts).alias("__t"), F.col("__m.__id").alias("match_id"), F.col("__m.__r").alias("match_ts"))
    out = left.join(found, (F.col(key) == F.col("__k")) & (F.col(ts) == F.col("__t")), "left").drop("__k", "__t")
    return out.withColumn("delta", F.col("match_ts") - F.col(ts))


def associate(left: DataFrame, right: DataFrame, key: str, ts: str, tolerance: int, left_id: str, right_id: str) -> DataFrame:
    """key, left_id, right_id, delta of the pairs in which each row is the other's nearest (see nearest): each row is in one pair at most."""
    there = nearest(left.select(key, ts, left_id), right, key, ts, tolerance, right_id).where("match_id is not null")
    there = there.groupBy(key, "match_id", ts, "delta").agg(F.min(left_id).alias(left_id))
    back = nearest(right.select(key, ts, right_id), left, key, ts, tolerance, left_id).where("match_id is not null")
    back = back.select(key, F.col(right_id).alias("match_id"), F.col("match_id").alias(left_id))
    return there.join(back, [key, "match_id", left_id]).select(key, left_id, F.col("match_id").alias(right_id), "delta")


def with_previous(df: DataFrame, key: str, ts: str, order: list[str], columns: list[str], width: int) -> DataFrame:
    """df with prev_<column> of the row before it of its key in the order of `order` (which starts with ts), null for the first.

    Rows are sorted by key and time bucket of `width`; only the last row of each bucket goes on to the next bucket that has rows, so a key with a
    third of all rows is not sorted by one task."""
    names = [*dict.fromkeys([*order, *columns])]
    b = F.floor(F.col(ts) / F.lit(width))
    df = df.withColumn("__b", b)
    inside = Window.partitionBy(key, "__b").orderBy(*order)
    row = F.struct(*columns)
    last = df.groupBy(key, "__b").agg(F.max(F.struct(*names)).alias("__last"))
    carried = last.select(key, "__b", F.lag("__last").over(Window.partitionBy(key).orderBy("__b")).alias("__carry"), F.lit(1).alias("__first"))
    df = df.withColumns({"__prev": F.lag(row).over(inside), "__first": F.row_number().over(inside)})
    out = df.join(carried, [key, "__b", "__first"], "left")
    prev = {f"prev_{c}": F.coalesce(F.col(f"__prev.{c}"), F.col(f"__carry.{c}")) for c in columns}
    return out.withColumns(prev).drop("__b", "__prev", "__first", "__carry")
